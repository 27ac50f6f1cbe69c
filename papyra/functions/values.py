"""Literals, their text, and exact comparisons of columns with them.

Spark compares a bigint with a double as doubles, which loses digits and keeps
Parquet from filtering.  Here the literal is rewritten instead: every comparison of
an integer column is with an integer, and one of a double column with a double
that decides the same question.
"""

from __future__ import annotations

import datetime as dt
import enum
import math
import uuid
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
#: Seconds from 1970 to 2001, where numeric dates start.
DATE_EPOCH = 978_307_200
_NAIVE_EPOCH = dt.datetime(2001, 1, 1)

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def canonical(value: Any) -> Any:
    """A literal as None, bool, int, float, str, a date, or a Decimal that no float equals; whole numbers become ints."""
    if isinstance(value, enum.Enum):
        value = value.value
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, uuid.UUID):
        return str(value).upper()
    if isinstance(value, int):
        return value
    if isinstance(value, Decimal):
        if not value.is_finite():
            return float(value)
        if value == value.to_integral_value():
            return int(value)
        return float(value) if Decimal(float(value)) == value else value
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == math.floor(value) and INT_MIN <= value <= INT_MAX else value
    if isinstance(value, (dt.datetime, dt.date)):
        return value
    if hasattr(value, "item"):  # numpy scalars
        return canonical(value.item())
    raise TypeError(f"not a scalar: {value!r}")


def _micros(value: dt.datetime | dt.date) -> int:
    """Microseconds since 2001; without a zone the time is in UTC."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return (value - _NAIVE_EPOCH) // dt.timedelta(microseconds=1)


def seconds(value: dt.datetime | dt.date) -> int | float:
    """A date as the number of seconds since 2001."""
    return canonical(_micros(value) / 1e6)


def _double_text(value: float) -> str:
    """As Spark writes a double: by the JVM's own rules."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    return repr(value) if context is None else context._jvm.java.lang.Double.toString(value)


def describe(value: Any, dtype: T.DataType | None = None) -> str:
    """The text of a value, as it names partitions and ids: the same that describe_column() gives an equal value of a column of this type."""
    v = canonical(value)
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (dt.datetime, dt.date)):
        whole, part = divmod(abs(us := _micros(v)), 1_000_000)
        return f"{'-' if us < 0 else ''}{whole}" + (f".{part:06d}".rstrip("0") if part else "")
    if isinstance(v, str):
        return v
    if isinstance(dtype, T.DecimalType) and not (isinstance(v, float) and not math.isfinite(v)):
        text = format(Decimal(v), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(v, int) and INT_MIN <= v <= INT_MAX:
        return str(v)
    try:
        return _double_text(float(v))
    except OverflowError:
        return str(v)


def rank(value: Any) -> int:
    v = canonical(value)
    if v is None:
        return 0
    if isinstance(v, bool):
        return 1
    return 3 if isinstance(v, str) else 2


def is_scalar(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.BooleanType, T.StringType, T.DecimalType, *INTEGERS, *FLOATS, *TIMES))


def describe_column(c: Column, dtype: T.DataType) -> Column:
    """describe() of a column; null stays null."""
    if isinstance(dtype, FLOATS):
        return double_text(c.cast("double"))
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    if isinstance(dtype, TIMES):
        if isinstance(dtype, T.DateType):
            us = F.unix_date(c).cast("bigint") * 86_400_000_000
        else:
            zoned = F.concat(c.cast("string"), F.lit("Z")).cast("timestamp") if isinstance(dtype, T.TimestampNTZType) else c
            us = F.unix_micros(zoned)
        us = us - DATE_EPOCH * 1_000_000
        part = F.abs(us) % 1_000_000
        whole = F.regexp_replace((F.abs(us) - part).cast("string"), "000000$", "")
        tail = F.when(part > 0, F.concat(F.lit("."), F.rtrim(F.lpad(part.cast("string"), 6, "0"), F.lit("0")))).otherwise("")
        return F.concat(F.when(us < 0, "-").otherwise(""), whole, tail)
    return c.cast("string")


def double_text(c: Column) -> Column:
    """describe() of a double column: whole numbers within 64 bits have no point."""
    whole = (c == F.floor(c)) & (F.abs(c) < float(1 << 63))
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _const(c: Column, value: bool) -> Column:
    """value where c is present, null elsewhere."""
    return F.when(c.isNotNull(), F.lit(value))


def _times(c: Column, dtype: T.DataType, op: str, v: Any) -> Column | None:
    if not isinstance(v, (dt.datetime, dt.date)):
        return None
    if isinstance(dtype, T.DateType):
        day = v.date() if isinstance(v, dt.datetime) else v
        late = isinstance(v, dt.datetime) and v.time() != dt.time()
        if late:  # a date is midnight: strictly between this day and the next
            return _const(c, False) if op == "eq" else _apply(c, "le" if op in ("lt", "le") else "gt", F.lit(day))
        return _apply(c, op, F.lit(day))
    if not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    if isinstance(dtype, T.TimestampNTZType):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return _apply(c, op, F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz"))
    return _apply(c, op, F.lit(v if v.tzinfo is not None else v.replace(tzinfo=dt.timezone.utc)))


def _apply(c: Column, op: str, lit: Column) -> Column:
    return {"eq": c == lit, "lt": c < lit, "le": c <= lit, "gt": c > lit, "ge": c >= lit}[op]


def integer_bound(op: str, v: int | float) -> tuple[str, int] | bool:
    """The question `x op v` for whole x within 64 bits: (op, whole v), or its answer."""
    if isinstance(v, (float, Decimal)):
        if math.isnan(v) or v == math.inf:  # above all numbers
            return op in ("lt", "le")
        if v == -math.inf:
            return op in ("gt", "ge")
        if v != math.floor(v):
            if op == "eq":
                return False
            op, v = ("le", math.floor(v)) if op in ("lt", "le") else ("ge", math.floor(v) + 1)
    v = int(v)
    if v > INT_MAX:
        return op in ("lt", "le")
    if v < INT_MIN:
        return op in ("gt", "ge")
    return op, v


def double_bound(op: str, v: int | float) -> tuple[str, float] | bool:
    """The question `x op v` for doubles x: (op, double v), or its answer."""
    if isinstance(v, float):
        return op, v
    try:
        near = float(v)
    except OverflowError:
        near = math.inf if v > 0 else -math.inf
    if math.isfinite(near) and Decimal(near) == v:
        return op, near
    if op == "eq":
        return False
    low = near if math.isfinite(near) and Decimal(near) < v else math.nextafter(near, -math.inf)
    return ("le", low) if op in ("lt", "le") else ("gt", low)


def compare(c: Column, dtype: T.DataType, op: str, value: Any) -> Column | None:
    """`c op value` in three-valued logic (null where c is), or None if the types don't compare."""
    v = canonical(value)
    if v is None:
        return None
    if isinstance(dtype, TIMES):
        return _times(c, dtype, op, v)
    if isinstance(v, (dt.datetime, dt.date)):
        v = seconds(v)
    if isinstance(dtype, T.BooleanType):
        return _apply(c, op, F.lit(v)) if isinstance(v, bool) else None
    if isinstance(v, bool):
        return None
    if isinstance(dtype, T.StringType):
        return _apply(c, op, F.lit(v)) if isinstance(v, str) else None
    if isinstance(v, str):
        return None
    if isinstance(dtype, INTEGERS):
        got = integer_bound(op, v)
        if isinstance(got, bool):
            return _const(c, got)
        op, v = got
        return _apply(c, op, F.lit(v))
    if isinstance(dtype, FLOATS):
        got = double_bound(op, v)
        if isinstance(got, bool):
            return _const(c, got)
        op, v = got
        # NaN equals itself and is above all numbers, in Spark too.
        c = c.cast("double") if isinstance(dtype, T.FloatType) else c
        if v == 0 and op in ("eq", "ge"):  # Parquet's filters tell -0.0 from 0.0
            low = c >= F.lit(-0.0)
            return low if op == "ge" else low & (c <= F.lit(0.0))
        return _apply(c, op, F.lit(0.0 if v == 0 else v))
    if isinstance(dtype, T.DecimalType):
        if isinstance(v, float) and not math.isfinite(v):
            return _const(c, op in (("gt", "ge") if v == -math.inf else ("lt", "le")))
        return _apply(c, op, F.lit(Decimal(v)))
    return None
