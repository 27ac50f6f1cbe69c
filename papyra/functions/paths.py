"""Dotted paths to columns.

A path goes through structs, maps, arrays (whole numbers count from 0) and, in
VARIANT columns and strings declared as JSON, through documents without a schema.
It ends at a scalar or is missing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.values import double_text, is_scalar


@dataclass(frozen=True)
class Typed:
    """A scalar column; null is the same as missing."""

    column: Column
    dtype: T.DataType


@dataclass(frozen=True)
class Dynamic:
    """A VARIANT value: SQL NULL if missing, a variant null if explicitly null."""

    value: Column
    #: Columns that hold properties of the value, by their names.
    columns: Mapping[str, Column] = field(default_factory=dict)

    def held(self, df: DataFrame, name: str, *more: str) -> tuple[DataFrame, Dynamic]:
        """df with columns called name_... for the value, its parts and more properties, and the value as these columns give it.

        Properties name each other so often that key, written out, reads the document hundreds of times. A sort computes
        its order for each comparison, and a projection of that size is a method too large for the JVM to compile.
        """
        df, at = df.withColumn(f"{name}_value", self.value), Dynamic(F.col(f"{name}_value"))
        for part in ("type", "kind", "rank", "whole", "long", "double", "side", "inside", *more):
            df = df.withColumn(f"{name}_{part}", getattr(at, part))
            at = replace(at, columns={**at.columns, part: F.col(f"{name}_{part}")})
        return df, at

    @property
    def type(self) -> Column:
        return self.columns.get("type", F.schema_of_variant(self.value))

    @property
    def kind(self) -> Column:
        """The value's type as text; null if missing or not a scalar."""
        k = self.type
        return self.columns.get("kind", F.when(~(k.startswith("OBJECT") | k.startswith("ARRAY")), k))

    @property
    def present(self) -> Column:
        return self.kind.isNotNull()

    @property
    def text(self) -> Column:
        return F.when(self.type == "STRING", F.try_variant_get(self.value, "$", "string"))

    @property
    def rank(self) -> Column:
        """0 null, 1 bool, 2 number, 3 string; null if missing."""
        k = self.kind
        return self.columns.get("rank", F.when(k == "VOID", 0).when(k == "BOOLEAN", 1).when(k == "STRING", 3).when(k.isNotNull(), 2))

    @property
    def whole(self) -> Column:
        """Whether the value is stored as a whole number; null if missing or not a scalar."""
        return self.columns.get("whole", self.kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"))

    @property
    def long(self) -> Column:
        return self.columns.get("long", F.when(self.whole, F.try_variant_get(self.value, "$", "bigint")))

    @property
    def double(self) -> Column:
        """Numbers that are not stored as whole ones."""
        return self.columns.get("double", F.when((self.rank == 2) & ~self.whole, F.try_variant_get(self.value, "$", "double")))

    @property
    def side(self) -> Column:
        """1 or -1 for numbers above or below 64 bits, 0 for all else."""
        d = self.double
        return self.columns.get("side", F.when(F.isnan(d) | (d >= float(1 << 63)), 1).when(d < -float(1 << 63), -1).otherwise(0))

    @property
    def inside(self) -> Column:
        return self.columns.get("inside", (self.rank == 2) & (self.side == 0))

    @property
    def key(self) -> Column:
        """A struct that orders and equates values of all types, whole numbers exactly; null if missing."""
        if "key" in self.columns:
            return self.columns["key"]
        d, whole, side, inside = self.double, self.whole, self.side, self.inside
        ip = (
            F.when(self.rank == 1, F.try_variant_get(self.value, "$", "boolean").cast("bigint"))
            .when(inside & whole, self.long)
            .when(inside, F.floor(d).cast("bigint"))
        )
        fp = F.when(inside & ~whole, d - F.floor(d)).when(inside, F.lit(0.0))
        return F.when(
            self.present,
            F.struct(
                self.rank.alias("rank"), side.alias("side"), ip.alias("ip"), fp.alias("fp"),
                F.when(side != 0, d).alias("big"), self.text.alias("str"),
            ),
        )

    @property
    def label(self) -> Column:
        """describe() of the value; null if missing."""
        key, rank = self.key, self.rank
        number = F.coalesce(F.when(key["fp"] == 0, key["ip"].cast("string")), double_text(self.double))
        made = F.when(rank == 0, F.lit("null")).when(rank == 1, F.when(key["ip"] == 1, "true").otherwise("false")).when(rank == 2, number).otherwise(key["str"])
        return self.columns.get("label", made)


Resolved = Typed | Dynamic | None


def segments(path: str) -> list[str]:
    """Parts of a path; a plain name is one part, repeated dots count as one."""
    return [p for p in path.split(".") if p] if "." in path else [path]


def _position(part: str) -> int | None:
    digits = part[1:] if part[:1] in ("+", "-") else part
    return int(part) if digits.isascii() and digits.isdigit() else None


def _quoted(part: str) -> str:
    return "['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _into_variant(doc: Column, parts: list[str]) -> Dynamic:
    value = doc
    for part in parts:
        at = _position(part)
        named = F.try_variant_get(value, "$" + _quoted(part), "variant")
        if at is not None and at >= 0:  # an element of an array, or a key that looks like a number
            named = F.coalesce(F.try_variant_get(value, f"$[{at}]", "variant"), named)
        value = named
    return Dynamic(value)


@dataclass(frozen=True)
class Resolver:
    """Resolves paths against a schema.

    json: string columns that hold JSON documents.  document: the VARIANT column in which all paths start, if the
    collection has no schema.
    """

    schema: T.StructType
    json: frozenset[str] = frozenset()
    document: str | None = None

    def __call__(self, path: str) -> Resolved:
        parts = segments(path)
        if self.document is not None:
            return _into_variant(F.col(f"`{self.document}`"), parts)
        if not parts:
            return None
        dtype: T.DataType = self.schema
        column: Column | None = None
        for i, part in enumerate(parts):
            if isinstance(dtype, T.StructType):
                if part not in dtype.names:
                    return None
                column = F.col(f"`{part}`") if column is None else column.getField(part)
                dtype = dtype[part].dataType
                if i == 0 and part in self.json:
                    return _into_variant(F.try_parse_json(column), parts[1:])
            elif isinstance(dtype, T.ArrayType):
                at = _position(part)
                if at is None or at < 0:
                    return None
                column, dtype = F.get(column, at), dtype.elementType
            elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
                column, dtype = F.try_element_at(column, F.lit(part)), dtype.valueType
            elif isinstance(dtype, T.VariantType):
                return _into_variant(column, parts[i:])
            else:
                return None
        if isinstance(dtype, T.VariantType):
            return Dynamic(column)
        return Typed(column, dtype) if is_scalar(dtype) else None
