"""Predicates: an immutable tree of data, compiled to one Spark column.

Truth has two values.  Negation is pushed down to the leaves, and each leaf knows what a
missing value means for it, so that no coalesce() hides a comparison from Parquet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.patterns import compiles, glob_regex, like_regex
from papyra.functions.paths import Dynamic, Resolved, Typed
from papyra.functions.values import canonical, compare, integer_bound, rank

Resolve = Callable[[str], Resolved]
_NEGATED = {"lt": "ge", "le": "gt", "gt": "le", "ge": "lt"}


@dataclass(frozen=True)
class Predicate:
    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        raise NotImplementedError

    @property
    def path(self) -> str | None:
        return None

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...] = ()

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        got = [p.column(resolve, negated) for p in self.parts]
        return reduce(or_ if negated else and_, got) if got else F.lit(not negated)


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...] = ()

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        got = [p.column(resolve, negated) for p in self.parts]
        return reduce(and_ if negated else or_, got) if got else F.lit(negated)


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        return self.part.column(resolve, not negated)


@dataclass(frozen=True)
class Leaf(Predicate):
    field: str

    @property
    def path(self) -> str:
        return self.field


def _compare_dynamic(at: Dynamic, op: str, value: Any) -> Column | None:
    """The comparison for each stored type of the literal's class, exactly; null or false elsewhere.  None: never true."""
    v, kind = canonical(value), F.schema_of_variant(at.value)
    if v is None:
        return kind == "VOID" if op == "eq" else None
    if isinstance(v, bool):
        return compare(F.when(kind == "BOOLEAN", F.try_variant_get(at.value, "$", "boolean")), T.BooleanType(), op, v)
    if isinstance(v, str):
        return compare(at.text, T.StringType(), op, v)
    whole = compare(F.try_variant_get(at.value, "$", "bigint"), T.LongType(), op, v)
    other = compare(F.try_variant_get(at.value, "$", "double"), T.DoubleType(), op, v)
    return F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), whole).when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), other)


@dataclass(frozen=True)
class Compare(Leaf):
    """eq, ne, lt, le, gt or ge against a literal."""

    op: str
    value: Any

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        if self.op == "ne":
            return Compare(self.field, "eq", self.value).column(resolve, not negated)
        at = resolve(self.field)
        if at is None:
            return F.lit(negated)
        if isinstance(at, Dynamic):
            hit = _compare_dynamic(at, self.op, self.value)
            if hit is None:
                return F.lit(negated)
            return ~F.coalesce(hit, F.lit(False)) if negated else hit
        hit = compare(at.column, at.dtype, self.op, self.value)
        if hit is None:
            return F.lit(negated)
        if not negated:
            return hit
        if self.op == "eq":
            plain = compare(at.column, at.dtype, "eq", self.value)
            v = canonical(self.value)
            if isinstance(v, (bool, int, str)) and _pushes(at, v):
                return ~at.column.eqNullSafe(F.lit(v))
            return at.column.isNull() | ~plain
        return at.column.isNull() | compare(at.column, at.dtype, _NEGATED[self.op], self.value)


def _pushes(at: Typed, v: Any) -> bool:
    """Whether the literal is of the column's own type, so that a null-safe comparison can be pushed down."""
    if isinstance(v, bool):
        return isinstance(at.dtype, T.BooleanType)
    if isinstance(v, int):
        return isinstance(at.dtype, (T.LongType, T.IntegerType)) and -(1 << 31) <= v < 1 << 31 or isinstance(at.dtype, T.LongType) and isinstance(integer_bound("eq", v), tuple)
    return isinstance(at.dtype, T.StringType)


@dataclass(frozen=True)
class Between(Leaf):
    low: Any
    high: Any

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        return And((Compare(self.field, "ge", self.low), Compare(self.field, "le", self.high))).column(resolve, negated)


@dataclass(frozen=True)
class In(Leaf):
    values: tuple[Any, ...]

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        at = resolve(self.field)
        values = list(dict.fromkeys((rank(v), canonical(v)) for v in self.values))
        if at is None or not values:
            return F.lit(negated)
        if isinstance(at, Dynamic):
            hit = reduce(or_, (Compare(self.field, "eq", v).column(resolve) for _, v in values))
            return ~F.coalesce(hit, F.lit(False)) if negated else hit
        # A null in the list matches no stored value here: null is missing.
        usable = [v for _, v in values if compare(at.column, at.dtype, "eq", v) is not None]
        plain = [v for v in usable if isinstance(v, (int, str)) and not isinstance(v, bool) and _pushes(at, v)]
        rest = [compare(at.column, at.dtype, "eq", v) for v in usable if v not in plain or isinstance(v, bool)]
        hits = ([at.column.isin(plain)] if plain else []) + rest
        if not hits:
            return F.lit(negated)
        hit = reduce(or_, hits)
        return at.column.isNull() | ~hit if negated else hit


@dataclass(frozen=True)
class Text(Leaf):
    """contains, starts, ends, like or glob; false for all that isn't a string."""

    op: str
    pattern: str

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        at = resolve(self.field)
        c = at.text if isinstance(at, Dynamic) else at.column if isinstance(at, Typed) and isinstance(at.dtype, T.StringType) else None
        if c is None:
            return F.lit(negated)
        if self.op in ("like", "glob"):
            regex = (like_regex if self.op == "like" else glob_regex)(self.pattern)
            if regex is None:
                hit = c == F.lit(self.pattern)
            elif not compiles(regex):
                return F.lit(negated)
            else:
                hit = c.rlike(regex)
        else:
            hit = {"contains": c.contains, "starts": c.startswith, "ends": c.endswith}[self.op](F.lit(self.pattern))
        return c.isNull() | ~hit if negated else hit


@dataclass(frozen=True)
class Exists(Leaf):
    """The field is present; an explicit null is present."""

    def column(self, resolve: Resolve, negated: bool = False) -> Column:
        at = resolve(self.field)
        if at is None:
            return F.lit(negated)
        c = at.kind if isinstance(at, Dynamic) else at.column
        return c.isNull() if negated else c.isNotNull()


def equal(field: str, value: Any) -> Predicate:
    return Compare(field, "eq", value)


def not_equal(field: str, value: Any) -> Predicate:
    return Compare(field, "ne", value)


def less(field: str, value: Any) -> Predicate:
    return Compare(field, "lt", value)


def at_most(field: str, value: Any) -> Predicate:
    return Compare(field, "le", value)


def greater(field: str, value: Any) -> Predicate:
    return Compare(field, "gt", value)


def at_least(field: str, value: Any) -> Predicate:
    return Compare(field, "ge", value)


def between(field: str, low: Any, high: Any) -> Predicate:
    return Between(field, low, high)


def is_in(field: str, values: Iterable[Any]) -> Predicate:
    return In(field, tuple(values))


def not_in(field: str, values: Iterable[Any]) -> Predicate:
    return Not(In(field, tuple(values)))


def exists(field: str) -> Predicate:
    return Exists(field)


def not_exists(field: str) -> Predicate:
    return Not(Exists(field))


def contains(field: str, text: str) -> Predicate:
    return Text(field, "contains", text)


def starts_with(field: str, text: str) -> Predicate:
    return Text(field, "starts", text)


def ends_with(field: str, text: str) -> Predicate:
    return Text(field, "ends", text)


def like(field: str, pattern: str) -> Predicate:
    return Text(field, "like", pattern)


def glob(field: str, pattern: str) -> Predicate:
    return Text(field, "glob", pattern)


def all_of(*parts: Predicate) -> Predicate:
    return And(tuple(parts))


def any_of(*parts: Predicate) -> Predicate:
    return Or(tuple(parts))
