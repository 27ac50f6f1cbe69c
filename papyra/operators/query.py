"""The fluent query: an immutable description that becomes one DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from papyra.crypto import decrypting
from papyra.errors import UnsupportedOperation
from papyra.functions.paths import Dynamic
from papyra.operators import predicates as P
from papyra.plans.planner import QueryPlan, covered, partition_predicate, plan

if TYPE_CHECKING:
    from papyra.sources.collection import Source

_BUILDERS: dict[str, Callable[..., P.Predicate]] = {
    "equal_to": P.equal, "not_equal_to": P.not_equal, "less_than": P.less, "less_than_or_equal_to": P.at_most, "greater_than": P.greater,
    "greater_than_or_equal_to": P.at_least, "is_in": P.is_in, "not_in": P.not_in, "contains": P.contains, "starts_with": P.starts_with,
    "ends_with": P.ends_with, "like": P.like, "glob": P.glob,
}


@dataclass(frozen=True)
class Query:
    source: Source
    predicates: tuple[P.Predicate, ...] = ()
    order: tuple[str, bool] | None = None
    limit_count: int | None = None
    offset_count: int = 0

    # building

    def where(self, field: str | P.Predicate, **condition: Any) -> Query:
        """Adds a predicate: a Predicate, or a field with one condition, such as ``equal_to=5`` or ``between=(1, 9)``."""
        if isinstance(field, P.Predicate):
            return replace(self, predicates=(*self.predicates, field))
        if len(condition) != 1:
            raise TypeError("where() takes one condition")
        ((name, value),) = condition.items()
        if name == "between":
            return self.where(P.between(field, *value))
        if name not in _BUILDERS:
            raise TypeError(f"unknown condition {name}")
        return self.where(_BUILDERS[name](field, value))

    def where_exists(self, field: str) -> Query:
        return self.where(P.exists(field))

    def where_not_exists(self, field: str) -> Query:
        return self.where(P.not_exists(field))

    def sort(self, by: str, ascending: bool = True) -> Query:
        """The last call wins.  Missing and null keys come first ascending, last descending."""
        return replace(self, order=(by, ascending))

    def limit(self, count: int) -> Query:
        return replace(self, limit_count=max(0, count))

    def offset(self, count: int) -> Query:
        return replace(self, offset_count=max(0, count))

    # plans

    def plan(self) -> QueryPlan:
        return plan(self.predicates, self.source.indexed, self.source.partition_key)

    def explain(self) -> QueryPlan:
        return self.plan()

    def condition(self) -> Column:
        return P.And(self.predicates).column(self.source.resolver)

    def _matches(self) -> DataFrame:
        df = self.source.frame()
        one = partition_predicate(self.predicates, self.source.partition_key)
        if one is not None:
            pruned = self.source.shard_filter(one.value)
            if pruned is not None:
                df = df.where(pruned)
        return df.where(self.condition()) if self.predicates else df

    def _sorted(self, df: DataFrame, field: str, ascending: bool) -> DataFrame:
        """df in order, with the keys of documents without a schema as columns: each is computed once a row."""
        at, *ties = self.source.resolver(field), *self.source.tiebreak()
        name = "_order"
        while any(c.lower().startswith(name) for c in df.columns):
            name = f"_{name}"
        if isinstance(at, Dynamic):
            df, at = at.held(df, name)
            # Missing and explicit null sort alike.
            df = df.withColumn(f"{name}_key", F.when(at.rank > 0, at.key))
            key = F.col(f"{name}_key")
        else:
            key = F.lit(None).cast("string") if at is None else at.column
        by = [key.asc_nulls_first() if ascending else key.desc_nulls_last()]
        for n, tie in enumerate(ties):
            if isinstance(tie, Dynamic):
                df, tie = tie.held(df, f"{name}{n}", "key")
            by.append(tie.key if isinstance(tie, Dynamic) else tie.column)
        return df.orderBy(*by)

    def rows(self) -> DataFrame:
        """The matching rows with the source's internal columns."""
        query_plan = self.plan()
        is_covered = covered(query_plan, self.predicates, self.order)
        order = self.order
        if self.offset_count and order is None:
            if not is_covered:
                raise UnsupportedOperation("offset requires a sort")
            order = (query_plan.strategy.target, True)
        df = self._matches()
        columns = df.columns
        if order is not None:
            df = self._sorted(df, *order)
        if self.offset_count:
            df = df.offset(self.offset_count)
        if self.limit_count is not None:
            df = df.limit(self.limit_count)
        return df.drop(*(c for c in df.columns if c not in columns))

    def _note(self) -> None:
        query_plan = self.plan()
        kind = query_plan.strategy.kind
        self.source.counters.add(**{{"index": "index_lookups", "partition": "partition_scans"}.get(kind, "full_scans"): 1})
        if covered(query_plan, self.predicates, self.order):
            self.source.counters.add(covered_queries=1)

    # terminals

    def to_df(self) -> DataFrame:
        """The result as a DataFrame of documents; nothing runs yet."""
        self.source.check_open()
        return self.source.documents(self.rows())

    def execute(self) -> list[Row]:
        df = self.to_df()
        self._note()
        with decrypting():
            return df.collect()

    def first(self) -> Row | None:
        got = self.limit(1).execute()
        return got[0] if got else None

    def count_df(self) -> DataFrame:
        """count() as a DataFrame of one row: count bigint."""
        self.source.check_open()
        return self.rows().agg(F.count(F.lit(1)).alias("count"))

    def count(self) -> int:
        """Matches that offset and limit leave."""
        df = self.count_df()
        self._note()
        with decrypting():
            return df.first()["count"]

    def distinct_df(self, field: str) -> DataFrame:
        """Distinct scalars of a field among the matches: value, and for fields without a type its key.  Sort and page are ignored."""
        self.source.check_open()
        df, at = self._matches(), self.source.resolver(field)
        if at is None:
            return df.where(F.lit(False)).select(F.lit(None).cast("string").alias("value"))
        if isinstance(at, Dynamic):
            rows = df.select(at.key.alias("key"), at.value.alias("v")).where(F.col("key").isNotNull())
            return rows.groupBy("key").agg(F.first(F.to_json("v")).alias("value")).orderBy("key").select("value", "key")
        return df.select(at.column.alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")

    def distinct_values(self, field: str) -> list[Any]:
        import json

        df = self.distinct_df(field)
        self._note()
        with decrypting():
            rows = df.collect()
        return [json.loads(r["value"]) if "key" in df.columns else r["value"] for r in rows]

    def delete(self) -> int:
        """Deletes the matches, as sort, offset and limit have them."""
        self.source.check_open()
        keys = self.rows()
        self._note()
        return self.source.delete_rows(keys)
