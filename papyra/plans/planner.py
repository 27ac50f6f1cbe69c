"""The access path a query would take, by fixed priorities; a pure function of the query.

Spark picks the physical plan itself.  This one is kept for explain(), for metrics
and for the rule on offsets without a sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from papyra.functions.values import describe
from papyra.operators.predicates import And, Between, Compare, In, Predicate


@dataclass(frozen=True)
class Strategy:
    kind: str  # "index", "partition" or "full"
    target: str = ""

    def __str__(self) -> str:
        return {"index": f"index lookup on '{self.target}'", "partition": f"partition scan of '{self.target}'"}.get(self.kind, "full scan")


@dataclass(frozen=True)
class QueryPlan:
    strategy: Strategy
    residual_predicates: int


_CLASSES = ("eq", "in", "range")


def _class(p: Predicate) -> str | None:
    if isinstance(p, Compare):
        return {"eq": "eq", "ne": None}.get(p.op, "range")
    if isinstance(p, In):
        return "in"
    return "range" if isinstance(p, Between) else None


def plan(predicates: tuple[Predicate, ...], indexed: frozenset[str], partition_key: str | None) -> QueryPlan:
    """Equality on an index, then membership, then a range, then one partition, then all."""
    for wanted in _CLASSES:
        for p in predicates:
            if _class(p) == wanted and p.path in indexed:
                return QueryPlan(Strategy("index", p.path), len(predicates) - 1)
    one = partition_predicate(predicates, partition_key)
    if one is not None:
        return QueryPlan(Strategy("partition", describe(one.value)), len(predicates))
    return QueryPlan(Strategy("full"), len(predicates))


def partition_predicate(predicates: tuple[Predicate, ...], partition_key: str | None) -> Compare | None:
    """The first top-level equality on the partition key."""
    for p in predicates:
        if partition_key is not None and isinstance(p, Compare) and p.op == "eq" and p.path == partition_key:
            return p
    return None


def covered(query_plan: QueryPlan, predicates: tuple[Predicate, ...], sort: tuple[str, bool] | None) -> bool:
    """An index alone answers the query: one predicate, and no sort but ascending by the same field."""
    s = query_plan.strategy
    return s.kind == "index" and len(predicates) == 1 and (sort is None or sort == (s.target, True))


def flatten(root: Predicate) -> tuple[Predicate, ...]:
    return root.parts if isinstance(root, And) else (root,)
