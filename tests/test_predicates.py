"""Predicates against a Python model, on typed columns and on VARIANT documents."""

from __future__ import annotations

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions.patterns import compiles, glob_regex, like_regex
from papyra.functions.paths import Resolver
from papyra.functions.values import INT_MAX, INT_MIN, double_bound, integer_bound
from papyra.operators import predicates as P
from tests.model import truth

BIG = 1 << 60
TYPED = [
    {"i": 5, "d": 1.5, "s": "Alpha", "b": True, "n": {"x": 1}, "a": [1, 2]},
    {"i": BIG + 1, "d": float(BIG), "s": "alpha\n", "b": False, "n": {"x": -7}, "a": []},
    {"i": -3, "d": math.nan, "s": "", "n": {}, "a": [9]},
    {"i": 0, "d": math.inf, "s": "a.b%c_d", "b": True},
    {"d": -0.0, "s": "É"},
    {"i": INT_MAX, "d": 9.007199254740993e15, "s": "ALPHA beta"},
    {"i": INT_MIN, "d": -math.inf, "s": "5", "b": False},
    {},
]
DYNAMIC = [
    *({k: v for k, v in d.items() if not (isinstance(v, float) and not math.isfinite(v))} for d in TYPED),
    {"i": "5", "d": True, "s": 5, "b": 1, "n": [{"x": 2}], "a": {"0": "zero"}},
    {"i": None, "d": None, "s": None, "b": None, "n": None, "a": None},
    {"i": 5.0, "d": 7, "s": 1e300, "b": "true", "n": 3, "a": [None, "x"]},
]
SCHEMA = "k INT, i BIGINT, d DOUBLE, s STRING, b BOOLEAN, n STRUCT<x: INT>, a ARRAY<INT>"
PATHS = ["i", "d", "s", "b", "n.x", "n", "a.0", "a.1", "a.-1", "zz", "n..x"]

values = st.one_of(
    st.sampled_from([0, 1, 5, -3, BIG, BIG + 1, INT_MAX, INT_MIN, INT_MAX + 1, 1 << 53, (1 << 53) + 1, 0.5, 1.5, 5.0, -0.0, 4.999, 1e300, float(BIG), math.nan, math.inf, -math.inf,
                     "", "Alpha", "alpha", "5", "É", True, False, None]),
    st.integers(-10, 10), st.floats(-10, 10), st.text("aA%_*?[]!.b\\", max_size=4),
)
texts = st.text("aAlp%_*?.béÉ", max_size=4)
leaves = st.one_of(
    st.builds(lambda f, o, v: P.Compare(f, o, v), st.sampled_from(PATHS), st.sampled_from(["eq", "ne", "lt", "le", "gt", "ge"]), values),
    st.builds(P.between, st.sampled_from(PATHS), values, values),
    st.builds(lambda f, v: P.is_in(f, v), st.sampled_from(PATHS), st.lists(values, max_size=4)),
    st.builds(lambda f, v: P.not_in(f, v), st.sampled_from(PATHS), st.lists(values, max_size=3)),
    st.builds(lambda f, o, t: P.Text(f, o, t), st.sampled_from(PATHS), st.sampled_from(["contains", "starts", "ends", "like", "glob"]), texts),
    st.builds(P.exists, st.sampled_from(PATHS)),
    st.builds(P.not_exists, st.sampled_from(PATHS)),
)
trees = st.recursive(leaves, lambda t: st.one_of(st.builds(P.Not, t), st.lists(t, max_size=3).map(lambda x: P.And(tuple(x))), st.lists(t, max_size=3).map(lambda x: P.Or(tuple(x)))), max_leaves=5)
calm = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)


def typed_frame(spark):
    rows = [(k, d.get("i"), d.get("d"), d.get("s"), d.get("b"), d.get("n") and (d["n"].get("x"),), d.get("a")) for k, d in enumerate(TYPED)]
    return spark.createDataFrame(rows, SCHEMA)


def check(df, resolve, docs, predicates):
    """A filter keeps rows for which the column is true: null counts as false."""
    got = df.orderBy("k").select(*(F.coalesce(p.column(resolve), F.lit(False)).alias(f"p{i}") for i, p in enumerate(predicates))).collect()
    for d, row in zip(docs, got):
        for p, hit in zip(predicates, row):
            assert hit == truth(p, d), (p, d)


@calm
@given(st.lists(trees, min_size=10, max_size=16))
def test_typed_columns(spark, predicates):
    # Typed columns can't tell null from missing: neither matches an equality with None.
    check(typed_frame(spark), Resolver(typed_frame(spark).schema), TYPED, predicates)


@calm
@given(st.lists(trees, min_size=6, max_size=8))
def test_documents_without_schema(spark, predicates):
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(DYNAMIC)], "k INT, t STRING").select("k", F.parse_json("t").alias("doc"))
    check(df, Resolver(df.schema, document="doc"), DYNAMIC, predicates)


@pytest.mark.parametrize("op", ["eq", "lt", "le", "gt", "ge"])
@pytest.mark.parametrize("v", [2.5, -2.5, 3, math.nan, math.inf, -math.inf, INT_MAX + 1, INT_MIN - 1, float(BIG)])
def test_integer_bounds(op, v):
    got = integer_bound(op, v)
    for x in (INT_MIN, -3, -2, 0, 2, 3, BIG - 1, BIG, BIG + 1, INT_MAX):
        want = truth(P.Compare("x", op, v), {"x": x})
        assert want == (got if isinstance(got, bool) else truth(P.Compare("x", got[0], got[1]), {"x": x}))


@pytest.mark.parametrize("op", ["eq", "lt", "le", "gt", "ge"])
@pytest.mark.parametrize("v", [3, (1 << 53) + 1, BIG + 1, 10**400, -(10**400)])
def test_double_bounds(op, v):
    got = double_bound(op, v)
    for x in (-math.inf, -1e300, 2.5, 3.0, float(1 << 53), float((1 << 53) + 2), float(BIG), math.nextafter(float(BIG), math.inf), 1e308, math.inf):
        want = {"eq": x == v, "lt": x < v, "le": x <= v, "gt": x > v, "ge": x >= v}[op]
        have = got if isinstance(got, bool) else {"eq": x == got[1], "lt": x < got[1], "le": x <= got[1], "gt": x > got[1], "ge": x >= got[1]}[got[0]]
        assert have == want, (x, op, v, got)


def test_patterns(spark):
    assert like_regex("plain.") is None and glob_regex("plain.") is None
    assert like_regex("a%b_c.") == r"(?iu)^a.*b.c\.$"
    assert glob_regex("a*[!x]?{") == r"^a.*[!x].\{$"
    assert not compiles("^[z-a]$") and compiles("^a$")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    typed_frame(spark).write.parquet(path)
    df = spark.read.parquet(path)
    resolve = Resolver(df.schema)
    for p, wanted in [
        (P.greater("i", 24.5), "GreaterThanOrEqual(i,25)"),
        (P.not_equal("s", "x"), "Not(EqualNullSafe(s,x))"),
        (~P.less("i", 3), "GreaterThanOrEqual(i,3)"),
        (P.is_in("i", [1, 2.0]), "In(i, [1,2])"),
        (P.starts_with("s", "Al"), "StringStartsWith(s,Al)"),
    ]:
        plan = df.where(p.column(resolve))._jdf.queryExecution().executedPlan().toString()
        assert wanted in plan.split("PushedFilters")[1], plan
