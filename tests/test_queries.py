"""Queries over small collections: results, order, paging, plans, distinct values, streams."""

from __future__ import annotations

import itertools

import pytest

from papyra import CollectionOptions, Database, FrameCollection
from papyra.errors import DatabaseClosed, UnsupportedOperation
from papyra.operators import predicates as P
from papyra.queries import PEOPLE

SCHEMA = "id BIGINT, name STRING, age BIGINT, country STRING, city STRING"


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    c = Database(spark, f"file://{tmp_path_factory.mktemp('db')}").collection("people", SCHEMA, CollectionOptions("id", "country", ("age", "country")))
    c.insert_many([dict(zip(("id", "name", "age", "country", "city"), p)) for p in PEOPLE])
    return c


def ids(q):
    return [r["id"] for r in q.execute()]


def test_boolean_trees(people):
    q = people.find()
    assert sorted(ids(q.where(P.equal("age", 25) | P.equal("country", "US")))) == [1, 2, 5, 6]
    assert sorted(ids(q.where(~P.equal("country", "BR")))) == [2, 4, 6]
    assert sorted(ids(q.where(P.is_in("age", [25, 70]) & ~P.equal("city", "Olinda")))) == [1, 4]
    assert sorted(ids(q.where("id", not_in=[1, 3, 5]))) == [2, 4, 6]
    assert sorted(ids(q)) == [1, 2, 3, 4, 5, 6]


def test_order_and_page(people):
    q = people.find()
    assert ids(q.where("age", equal_to=25).sort("id", ascending=False)) == [5, 1]
    assert [r["name"] for r in q.where("age", between=(25, 70)).sort("name").offset(1).limit(2).execute()] == ["Bob", "Charlie"]
    assert ids(q.where("age", between=(25, 70)).sort("id", ascending=False).limit(3)) == [6, 5, 4]
    assert ids(q.sort("nothing").limit(3)) == [1, 2, 3]
    assert ids(q.limit(0)) == [] and ids(q.limit(-1)) == []
    assert q.sort("age").first()["id"] == 1 and q.where("age", equal_to=1).first() is None
    with pytest.raises(UnsupportedOperation):
        q.limit(2).offset(2).execute()
    assert ids(q.where("age", greater_than=25).offset(1).limit(2)) == [6, 3]


def test_page_through_everything(people):
    for field, up in itertools.product(["age", "city"], [True, False]):
        q = people.find().sort(field, ascending=up)
        assert [i for k in range(0, 6, 2) for i in ids(q.offset(k).limit(2))] == ids(q)


def test_text(people):
    q = people.find()
    assert sorted(ids(q.where("name", like="a%e"))) == [1]
    assert sorted(ids(q.where("name", like="___"))) == [2, 5]
    assert sorted(ids(q.where("name", like="bob"))) == []
    assert sorted(ids(q.where("name", glob="B*"))) == [2]
    assert sorted(ids(q.where("name", glob="[BC]*"))) == [2, 3]


def test_count_and_distinct(people):
    q = people.find()
    assert q.where("age", greater_than=25).count() == 4
    assert q.sort("id").offset(4).limit(9).count() == 2
    assert sorted(q.distinct_values("age")) == [25, 30, 65, 70]
    assert sorted(q.where("age", greater_than_or_equal_to=30).sort("id").limit(1).distinct_values("country")) == ["BR", "PT", "US"]
    assert q.distinct_values("nothing") == []


def test_plans(people):
    q = people.find()
    say = lambda x: (str(x.explain().strategy), x.explain().residual_predicates)
    assert say(q) == ("full scan", 0)
    assert say(q.where("age", greater_than=3).where("id", equal_to=1).where("age", is_in=[1])) == ("index lookup on 'id'", 2)
    assert say(q.where("city", equal_to="x")) == ("full scan", 1)
    c = FrameCollection(people.all(), id_field="id", partition_key="city")
    assert say(c.find().where("city", equal_to="Recife")) == ("partition scan of 'Recife'", 1)
    assert str(c.find().where("city", equal_to="Recife").where("id", less_than=3).explain().strategy) == "index lookup on 'id'"


def test_partition_filter_prunes(people):
    plan = people.find().where("country", equal_to="US").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "_shard" in plan.split("PartitionFilters")[1].split("]")[0]


def test_queries_are_values(people):
    q = people.find().where("age", greater_than=25)
    q.where("id", equal_to=2), q.limit(1), q.sort("id")
    assert len(q.execute()) == 4


def test_missing_fields(spark):
    c = FrameCollection(spark.createDataFrame([(i, f"n{i}" if i % 3 == 0 else None) for i in range(1, 31)], "id BIGINT, note STRING"))
    q = c.find()
    assert q.where_exists("note").count() == 10 and q.where_not_exists("note").count() == 20
    assert q.where("note", not_equal_to="n3").count() == 29
    assert q.where("note", equal_to=None).count() == 0
    assert [r["id"] for r in q.sort("note").limit(2).execute()] == [1, 2]


def test_stream(people, spark, tmp_path):
    seen = [r["id"] for r in people.stream(2)]
    assert sorted(seen) == [1, 2, 3, 4, 5, 6]
    assert len(list(itertools.islice(people.stream(0), 2))) == 2
    c = Database(spark, f"file://{tmp_path}").collection("s", "id BIGINT")
    c.insert_many([{"id": i} for i in range(5)])
    pulled = c.stream(1)
    next(pulled)
    c.close()
    with pytest.raises(DatabaseClosed):
        list(pulled)


def test_dynamic_documents(spark, tmp_path):
    c = Database(spark, f"file://{tmp_path}").collection("d", None, CollectionOptions("id"))
    c.insert_many([{"id": 1, "x": None}, {"id": 2, "x": False}, {"id": 3, "x": 5}, {"id": 4, "x": 5.5}, {"id": 5, "x": "a"}, {"id": 6}, {"id": (1 << 60) + 1, "x": 5.0}, {"id": "7", "x": [1]}])
    q = c.find()
    keys = [d["doc"].toPython()["id"] for d in q.sort("x").execute()]
    assert set(keys[:3]) == {1, 6, "7"} and keys[3:] == [2, 3, (1 << 60) + 1, 4, 5]
    assert c.get((1 << 60) + 1)["x"] == 5.0 and c.get(7) is None and c.get("7")["x"] == [1]
    assert sorted(map(str, q.distinct_values("x"))) == sorted(map(str, [None, False, 5, 5.5, "a"])) or len(q.distinct_values("x")) == 5
    assert q.where("x", greater_than=5).count() == 1 and q.where("x", equal_to=None).count() == 1 and q.where("x", not_equal_to=5).count() == 6


def test_dynamic_keys_are_computed_once_a_row(spark, tmp_path):
    c = Database(spark, f"file://{tmp_path}").collection("d", None, CollectionOptions("id", "kind"))
    c.insert_many([{"id": i, "kind": "a", "x": i % 3} for i in range(9)])
    plans = [q.to_df() for q in (c.find().sort("x"), c.find().sort("x", ascending=False).offset(1).limit(3))] + [c._routed(c.all())]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("schemaOfVariant(") <= 2 and plan.count("variant_get(") <= 12
    assert "variant_get(" not in plans[1]._jdf.queryExecution().executedPlan().toString().split("output=[")[0]


def test_dynamic_order_over_all_types(spark, tmp_path):
    ordered = [False, True, -1e300, -(2**63), -1.5, -0.5, 0, 0.25, 1, 1.5, 2**53, 2**53 + 1, 2**63 - 1, 2.0**63, 1e300, "", "10", "9", "a", "é"]
    docs = [{"id": n, "x": v} for n, v in enumerate(ordered)]
    none = [{"id": 100}, {"id": 101, "x": None}, {"id": 102, "x": [1]}, {"id": 103, "x": {"y": 1}}]
    same = [{"id": True, "x": 1.0}, {"id": "s", "x": 1}, {"id": 0.5, "x": 1}]
    c = Database(spark, f"file://{tmp_path}").collection("d", None, CollectionOptions("id", "p"))
    c.insert_many([{**d, "p": d["id"]} for d in reversed(docs + none + same)])
    at = 8  # of the 1
    ones = [True, 0.5, at, "s"]
    q, ids = c.find(), lambda q: [d["doc"].toPython()["id"] for d in q.execute()]
    up = [100, 101, 102, 103, *range(at), *ones, *range(at + 1, len(ordered))]
    down = [*reversed(range(at + 1, len(ordered))), *ones, *reversed(range(at)), 100, 101, 102, 103]
    same_ids = lambda a, b: list(map(repr, map(_plain, a))) == list(map(repr, map(_plain, b)))
    assert same_ids(ids(q.sort("x")), up) and same_ids(ids(q.sort("x", ascending=False)), down)
    assert same_ids(ids(q.sort("x").offset(3).limit(12)), up[3:15])
    assert same_ids(ids(q.sort("x", ascending=False).limit(5)), down[:5])
    assert all(c.get(d["id"])["p"] == d["id"] for d in docs + none + same)
    assert q.where("p", equal_to=0.5).count() == 1 and q.where("p", equal_to=True).count() == 1


def _plain(value):
    return float(value) if not isinstance(value, (bool, int, str)) else value


def test_dynamic_sort_leaves_the_columns(spark):
    df = spark.createDataFrame([(1, '{"k": 2}', 7), (2, '{"k": "a"}', 8), (3, '{"k": 1.5}', 9), (4, "{}", 6)], "id BIGINT, props STRING, `_order_KEY` INT")
    q = FrameCollection(df, json=["props"]).find()
    for got in (q.sort("props.k"), q.sort("props.k").limit(9)):
        assert got.to_df().columns == df.columns and [tuple(r)[::2] for r in got.execute()] == [(4, 6), (3, 9), (1, 7), (2, 8)]
    assert q.sort("props.k", ascending=False).first()["_order_KEY"] == 8
