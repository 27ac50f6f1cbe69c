"""Stored and literal texts of ids and partition values agree for every scalar type."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import CollectionOptions, Database
from papyra.functions.values import describe, describe_column

UTC = dt.timezone.utc
VALUES = {
    "double": [0.5, 1e-7, -1e-7, 1e20, 1e300, -0.0, 3.0, 0.1, float("inf"), float("nan"), 2.0**63, 5e-324, 123456789.125],
    "float": [0.5, 2.0, -0.25],
    "decimal(12,2)": [Decimal("1.50"), Decimal("100.00"), Decimal("-0.10"), Decimal("0.00"), Decimal("100.05")],
    "decimal(38,0)": [Decimal(10) ** 20, Decimal(5)],
    "timestamp": [dt.datetime(2020, 1, 1), dt.datetime(1990, 5, 6, 7, 8, 9, 10), dt.datetime(2001, 1, 1), dt.datetime(2000, 12, 31, 23, 59, 59, 999_999), dt.datetime(2500, 1, 1, 0, 0, 0, 1)],
    "timestamp_ntz": [dt.datetime(2020, 1, 1), dt.datetime(1990, 5, 6, 7, 8, 9, 10)],
    "date": [dt.date(2020, 1, 1), dt.date(1960, 2, 29), dt.date(2001, 1, 1)],
    "boolean": [True, False],
    "bigint": [0, -5, (1 << 63) - 1],
    "string": ["", "a/b", "null", "é"],
}


def frame(spark, kind, values):
    if kind == "timestamp":
        values = [v.replace(tzinfo=UTC) for v in values]
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n int, v {kind}")


@pytest.mark.parametrize("kind", VALUES)
def test_texts_agree(spark, kind):
    df = frame(spark, kind, VALUES[kind])
    dtype = df.schema["v"].dataType
    got = [r["t"] for r in df.select("n", describe_column(F.col("v"), dtype).alias("t")).orderBy("n").collect()]
    assert got == [describe(v, dtype) for v in VALUES[kind]]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(), min_size=60, max_size=60), st.lists(st.datetimes(dt.datetime(1600, 1, 1), dt.datetime(2900, 1, 1)), min_size=20, max_size=20), st.lists(st.decimals(-(10**10), 10**10, places=5), min_size=20, max_size=20))
def test_texts_agree_everywhere(spark, floats, times, decimals):
    for kind, values in (("double", floats), ("timestamp", times), ("timestamp_ntz", times), ("decimal(20,5)", decimals)):
        df = frame(spark, kind, values)
        dtype = df.schema["v"].dataType
        got = [r["t"] for r in df.select("n", describe_column(F.col("v"), dtype).alias("t")).orderBy("n").collect()]
        assert got == [describe(v, dtype) for v in values]


@pytest.mark.parametrize("kind", ["double", "timestamp", "date", "decimal(12,2)"])
def test_equality_on_partitions_and_ids(spark, tmp_path, kind):
    values = [v for v in VALUES[kind] if not (isinstance(v, float) and math.isnan(v))]
    df = frame(spark, kind, values).withColumnRenamed("n", "id")
    db = Database(spark, f"file://{tmp_path}/db")
    c = db.collection("parts", "id int, v " + kind, CollectionOptions("id", "v"))
    c.insert_many(df)
    ids = db.collection("ids", "id " + kind + ", n int", CollectionOptions("id"))
    ids.insert_many(df.select(F.col("v").alias("id"), F.col("id").alias("n")))
    for i, v in enumerate(values):
        assert [r["id"] for r in c.find().where("v", equal_to=v).execute()] == [i]
        assert [r["id"] for r in c.find().where("v", between=(v, v)).execute()] == [i]
        assert [r["id"] for r in c.scan_partition(v).collect()] == [i]
        assert ids.get(v)["n"] == i
    assert ids.delete(values[0]) and ids.get(values[0]) is None and ids.count() == len(values) - 1


def test_documents_without_a_schema(spark, tmp_path):
    values = [1e-7, -1e-7, 1e20, 0.5, 10**20 + 0.0, 7, "7", True]
    c = Database(spark, f"file://{tmp_path}/db").collection("c", None, CollectionOptions("id", "v"))
    c.insert_many([{"id": v, "v": v, "n": i} for i, v in enumerate(values) if i != 4])
    c.insert({"id": "date", "v": dt.datetime(2001, 1, 1, 0, 0, 1), "n": 8})
    for i, v in enumerate(values):
        i = 2 if i == 4 else i
        assert [r["doc"]["n"] if isinstance(r["doc"], dict) else r["doc"].toPython()["n"] for r in c.find().where("v", equal_to=v).execute()] == [i]
        assert c.get(v)["n"] == i
    assert c.find().where("v", equal_to=dt.datetime(2001, 1, 1, 0, 0, 1)).count() == 1
    assert c.delete(-1e-7) and c.count() == 7


def test_exact_decimals(spark):
    from papyra.sources.collection import FrameCollection

    df = spark.createDataFrame([(1, Decimal("0.10"), 0.1), (2, Decimal("0.30"), 0.3)], T.StructType.fromDDL("id int, d decimal(10,2), f double"))
    c = FrameCollection(df)
    ids = lambda **k: [r["id"] for r in c.find().where(*k["on"], **k["by"]).sort("id").execute()]
    assert ids(on=("d",), by={"equal_to": Decimal("0.1")}) == [1] and ids(on=("d",), by={"is_in": [Decimal("0.3"), 5]}) == [2]
    assert ids(on=("f",), by={"equal_to": Decimal("0.1")}) == [] and ids(on=("f",), by={"greater_than": Decimal("0.1")}) == [1, 2]
    assert ids(on=("id",), by={"less_than": Decimal("1.1")}) == [1]
