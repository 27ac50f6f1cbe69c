"""The registered queries of the document engine, each with the SQL that checks it."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import crypto
from papyra.operators import predicates as P
from papyra.operators.query import Query
from papyra.options import AutoSync, CollectionOptions, Compression, DatabaseOptions
from papyra.sources.collection import Collection, FrameCollection
from papyra.sources.database import Database
from papyra.sources.files import scratch_dir

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

_IDS = {
    "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "labels": "doc_id", "lineitem": None,
}
_PARTITION = {"orders": "o_orderstatus", "customer": "c_mktsegment", "events": "event_type", "part": "p_type"}


def _table(spark: SparkSession, sf: str, name: str, **more) -> FrameCollection:
    return FrameCollection.from_parquet(spark, f"{sf}/{name}.parquet", id_field=_IDS[name], partition_key=_PARTITION.get(name), **more)


def _labelled(spark: SparkSession, sf: str) -> FrameCollection:
    """documents with the optional fields quality and toxic."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return FrameCollection(docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left"), id_field="doc_id")


_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _add(name: str, run: Run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _find(name: str, table: str, columns: str, where: str, build: Callable[[Query], Query]) -> None:
    """A query whose result is the given columns of the matches."""
    cols = [c.strip() for c in columns.split(",")]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        source = _labelled(spark, sf) if table == "labelled" else _table(spark, sf, table)
        return build(source.find()).to_df().select(*cols)

    _add(name, run, f"SELECT {columns} FROM {_LABELLED if table == 'labelled' else table} {where}")


_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_P = "p_partkey, p_name, p_brand, p_size"
_L = "doc_id, lang, quality, toxic"

_find("pred_eq", "orders", _O, "WHERE o_orderstatus = 'F'", lambda q: q.where("o_orderstatus", equal_to="F"))
_find("pred_ne", "orders", _O, "WHERE o_orderstatus IS DISTINCT FROM 'F'", lambda q: q.where("o_orderstatus", not_equal_to="F"))
_find("pred_ne_missing", "labelled", _L, "WHERE quality IS DISTINCT FROM 1", lambda q: q.where("quality", not_equal_to=1))
_find("pred_lt", "orders", _O, "WHERE o_totalprice < 50000.5", lambda q: q.where("o_totalprice", less_than=50000.5))
_find("pred_le", "part", _P, "WHERE p_size <= 10", lambda q: q.where("p_size", less_than_or_equal_to=10))
_find("pred_gt", "customer", "c_custkey, c_acctbal", "WHERE c_acctbal > 5000", lambda q: q.where("c_acctbal", greater_than=5000))
_find("pred_ge", "part", _P, "WHERE p_size >= 40", lambda q: q.where("p_size", greater_than_or_equal_to=40))
_find("pred_between", "orders", _O, "WHERE o_totalprice BETWEEN 100000 AND 150000", lambda q: q.where("o_totalprice", between=(100000, 150000)))
_find("pred_in", "orders", _O, "WHERE o_custkey IN (1, 7, 70, 700)", lambda q: q.where("o_custkey", is_in=[1, 7, 70, 700]))
_find("pred_in_dupes", "orders", _O, "WHERE o_custkey IN (5, 6)", lambda q: q.where("o_custkey", is_in=[5, 5, 6, 5.0]))
_find("pred_in_mixed", "orders", _O, "WHERE o_custkey IN (5, 6)", lambda q: q.where("o_custkey", is_in=[5, "6", 6.0, 7.5, None, True]))
_find("pred_not_in_missing", "labelled", _L, "WHERE quality IS NULL OR quality NOT IN (1, 2)", lambda q: q.where("quality", not_in=[1, 2]))
_find("pred_contains", "part", _P, "WHERE contains(p_name, 'a')", lambda q: q.where("p_name", contains="a"))
_find("pred_starts_with", "part", _P, "WHERE starts_with(p_brand, 'Brand#1')", lambda q: q.where("p_brand", starts_with="Brand#1"))
_find("pred_ends_with", "part", _P, "WHERE ends_with(p_brand, '3')", lambda q: q.where("p_brand", ends_with="3"))
_find("pred_like", "part", _P, "WHERE regexp_matches(p_brand, '(?i)^bRAND.*2$')", lambda q: q.where("p_brand", like="bRAND%2"))
_find("pred_like_no_wildcard", "part", _P, "WHERE p_brand = 'Brand#12'", lambda q: q.where(P.any_of(P.like("p_brand", "Brand#12"), P.like("p_brand", "brand#13"))))
_find("pred_like_underscore", "part", _P, "WHERE regexp_matches(p_brand, '(?i)^brand#.3$')", lambda q: q.where("p_brand", like="brand#_3"))
_find("pred_like_special", "orders", "o_orderkey, o_orderpriority", "WHERE regexp_matches(o_orderpriority, '(?i)^4-not .*$')", lambda q: q.where("o_orderpriority", like="4-not %"))
_find("pred_glob_star", "orders", "o_orderkey, o_orderpriority", "WHERE regexp_matches(o_orderpriority, '^.*-HIGH$')", lambda q: q.where("o_orderpriority", glob="*-HIGH"))
_find("pred_glob_class", "orders", "o_orderkey, o_orderpriority", "WHERE regexp_matches(o_orderpriority, '^[1-3]-.*$')", lambda q: q.where("o_orderpriority", glob="[1-3]-*"))
_find("pred_glob_question", "part", _P, "WHERE regexp_matches(p_brand, '^Brand#1.$')", lambda q: q.where("p_brand", glob="Brand#1?"))
_find("pred_glob_bang_is_plain", "orders", "o_orderkey, o_orderpriority", "WHERE regexp_matches(o_orderpriority, '^[!1].*$')", lambda q: q.where("o_orderpriority", glob="[!1]*"))
_find("pred_invalid_pattern", "orders", "o_orderkey", "WHERE false", lambda q: q.where("o_orderpriority", glob="[z-a]*"))
_find("pred_exists", "labelled", _L, "WHERE quality IS NOT NULL", lambda q: q.where_exists("quality"))
_find("pred_not_exists", "labelled", _L, "WHERE quality IS NULL", lambda q: q.where_not_exists("quality"))
_find("pred_and", "orders", _O, "WHERE o_orderstatus = 'O' AND o_totalprice > 100000", lambda q: q.where("o_orderstatus", equal_to="O").where("o_totalprice", greater_than=100000))
_find("pred_or", "orders", _O, "WHERE o_orderstatus = 'P' OR o_totalprice < 20000", lambda q: q.where(P.any_of(P.equal("o_orderstatus", "P"), P.less("o_totalprice", 20000))))
_find("pred_not", "orders", _O, "WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)", lambda q: q.where(~(P.equal("o_orderstatus", "F") & P.less("o_totalprice", 200000))))
_find("pred_not_over_missing", "labelled", _L, "WHERE NOT coalesce(quality > 0, false)", lambda q: q.where(~P.greater("quality", 0)))
_find(
    "pred_nested_tree", "labelled", _L, "WHERE (coalesce(quality = 1, false) OR coalesce(toxic = 1, false)) AND NOT coalesce(lang = 'en' AND n_chars > 500, false)",
    lambda q: q.where((P.equal("quality", 1) | P.equal("toxic", 1)) & ~(P.equal("lang", "en") & P.greater("n_chars", 500))),
)
_find("pred_empty_and", "nation", "n_nationkey", "", lambda q: q.where(P.all_of()))
_find("pred_empty_or", "nation", "n_nationkey", "WHERE false", lambda q: q.where(P.any_of()))
_find("pred_int_vs_fraction", "nation", "n_nationkey", "WHERE n_nationkey BETWEEN 5 AND 7", lambda q: q.where("n_nationkey", greater_than=4.5).where("n_nationkey", less_than=7.5))
_find("pred_int_vs_whole_double", "nation", "n_nationkey", "WHERE n_nationkey = 23", lambda q: q.where("n_nationkey", equal_to=23.0))
_find("pred_type_mismatch", "nation", "n_nationkey", "WHERE false", lambda q: q.where(P.any_of(P.equal("n_nationkey", "5"), P.greater("n_name", 5), P.equal("n_nationkey", True))))
_find("pred_ne_type_mismatch", "nation", "n_nationkey", "", lambda q: q.where("n_nationkey", not_equal_to="5"))
_find("pred_unknown_field", "nation", "n_nationkey", "WHERE false", lambda q: q.where("nothing.there", equal_to=1))
_find(
    "pred_date_range", "orders", "o_orderkey, o_orderdate", "WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
    lambda q: q.where("o_orderdate", greater_than_or_equal_to=dt.datetime(1995, 1, 1)).where("o_orderdate", less_than=dt.datetime(1996, 1, 1)),
)
_find("pred_lineitem", "lineitem", "l_orderkey, l_linenumber, l_quantity", "WHERE l_quantity > 45 AND l_returnflag = 'R'", lambda q: q.where("l_quantity", greater_than=45).where("l_returnflag", equal_to="R"))


# paths

_add(
    "path_json_field",
    lambda s, sf: _table(s, sf, "events", json=["props"]).find().where("props.k", greater_than=49.5).to_df().select("event_id", "props"),
    "SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 49.5",
)


def _nested(s: SparkSession, sf: str) -> FrameCollection:
    df = s.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.struct("c_name", F.struct("c_nationkey", "c_acctbal").alias("account")).alias("who"))
    return FrameCollection(df, id_field="c_custkey")


_add(
    "path_struct_field",
    lambda s, sf: _nested(s, sf).find().where("who.account.c_acctbal", less_than=0).to_df().select("c_custkey", F.col("who.c_name").alias("c_name")),
    "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0",
)
_add("path_leaf_not_scalar", lambda s, sf: _nested(s, sf).find().where_exists("who.account").to_df().select("c_custkey"), "SELECT c_custkey FROM customer WHERE false")
_add(
    "path_array_index",
    lambda s, sf: _table(s, sf, "embeddings").find().where("embedding.0", greater_than=0.1).to_df().select("vec_id", "label"),
    "SELECT vec_id, label FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) > 0.1",
)
_add("path_array_out_of_range", lambda s, sf: _table(s, sf, "embeddings").find().where_exists("embedding.64").to_df().select("vec_id"), "SELECT vec_id FROM embeddings WHERE false")


# order and page

_find("sort_asc", "orders", _O, "ORDER BY o_totalprice, o_orderkey LIMIT 500", lambda q: q.sort("o_totalprice").limit(500))
_find("sort_desc", "orders", _O, "ORDER BY o_totalprice DESC, o_orderkey LIMIT 500", lambda q: q.sort("o_totalprice", ascending=False).limit(500))
_find("sort_missing_first", "labelled", _L, "ORDER BY quality NULLS FIRST, doc_id LIMIT 700", lambda q: q.sort("quality").limit(700))
_find("sort_missing_last_desc", "labelled", _L, "ORDER BY quality DESC NULLS LAST, doc_id LIMIT 100", lambda q: q.sort("quality", ascending=False).limit(100))
_find("topk", "orders", _O, "WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
      lambda q: q.where("o_orderstatus", equal_to="F").where("o_totalprice", between=(100000, 300000)).sort("o_totalprice", ascending=False).limit(20))
_find("page_offset_limit", "customer", "c_custkey, c_acctbal", "ORDER BY c_acctbal, c_custkey LIMIT 30 OFFSET 60", lambda q: q.sort("c_acctbal").offset(60).limit(30))
_find("page_offset_covered", "orders", _O, "WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25 OFFSET 50", lambda q: q.where("o_orderkey", greater_than=100).offset(50).limit(25))
_find("limit_zero", "nation", "n_nationkey", "LIMIT 0", lambda q: q.limit(0))
_find("limit_negative", "nation", "n_nationkey", "LIMIT 0", lambda q: q.limit(-5))
_find("first", "customer", "c_custkey, c_name", "ORDER BY c_acctbal DESC, c_custkey LIMIT 1", lambda q: q.sort("c_acctbal", ascending=False).limit(1))


# terminals

_add("count_all", lambda s, sf: _table(s, sf, "orders").find().count_df(), "SELECT count(*) AS count FROM orders")
_add("count_filtered", lambda s, sf: _table(s, sf, "lineitem").find().where("l_discount", less_than=0.03).count_df(), "SELECT count(*) AS count FROM lineitem WHERE l_discount < 0.03::DOUBLE")
_add("count_limited", lambda s, sf: _table(s, sf, "orders").find().sort("o_orderkey").offset(5).limit(100).count_df(), "SELECT count(*) AS count FROM (SELECT 1 FROM orders LIMIT 100 OFFSET 5)")
_add("distinct_all", lambda s, sf: _table(s, sf, "part").find().distinct_df("p_type"), "SELECT DISTINCT p_type AS value FROM part")
_add("distinct_filtered", lambda s, sf: _table(s, sf, "customer").find().where("c_acctbal", greater_than=9000).distinct_df("c_nationkey"), "SELECT DISTINCT c_nationkey AS value FROM customer WHERE c_acctbal > 9000")
_add("distinct_skips_missing", lambda s, sf: _labelled(s, sf).find().distinct_df("quality"), "SELECT DISTINCT quality AS value FROM labels")
_add("distinct_ignores_page", lambda s, sf: _table(s, sf, "orders").find().sort("o_orderkey").limit(1).distinct_df("o_orderstatus"), "SELECT DISTINCT o_orderstatus AS value FROM orders")
_add("get_by_id", lambda s, sf: _table(s, sf, "customer").find().where("c_custkey", equal_to=42).limit(1).to_df(), "SELECT * FROM customer WHERE c_custkey = 42")
_add("partition_scan", lambda s, sf: _table(s, sf, "orders").scan_partition("P"), "SELECT * FROM orders WHERE o_orderstatus = 'P'")
_add("full_scan", lambda s, sf: _table(s, sf, "supplier").all(), "SELECT * FROM supplier")


# collections with writes: the final state as a DataFrame

_CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


def _fresh(spark: SparkSession, options: DatabaseOptions = DatabaseOptions()) -> Database:
    return Database(spark, f"{scratch_dir(spark)}/db-{uuid.uuid4().hex}", options)


def _customers(spark: SparkSession, sf: str, options: DatabaseOptions = DatabaseOptions()) -> tuple[Database, Collection]:
    db = _fresh(spark, options)
    c = db.collection("customers", _CUSTOMER, CollectionOptions("c_custkey", "c_mktsegment", ("c_nationkey", "c_acctbal")))
    c.insert_many(spark.read.parquet(f"{sf}/customer.parquet"))
    return db, c


def _state(name: str, sql: str, change: Callable[[SparkSession, Collection], None], options: DatabaseOptions = DatabaseOptions()) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        _, c = _customers(spark, sf, options)
        change(spark, c)
        return c.all()

    _add(name, run, sql)


def _ignore(fn: Callable[[], object]) -> None:
    from papyra.errors import PapyraError

    try:
        fn()
    except PapyraError:
        return
    raise AssertionError("the write should have failed")


def _bump(c: Collection, low: int, high: int) -> DataFrame:
    return c.find().where("c_custkey", between=(low, high)).to_df().withColumn("c_acctbal", F.col("c_acctbal") + 1000)


_REST = "c_custkey, c_name, c_nationkey"
_NEW = {"c_custkey": -1, "c_name": "New", "c_nationkey": 3, "c_acctbal": 1.5, "c_mktsegment": "BUILDING"}
_NEW_SQL = "SELECT -1, 'New', 3, 1.5, 'BUILDING'"

_state("insert_many_state", f"SELECT * FROM customer UNION ALL {_NEW_SQL}", lambda s, c: c.insert(_NEW))
_state("update_state", f"SELECT {_REST}, CASE WHEN c_custkey BETWEEN 10 AND 50 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer", lambda s, c: c.update_many(_bump(c, 10, 50)))
_state("upsert_state", f"SELECT * FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 7, 'Seven', NULL, 7.0, 'BUILDING' UNION ALL {_NEW_SQL}",
       lambda s, c: c.upsert_many([{"c_custkey": 7, "c_name": "Seven", "c_acctbal": 7, "c_mktsegment": "BUILDING"}, _NEW]))
_state("patch_state", "SELECT c_custkey, CASE WHEN c_custkey = 9 THEN 'Nine' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", lambda s, c: c.patch(9, {"c_name": "Nine"}))
_state("patch_moves_shard", f"SELECT {_REST}, c_acctbal, CASE WHEN c_custkey = 9 THEN 'NEW SEGMENT' ELSE c_mktsegment END AS c_mktsegment FROM customer", lambda s, c: c.patch(9, {"c_mktsegment": "NEW SEGMENT"}))
_state("delete_id_state", "SELECT * FROM customer WHERE c_custkey <> 3", lambda s, c: (c.delete(3), c.delete(-99)))
_state("delete_ids_state", "SELECT * FROM customer WHERE c_custkey NOT IN (3, 5, 8)", lambda s, c: c.delete_many([3, 5, 8, 5, -4]))
_state("query_delete_state", "SELECT * FROM customer WHERE NOT c_acctbal < 500", lambda s, c: c.find().where("c_acctbal", less_than=500).delete())
_state("query_delete_top_n", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5)",
       lambda s, c: c.find().sort("c_acctbal", ascending=False).offset(5).limit(20).delete())
_state("majority_delete_state", "SELECT * FROM customer WHERE c_custkey % 10 = 0",
       lambda s, c: c.delete_rows(c.frame().where("c_custkey % 10 <> 0")))


def _batch(s: SparkSession, c: Collection) -> None:
    one = c.get(11).asDict()

    def body(b) -> None:
        b.insert(_NEW)
        b.update({**one, "c_name": "Eleven"})
        b.upsert({"c_custkey": -2, "c_name": "Two", "c_mktsegment": "MACHINERY"})
        b.delete(12)
        b.delete(-77)

    c.write_batch(body)


_state(
    "write_batch_state",
    f"SELECT c_custkey, CASE WHEN c_custkey = 11 THEN 'Eleven' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey <> 12 UNION ALL {_NEW_SQL} UNION ALL SELECT -2, 'Two', NULL, NULL, 'MACHINERY'",
    _batch,
)


def _failed(s: SparkSession, c: Collection) -> None:
    def conflict(b) -> None:
        b.upsert(_NEW)
        b.delete(-1)

    def absent(b) -> None:
        b.insert(_NEW)
        b.update({"c_custkey": -5, "c_name": "x", "c_mktsegment": "BUILDING"})

    _ignore(lambda: c.write_batch(conflict))
    _ignore(lambda: c.write_batch(absent))
    _ignore(lambda: c.insert_many([_NEW, {**_NEW, "c_custkey": 1}]))
    _ignore(lambda: c.insert_many([_NEW, _NEW]))
    _ignore(lambda: c.patch(1, {"c_acctbal": "much"}))
    _ignore(lambda: c.update({**_NEW, "c_custkey": -6}))


_state("failed_batch_state", "SELECT * FROM customer", _failed)


def _worn(s: SparkSession, c: Collection) -> None:
    c.update_many(_bump(c, 10, 50))
    c.delete_many(range(20, 30))
    c.compact()
    c.delete(30)


_WORN = f"SELECT {_REST}, CASE WHEN c_custkey BETWEEN 10 AND 50 THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE NOT c_custkey BETWEEN 20 AND 30"
_state("compact_preserves", _WORN, _worn)
_state("compressed_state", _WORN, _worn, DatabaseOptions(compression=Compression.GZIP))


def _reopened(spark: SparkSession, sf: str, options: DatabaseOptions = DatabaseOptions()) -> DataFrame:
    db, c = _customers(spark, sf, options)
    _worn(spark, c)
    db.close()
    again = Database(spark, db.path, options)
    return again.collection("customers", _CUSTOMER, CollectionOptions("c_custkey", "c_mktsegment", ("c_acctbal",))).all()


_add("reopen_preserves", _reopened, _WORN)
_add("encrypted_round_trip", lambda s, sf: _reopened(s, sf, DatabaseOptions(encryption_key=crypto.derive_key("secret", b"salt", algorithm="hkdf"))), _WORN)
_add("partition_pruned", lambda s, sf: _customers(s, sf)[1].find().where("c_mktsegment", equal_to="MACHINERY").where("c_acctbal", greater_than=0).to_df(), "SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0")


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that stream() delivers; the rows are gathered here only to show them as a DataFrame."""
    db = _fresh(spark)
    c = db.collection("nations", "n_nationkey INT, n_name STRING, n_regionkey INT", CollectionOptions("n_nationkey", "n_regionkey"))
    c.insert_many(spark.read.parquet(f"{sf}/nation.parquet"))
    return spark.createDataFrame(list(c.stream(7)), "n_nationkey INT, n_name STRING, n_regionkey INT")


_add("stream_all", _streamed, "SELECT * FROM nation")


def _dynamic(spark: SparkSession, sf: str) -> Collection:
    """events without a schema: id, kind, value, and props as a nested document."""
    db = _fresh(spark)
    c = db.collection("events", None, CollectionOptions("id", "kind", ("value",)))
    df = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"kind":"'), F.col("event_type"), F.lit('","value":'), F.regexp_extract(F.to_json(F.struct("value")), ":(.*)}", 1), F.lit(',"props":'), F.col("props"),
                    F.when(F.col("event_id") % 3 == 0, F.lit(',"note":null')).when(F.col("event_id") % 3 == 1, F.lit(',"note":"n"')).otherwise(F.lit("")), F.lit("}"))
    c.insert_many(df.select(F.parse_json(text).alias("doc")))
    return c


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.variant_get("doc", "$.id", "bigint").alias("event_id"))


_add("dynamic_path", lambda s, sf: _ids(_dynamic(s, sf).find().where("kind", equal_to="click").where("props.k", between=(10, 60.5)).to_df()),
     "SELECT event_id FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 60")
_add("dynamic_null_is_not_missing", lambda s, sf: _ids(_dynamic(s, sf).find().where("note", equal_to=None).to_df()), "SELECT event_id FROM events WHERE event_id % 3 = 0")
_add("dynamic_exists", lambda s, sf: _ids(_dynamic(s, sf).find().where_exists("note").to_df()), "SELECT event_id FROM events WHERE event_id % 3 IN (0, 1)")
_add("dynamic_ne", lambda s, sf: _ids(_dynamic(s, sf).find().where("note", not_equal_to="n").to_df()), "SELECT event_id FROM events WHERE event_id % 3 <> 1")
_add("dynamic_sort", lambda s, sf: _ids(_dynamic(s, sf).find().sort("note").limit(200).to_df()), "SELECT event_id FROM events ORDER BY CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END, event_id LIMIT 200")


# ids and partition values of every type, and upkeep


def _by_year(spark: SparkSession, sf: str) -> Collection:
    c = _fresh(spark).collection("orders", "o_orderkey BIGINT, year TIMESTAMP", CollectionOptions("o_orderkey", "year"))
    c.insert_many(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.date_trunc("year", "o_orderdate").cast("timestamp").alias("year")))
    return c


_add("partition_timestamp", lambda s, sf: _by_year(s, sf).find().where("year", equal_to=dt.datetime(1995, 1, 1)).to_df().select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995")
_add("partition_scan_timestamp", lambda s, sf: _by_year(s, sf).scan_partition(dt.datetime(1996, 1, 1)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996")


def _extremes(spark: SparkSession, sf: str) -> DataFrame:
    values = (1e-7, 1e20, 0.5, -0.0)
    c = _fresh(spark).collection("customers", "c_custkey BIGINT, share DOUBLE", CollectionOptions("c_custkey", "share", ("share",)))
    share = F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % 4 + 1).cast("int"))
    c.insert_many(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), share.alias("share")))
    parts = [c.find().where("share", equal_to=v).to_df().select("c_custkey", F.lit(k).alias("part")) for k, v in enumerate(values)]
    return reduce(DataFrame.unionByName, parts)


_add("partition_double_extremes", _extremes, "SELECT c_custkey, (c_custkey % 4)::INT AS part FROM customer")


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    c = _fresh(spark).collection("customers", "at TIMESTAMP, c_custkey BIGINT", CollectionOptions("at"))
    c.insert_many(spark.read.parquet(f"{sf}/customer.parquet").select(F.timestamp_micros(F.col("c_custkey").cast("bigint") * 1_500_000).alias("at"), "c_custkey"))
    got = c.get(dt.datetime(1970, 1, 1, 0, 1, 3))  # 42 times 1.5 seconds
    return spark.createDataFrame([(got["c_custkey"],)], "c_custkey BIGINT")


_add("get_timestamp_id", _timed, "SELECT c_custkey FROM customer WHERE c_custkey = 42")


def _decimal(spark: SparkSession, sf: str) -> DataFrame:
    c = _fresh(spark).collection("customers", "id DECIMAL(12,2), c_custkey BIGINT", CollectionOptions("id"))
    c.insert_many(spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") + F.lit(0.5)).cast("decimal(12,2)").alias("id"), "c_custkey"))
    c.delete(Decimal("7.50"))
    c.delete_many([8.5, Decimal("9.5")])
    return c.all().select("c_custkey")


_add("delete_decimal_id_state", _decimal, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (7, 8, 9)")


def _recovered(spark: SparkSession, sf: str) -> DataFrame:
    db, c = _customers(spark, sf)
    c._write(c._frame_of([_NEW]), "rows", c._snapshot.next_seq)  # a write that dies before its commit
    again = Database(spark, db.path, DatabaseOptions(recovery_grace=0))
    d = again.collection("customers", _CUSTOMER, CollectionOptions("c_custkey", "c_mktsegment", ("c_nationkey", "c_acctbal")))
    if d.metrics().shards_recovered_from_dirty != 1:
        raise AssertionError("the leftover should have been found")
    return d.all()


_add("recover_preserves", _recovered, "SELECT * FROM customer")


def _raises(s: SparkSession, c: Collection) -> None:
    def body(b) -> None:
        b.insert(_NEW)
        raise ValueError("the caller's own error")

    try:
        c.write_batch(body)
    except ValueError:
        return
    raise AssertionError("the error should come through")


_state("batch_body_raises_state", "SELECT * FROM customer", _raises)
_state("batch_of_inserts_state", f"SELECT * FROM customer UNION ALL {_NEW_SQL}", lambda s, c: (c.write_batch(lambda b: None), c.write_batch(lambda b: b.insert(_NEW))))


def _dropped(spark: SparkSession, sf: str) -> DataFrame:
    db, _ = _customers(spark, sf)
    db.drop("customers")
    _ignore(lambda: db.drop("customers"))
    c = db.collection("customers", _CUSTOMER, CollectionOptions("c_custkey"))
    c.insert_batch(spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0"))
    return c.all()


_add("drop_and_create_state", _dropped, "SELECT * FROM customer WHERE c_acctbal > 0")


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    db, _ = _customers(spark, sf)
    db.collection("more", "id INT", CollectionOptions("id"))
    return spark.createDataFrame([(n,) for n in db.list_collections()], "name STRING")


_add("list_collections", _listed, "SELECT * FROM (VALUES ('customers'), ('more')) t(name)")


def _fragmented(spark: SparkSession, sf: str) -> DataFrame:
    db, c = _customers(spark, sf)
    c.find().where("c_custkey", between=(1, 10)).delete()
    steps = [c.needs_compaction()]
    c.delete_rows(c.frame().where("c_custkey % 3 = 0"))
    steps.append(c.needs_compaction())
    db.compact()
    return spark.createDataFrame([(*steps, c.needs_compaction(), c.count())], "few BOOLEAN, many BOOLEAN, after BOOLEAN, documents BIGINT")


# Shards of up to 100 documents are left alone: on the smallest tables nothing needs compaction.
_add("needs_compaction", _fragmented,
     "SELECT false AS few, coalesce(max(n), 0) > 100 AS many, false AS after, (SELECT count(*) FROM customer WHERE NOT c_custkey BETWEEN 1 AND 10 AND c_custkey % 3 <> 0) AS documents FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)")


def _synced(spark: SparkSession, sf: str) -> DataFrame:
    db, c = _customers(spark, sf, DatabaseOptions(auto_sync=AutoSync.after_writes(1)))
    c.delete(5)
    c.upsert(_NEW)
    again = Database(spark, db.path)  # without close: from the checkpoint
    return again.collection("customers", _CUSTOMER, CollectionOptions("c_custkey", "c_mktsegment", ("c_nationkey", "c_acctbal"))).all()


_add("auto_sync_state", _synced, f"SELECT * FROM customer WHERE c_custkey <> 5 UNION ALL {_NEW_SQL}")


def _streamed_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that stream() delivers after deletes; the rows are gathered here only to show them as a DataFrame."""
    _, c = _customers(spark, sf)
    c.delete_many([1, 2, 3])
    return spark.createDataFrame(list(c.stream(100)), _CUSTOMER)


_add("stream_after_deletes", _streamed_customers, "SELECT * FROM customer WHERE c_custkey NOT IN (1, 2, 3)")
_find("pred_not_type_mismatch", "nation", "n_nationkey", "", lambda q: q.where(~P.equal("n_nationkey", "5")))
_add("path_array_out_of_range_not", lambda s, sf: _table(s, sf, "embeddings").find().where_not_exists("embedding.64").to_df().select("vec_id"), "SELECT vec_id FROM embeddings")
_find("pred_decimal_literal", "orders", _O, "WHERE o_totalprice < 50000.1", lambda q: q.where("o_totalprice", less_than=Decimal("50000.1")))


# plans and counters

_PEOPLE = "id BIGINT, name STRING, age BIGINT, country STRING, city STRING"
PEOPLE = [
    (1, "Alice", 25, "BR", "Recife"), (2, "Bob", 30, "US", "New York"), (3, "Charlie", 65, "BR", "Recife"), (4, "David", 70, "PT", "Lisboa"),
    (5, "Eve", 25, "BR", "Olinda"), (6, "Frank", 30, "US", "Boston"),
]


def _people(spark: SparkSession, sf: str) -> Collection:
    c = _fresh(spark).collection("people", _PEOPLE, CollectionOptions("id", "country", ("age",)))
    c.insert_many(spark.createDataFrame(PEOPLE, _PEOPLE))
    return c


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    q = _people(spark, sf).find()
    plans = {
        "eq": q.where("age", equal_to=25).where("name", like="A%"), "in": q.where("age", is_in=[25]), "range": q.where("age", greater_than=20).where("country", equal_to="BR"),
        "partition": q.where("country", equal_to="BR"), "full": q.where("city", equal_to="Recife"), "none": q, "nested": q.where(P.all_of(P.equal("age", 25))),
    }
    return spark.createDataFrame([(k, str(v.explain().strategy), v.explain().residual_predicates) for k, v in plans.items()], "name STRING, strategy STRING, residual INT")


_add("explain_strategies", _explained,
     "SELECT * FROM (VALUES ('eq', 'index lookup on ''age''', 1), ('in', 'index lookup on ''age''', 0), ('range', 'index lookup on ''age''', 1), ('partition', 'partition scan of ''BR''', 1),"
     " ('full', 'full scan', 1), ('none', 'full scan', 0), ('nested', 'full scan', 1)) t(name, strategy, residual)")  # fmt: skip


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    c = _people(spark, sf)
    c.delete(6)
    s = c.stats()
    return spark.createDataFrame([(s.name, s.document_count, s.shard_count, s.indexes["age"], s.indexes["id"])], "name STRING, documents INT, shards INT, ages INT, ids INT")


_add("stats_counts", _stats, "SELECT 'people' AS name, 5 AS documents, 3 AS shards, 5 AS ages, 5 AS ids")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = _people(spark, sf)
    c.find().where("age", equal_to=25).count()
    c.find().where("age", greater_than=40).execute()
    c.find().where("country", equal_to="BR").execute()
    c.find().where("city", equal_to="Recife").execute()
    c.compact()
    m = c.metrics()
    return spark.createDataFrame([(m.index_lookups, m.covered_queries, m.partition_scans, m.full_scans, m.compaction_count)], "lookups INT, covered INT, partitions INT, scans INT, compactions INT")


_add("metrics_counters", _metrics, "SELECT 2 AS lookups, 2 AS covered, 1 AS partitions, 1 AS scans, 1 AS compactions")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, range, sort and page over orders: one scan with pushed filters and a top-k."""
    q = _table(spark, sf, "orders").find().where("o_orderstatus", equal_to="F").where("o_totalprice", between=(100000, 300000))
    return q.sort("o_totalprice", ascending=False).limit(20).to_df()
