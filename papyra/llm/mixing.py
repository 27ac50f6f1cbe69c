"""Mixing sources to target weights: capped water-filling and seeded repetition.

Native: DataFrame functions only.  Texts are read once, to count words; the
counts, without text, are written to the shared folder.  Sources are filled in
closed form: sorted by cap over weight, a source is clamped as long as its cap
is below what the rest would give it, which is where proportional reshares end.
A target is met by whole repetitions of every document and one more of those
that come first in an order by seeded hash, the last of them in part.  That
order is found by a histogram of hash prefixes, so no source, however large, is
sorted in one task: windows are over (source, prefix).

Cases.  Null text: size 0.  A null source is a source of its own, the last in
order.  Null ids hash as empty text.  Sources of size 0 get a target of 0.  Repeated
rows count each.  No rows: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.llm.common import SPACE, written

#: Hex digits of the hash that make a bucket: 4096 for each source.
PREFIX = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def sized(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, source, size, u (seeded hash), b (its prefix), written without the texts."""
    u = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return written(
        documents.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), u.alias("u")
        ).withColumn("b", F.substring("u", 1, PREFIX)),
        "sizes",
    )


def water_fill(totals: DataFrame, *, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets of sources.  totals: source, total (one row per source).  Adds weight and target.

    The windows without a key run over one row per source, never over documents: one task sorts them,
    so sources are to be named collections (thousands, not one for each page).
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = totals.withColumn("weight", w.cast("bigint"))
    fill = W.orderBy(F.col("total") / F.col("weight"), F.col("source").asc_nulls_first())
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    t = t.withColumn("left", F.sum("total").over(W.partitionBy()) - F.coalesce(F.sum(F.col("total") * cap).over(before), F.lit(0)))
    t = t.withColumn("of", F.sum("weight").over(after))
    t = t.withColumn("clamped", F.col("total") * cap * F.col("of") <= F.col("left") * F.col("weight"))
    # The first that isn't clamped sets the level of all after it.
    free = F.when(~F.col("clamped"), F.struct((F.col("total") / F.col("weight")).alias("k"), F.col("source").alias("s"), "left", "of"))
    t = t.withColumn("level", F.first(free, ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.currentRow)))
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.of").cast("double")
    target = F.when(F.col("level").isNull(), (F.col("total") * cap).cast("double")).otherwise(share)
    return t.select("source", "total", "weight", target.alias("target"))


def mix(documents: DataFrame, *, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), **names) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of documents."""
    docs = sized(documents, **names)
    buckets = docs.groupBy("source", "b").agg(F.sum("size").alias("in_bucket"))
    targets = water_fill(docs.groupBy("source").agg(F.sum("size").alias("total")), cap=cap, weights=weights)
    goal = F.floor(F.col("target") + 0.5).cast("bigint")
    targets = targets.withColumn("whole", F.when(F.col("total") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) DIV total")).otherwise(F.lit(0).cast("bigint")))
    targets = written(targets.withColumn("rest", goal - F.col("whole") * F.col("total")), "targets")  # a row for each source; read twice below
    # The bucket in which the rest runs out, and what the buckets before it hold.
    run = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = buckets.withColumn("upto", F.sum("in_bucket").over(run)).select(F.col("source").alias("bs"), "b", "in_bucket", "upto")
    cut = (
        upto.join(targets, F.col("bs").eqNullSafe(F.col("source")))
        .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("in_bucket") < F.col("rest")))
        .groupBy("source")
        .agg(F.min("b").alias("cut"), F.min(F.col("upto") - F.col("in_bucket")).alias("base"))
        .select(F.col("source").alias("cs"), "cut", "base")
    )
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left").select(
        F.col("source").alias("ps"), F.col("total").alias("source_size"), "target", "whole", "rest", "cut", "base"
    )
    inside = W.partitionBy("source", "b").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = docs.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = ranked.join(plan, F.col("source").eqNullSafe(F.col("ps")))
    here = F.col("rest") - F.col("base") - F.col("ahead")
    more = (
        F.when(F.col("cut").isNull(), F.lit(0))
        .when(F.col("b") < F.col("cut"), F.col("size"))
        .when(F.col("b") == F.col("cut"), F.least(F.greatest(here, F.lit(0)), F.col("size")))
        .otherwise(F.lit(0))
    )
    return both.select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("bigint").alias("taken")
    )
