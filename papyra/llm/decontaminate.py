"""Benchmark decontamination: spans of test items found in training documents.

Native: DataFrame functions only.  Every document is scanned once.  A window of
10 words holds exactly one of the document's blocks of 5 words that start at
every 6th word, so only these blocks are hashed and exploded, next to one sentinel row,
which keeps documents without a hit.  A broadcast hash join against the blocks
of the benchmark's windows, at each of their 6 places, drops the rest before
any shuffle, and a hit is verified by comparing the words of the whole window.  Only rows of hits
and sentinels, without text, are then shuffled by document.  Windows of shorter items are
found in the same way with blocks of half their length.

Cases.  Null or empty text, and texts without words: no hit.  Null item texts and items
without words give no window; a null item_id hits, but is not listed.  Repeated rows stay
repeated.  An empty benchmark leaves all clean.  Columns other than those
named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import col, fresh, words

#: The benchmark's windows are broadcast up to this many; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 50_000
#: ... and up to so many bytes of words and item ids, at all their places.
BROADCAST_BYTES = 128 << 20
#: ASCII characters that are in no word, before A-Z are lower-cased.
RAW_NON_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def once(value: Column) -> Column:
    """value as a generator's output: else the optimizer copies its expression into the lambdas that use it, for every element."""
    return F.explode(F.array(value))


def _block(length: int) -> tuple[int, int]:
    """Words of a block, and the step between a document's blocks, for windows of that length.

    Any window of the document holds exactly one block that starts at a multiple of the step.
    """
    block = (length + 1) // 2
    return block, length - block + 1


def _blocks(at: Column, length: int) -> Column:
    """Hashes of the document's blocks for windows of that length."""
    block, step = _block(length)
    return F.when(
        F.size(at) >= length,
        F.transform(F.sequence(F.lit(1), F.size(at) - (block - 1), F.lit(step)), lambda i: F.xxhash64(F.slice(at, i, block))),
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """Distinct windows of the items: len int, gram array<string>, items array<string>."""
    w = benchmark.select(F.col(item_id).cast("string").alias("item"), once(words(F.col(text))).alias("w")).where(
        F.size("w") > 0
    )
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = w.select(
        "item",
        "len",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))
        ).alias("gram"),
    )
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per row of documents: doc_id, n_words, spans (array of struct first, last: word
    numbers from 1), items (sorted array of item ids as text)."""
    grams = benchmark_windows(benchmark, item_id, item_text, n)
    bytes_ = F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", ","))
    found = grams.groupBy("len").agg(F.count(F.lit(1)).alias("k"), F.sum(bytes_).alias("bytes")).collect()  # n rows at most
    sizes = {r["len"]: r["k"] for r in found}
    lengths = [n, *sorted(k for k in sizes if k != n)]
    few = sum(sizes.values()) <= broadcast_windows and sum(r["bytes"] for r in found) * _block(n)[1] <= BROADCAST_BYTES

    docs = documents.select(
        col(doc_id).alias("d"), F.xxhash64(col(text)).alias("t"), once(words(col(text))).alias("w")
    ).withColumn("nw", F.size("w"))
    docs = docs.withColumn("hs", F.concat(F.array(F.lit(0).cast("bigint")), *(_blocks(F.col("w"), k) for k in lengths)))
    rows = docs.select("d", "t", "nw", "w", F.posexplode_outer("hs").alias("p", "h"))  # never empty; outer: no filter that computes it twice
    # p = 0: the sentinel; then the blocks for each length in turn.
    length, at, start = F.lit(0), F.lit(1), F.lit(1)
    offsets = []
    for k in lengths:
        block, step = _block(k)
        count = F.when(F.col("nw") >= k, F.expr(f"(nw - {block}) DIV {step} + 1").cast("int")).otherwise(F.lit(0))
        inside = (F.col("p") >= start) & (F.col("p") < start + count)
        length, at = F.when(inside, k).otherwise(length), F.when(inside, (F.col("p") - start) * step + 1).otherwise(at)
        start = start + count
        offsets.append(
            grams.where(F.col("len") == k)
            .select(F.col("len").alias("b_len"), F.col("gram").alias("b_gram"), "items", F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("off"))
            .withColumn("b_h", F.xxhash64(F.slice("b_gram", F.col("off") + 1, block)))
        )
    none = F.array().cast("array<string>")
    lookup = offsets[0]
    for more in offsets[1:]:
        lookup = lookup.unionByName(more)
    first = at - F.col("off")
    if few:
        sentinel = documents.sparkSession.range(1).select(
            F.lit(0).alias("b_len"), none.alias("b_gram"), none.alias("items"), F.lit(0).alias("off"), F.lit(0).cast("bigint").alias("b_h")
        )
        lookup = lookup.unionByName(sentinel)
        found = F.slice("w", F.greatest(first, F.lit(1)), length)
        # Inequalities, as equalities would become join keys, computed for every row and not only for hits.
        verified = (length <= F.col("b_len")) & (length >= F.col("b_len")) & (first >= 1) & (found <= F.col("b_gram")) & (found >= F.col("b_gram"))
        joined = rows.join(F.broadcast(lookup), (rows.h == lookup.b_h) & verified).select(
            "d", "t", "nw", first.alias("first"), length.alias("len"), "items"
        )
    else:
        # The words that a window with this block can hold go along.  The sentinels of all documents share one key, so they go round the join.
        lo = F.greatest(at - length, F.lit(1))
        keyed = rows.select("d", "t", "nw", "h", at.alias("at"), length.alias("len"), lo.alias("lo"), F.slice("w", lo, at + length - lo).alias("near"))
        first = F.col("at") - F.col("off")
        found = F.slice("near", F.greatest(first - F.col("lo") + 1, F.lit(1)), F.col("len"))
        hits = keyed.where("len > 0").join(lookup.hint("merge"), (F.col("h") == F.col("b_h")) & (F.col("len") == F.col("b_len"))).where(
            (first >= 1) & (found <= F.col("b_gram")) & (found >= F.col("b_gram"))
        )
        joined = hits.select("d", "t", "nw", first.alias("first"), "len", "items").unionByName(
            keyed.where("len = 0").select("d", "t", "nw", F.lit(1).alias("first"), "len", none.alias("items"))
        )
    span = F.when(F.col("len") > 0, F.struct(F.col("first"), (F.col("first") + F.col("len") - 1).alias("last")))
    by = joined.groupBy("d", "t", "nw").agg(
        F.count(F.when(F.col("len") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("len") > 0, F.col("items")))))).alias("items"),
    )
    return by.select(
        F.col("d").alias("doc_id"),
        F.col("nw").alias("n_words"),
        "spans",
        "items",
        F.col("t").alias("text_hash"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies").cast("int"), F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["last"]).alias("end"),
            (a["n"] + F.greatest(x["last"] - F.greatest(a["end"], x["first"] - 1), F.lit(0))).alias("n"),
        ),
    )
    return done["n"]


def leak_report(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per row of documents."""
    found = find_leaks(documents, benchmark, **names)
    n_hit = _covered(F.col("spans"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", doc_id: str = "doc_id", **names) -> DataFrame:
    """documents without what the benchmark holds: whole documents, or only the ``spans`` hit.

    A removed word takes the separators after it along.  All columns are kept as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    id_, hash_, spans, p, lead_ = fresh(documents, "id_", "hash_", "spans_", "pieces_", "lead_")
    leaks = (
        find_leaks(documents, benchmark, doc_id=doc_id, text=text, **names)
        .where(F.size("spans") > 0)
        .select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans))
        .dropDuplicates([id_, hash_])
    )
    same = col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(col(text)) == F.col(hash_))
    if remove == "documents":
        return documents.join(leaks.select(id_, hash_), same, "left_anti")
    pieces = F.regexp_extract_all(col(text), F.lit(f"[{RAW_NON_WORD}]+|[^{RAW_NON_WORD}]+"), F.lit(0))
    lead = F.when(F.element_at(p, 1).rlike(f"^[^{RAW_NON_WORD}]"), F.lit(0)).otherwise(F.lit(1))
    number = lambda i: F.floor((i - F.col(lead_)) / 2) + 1  # noqa: E731 - a separator counts with the word before it
    cut = F.filter(p, lambda _, i: ~F.exists(spans, lambda s: number(i).between(s["first"], s["last"])))
    joined = documents.join(leaks, same, "left").select("*", once(F.when(F.size(spans) > 0, pieces)).alias(p)).withColumn(lead_, lead)
    left = F.when(F.col(p).isNotNull(), F.array_join(cut, "")).otherwise(col(text))
    return joined.select(*((left if c == text else col(c)).alias(c) for c in documents.columns))
