"""The pipeline against its stages done by brute force."""

from __future__ import annotations

import random

from pyspark.sql import types as T

import corpus_pipeline
from papyra.llm.common import written
from papyra.llm.decontaminate import decontaminate
from papyra.llm.lines import drop_lines, line_bitmaps
from papyra.llm.neardup import keep_one
from papyra.llm.quality import quality_scores
from tests.llm.helpers import COLUMNS, empty, row
from tests.llm.test_operators import brute_classes, brute_leaks, brute_lines, brute_mix, plain, sample_rows


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark_leaks", "source_mix"]


def test_run_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    good = sample_rows(50, seed=8)
    junk = [row(700 + i, " ".join(f"{w.upper()}!!" for w in good[i][1].split())) for i in range(25)]
    copies = [row(800 + i, good[i][1] + " tail") for i in range(6)] + [row(806, good[9][1])]
    shared = "a boilerplate line that many documents hold"
    rows = [(d, t + "\n" + shared if i % 5 == 0 else t, *rest) for i, (d, t, *rest) in enumerate(good)] + junk + copies + [row(1, None), row(None, good[3][1] + " more words here")]
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r in good), 0) for r in good + junk if rng.random() < 0.8], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    leak = " ".join(good[12][1].split()[:12])
    spark.createDataFrame([(1, leak)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert sum(r["predicted"] == 0 for r in scores.collect()) >= 20
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = plain(now) if name != "source_mix" else [(r["doc_id"], r["text"], r["source"]) for r in now.collect()], stage(spark, now, str(tmp_path)).cache()
        steps[name] = before
        if name != "source_mix":
            assert now.columns == docs.columns
        if name == "quality":
            assert now.count() == scores.where("predicted = 1").count()
        elif name == "lines":
            import hashlib

            got = sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in plain(now))
            assert got == sorted((d, h) for d, _, _, h in brute_lines(before)) and sum(n for _, _, n, _ in brute_lines(before)) > 3
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect() if r["text"] is not None)
        elif name == "near_duplicates":
            _, _, members = brute_classes(before)
            assert now.count() == len(members) < len(before)
        elif name == "benchmark_leaks":
            assert now.count() == sum(not r[-1] for r in brute_leaks(before, [(1, leak)])) < len(before)
    size, total, target = brute_mix(steps["source_mix"])
    assert sorted((str(r["doc_id"]), r["size"]) for r in now.collect()) == sorted((str(d), n) for (d, _, _), n in zip(steps["source_mix"], size))
    whole = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(str, now.collect()))


def stages(spark, docs, folder, labels=(), benchmark=()):
    """Each stage's rows, as it goes on from the one before."""
    spark.createDataFrame(list(labels), "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id BIGINT, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(folder)), name)
        out[name] = docs
    return out


def test_empty_tables(spark, tmp_path):
    for name, df in stages(spark, empty(spark), tmp_path).items():
        assert df.count() == 0, name


def test_texts_without_words_all_stay(spark, tmp_path):
    rows = [row(1, None), row(1, None), row(2, ""), row(None, None), row(None, None, None, None), row(3, " ,. "), row(3, " ,. ")]
    for repeat in ([], [row(9, "five words that repeat here")] * 2):
        folder = tmp_path / str(len(repeat))
        got = stages(spark, spark.createDataFrame(rows + repeat, COLUMNS), folder)["benchmark_leaks"].collect()
        assert len(got) == len(rows) + bool(repeat)
    assert keep_one(spark.createDataFrame([(1, None), (1, None), (2, "x")], "doc_id INT, text STRING")).count() == 3


def test_repeats_keep_the_same_row(spark):
    rows = [row(5, "one two three four five six", "en", s) for s in ("b", "a", "c", "a")] + [row(7, "one two three four five six", "en", "z"), row(None, "one two three four five six")]
    got = [keep_one(spark.createDataFrame(rows[i:] + rows[:i], COLUMNS).repartition(3)).collect() for i in (0, 2, 5)]
    assert [len(x) for x in got] == [1] * 3 and len({str(x) for x in got}) == 1 and got[0][0]["doc_id"] == 5


def test_columns_that_clash(spark, tmp_path):
    names = ["__id", "__t", "__u", "__spans", "__p", "__row", "id_", "hash_", "text_", "other_", "many_", "row", "keys", "n", "kept", "x.y", "b`c", "spans_", "pieces_"]
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, t, "en", "s", 0, *["v"] * len(names)) for i, t in enumerate([text, "other words are quite clean and stay here as they were", text + " nu", None, "and a third one, of words that no other has, to keep"])]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])
    docs = spark.createDataFrame(rows, schema)
    steps = stages(spark, docs, tmp_path, benchmark=[(1, " ".join(text.split()[:11]))])
    assert steps["benchmark_leaks"].columns == docs.columns and sorted(r[0] for r in steps["benchmark_leaks"].collect()) == [1, 3, 4]
    assert steps["source_mix"].count() == 3
    cut = decontaminate(docs, spark.createDataFrame([(1, text)], "item_id INT, text STRING"), remove="spans")
    assert cut.columns == docs.columns and [r["text"] for r in cut.where("doc_id IN (0, 2)").orderBy("doc_id").collect()] == ["", "nu"]


def test_string_ids(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(c, f"{line}\nown {c}") for c in "abcd"] + [(None, line)], "doc_id STRING, text STRING")
    assert {r["doc_id"]: r["text"] for r in drop_lines(docs).collect()} == {"a": "own a", "b": "own b", "c": "own c", "d": f"{line}\nown d", None: line}
    assert sorted((r["doc_id"] or "", r["n_dropped"], r["keep_bits"]) for r in line_bitmaps(docs, plain=True).collect()) == [("", 0, "1"), ("a", 1, "01"), ("b", 1, "01"), ("c", 1, "01"), ("d", 0, "11")]


def test_run_leaves_one_table(spark, tmp_path):
    from papyra.llm import common

    spark.createDataFrame(sample_rows(20), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    stages(spark, empty(spark), tmp_path)
    before = common.mark_written()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < got.count() <= 20 and common.mark_written() - before <= 3  # the last stage's input, and its own two
