"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import forget_written, load, mark_written, written
from papyra.llm.decontaminate import decontaminate
from papyra.llm.lines import drop_lines
from papyra.llm.mixing import mix
from papyra.llm.neardup import keep_one
from papyra.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored like all others.  Without usable labels of both kinds there is no model, and all stay.
    """
    return keep_quality(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across them; n_chars follows the text.

    A null text stays null and keeps its n_chars; a document that loses all its lines stays with an empty text.  Rows with a null doc_id lose nothing.
    """
    kept = drop_lines(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast(kept.schema["n_chars"].dataType), F.col("n_chars")))
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Documents without words (null, empty) all stay.  Of rows that repeat an id or a text one stays, always the same one.
    """
    return keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts stay; an empty benchmark removes nothing.
    """
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: a row for each.

    A null source is one of its own; a null text has no words, so none are taken.
    """
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: The fitted classifier and the sampled similarity have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, mark = load(spark, sf_dir, "documents"), mark_written()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        forget_written(mark, but=1)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
