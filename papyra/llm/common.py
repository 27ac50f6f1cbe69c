"""Helpers shared by the training-data operators.

Written tables.  Operators that read an intermediate result more than once
write it as Parquet under the folder named by ``spark.checkpoint.dir`` (shared
by all executors), so a lost executor costs a re-read, never a recompute of a
long lineage.  Only in local mode, where the setting may be absent, a temporary
folder stands in for it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, as `bytes.split()` and the contracts' [\x20\x09-\x0D] have it.
SPACE = r"\x20\x09-\x0D"
#: ASCII characters that are no letters or digits, once A-Z are lower-cased.
NON_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: bytes.translate table: A-Z to a-z, other ASCII non-alphanumerics to a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_local: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; raises where a cluster names none."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = got.get() if got.isDefined() else ""
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="papyra-")
    return f"file://{_local}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def mark_written() -> int:
    """Stands for the tables written so far."""
    return len(_written)


def forget_written(since: int = 0, but: int = 0) -> None:
    """Delete the tables written since a mark, but the last ones; results not yet computed from them are lost."""
    gone = _written[since : len(_written) - but]
    del _written[since : len(_written) - but]
    for spark, path in gone:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be reached any more
            pass


atexit.register(forget_written)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that none of df's columns has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """mapInArrow with batches small enough for very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(fn, schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: Column, modulus: int, remainder: int) -> Column:
    """True for rows whose crc32(id as text) mod modulus is remainder; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def picked(rows: DataFrame, key: Column, sample: int) -> DataFrame:
    """At most ``sample`` rows, those with the smallest 64-bit hashes (key): first by a threshold that lets about that many through,
    so that no task or driver gets more than it has to, then exactly."""
    n = rows.count()
    if n > sample:
        rows = rows.where(key < F.lit(int(-(1 << 63) + (1 << 64) * min(1.0, (sample + 6 * sample**0.5 + 30) / n)) - 1))
    return rows.orderBy(key).limit(sample)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the JVM's fast path where all of it is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; null: none."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), f"[{NON_WORD}]+"), "")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
