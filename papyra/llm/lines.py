"""Line dedup: boilerplate lines that recur across documents.

Lines become hash rows (128-bit key hash, doc_id), one per document and key, and no text
leaves the first scan.  The rows are range-partitioned by hash, sorted by hash and then
document, largest first, and streamed: the first document of a run keeps the
line, the others lose it once the run has reached enough documents.  A key so
frequent that it would fill a large part of a range is found by a pre-aggregated count;
such keys number at most twice the partitions, and for them the same verdict (how many documents,
the largest one) comes from partial aggregates instead of one run.  The result is a
compressed keep bitmap for every document.

Cases.  Null or empty text: one empty line, kept.  Rows with a null doc_id
neither count nor lose lines.  Rows that repeat a doc_id are the same document:
they count once and lose the same keys.  Ids that are no whole numbers are ordered as Spark orders them,
and their keys are all decided by partial aggregates.  Keys are compared by 128-bit hash.  Text that is not
split, however long, is handled row by row.  Columns other than those named are
ignored.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import col, map_arrow, partitions, text_bytes, written

STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit key hash of a line; None if the key is too short to count."""
    k = line.strip(STRIP).lower()
    if len(k) < min_chars or (not k.isascii() and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def _key_rows(min_chars: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                if d is None:
                    continue
                own = {k for x in t.split(b"\n") if (k := line_key(x, min_chars)) is not None}
                keys += own
                ids += [d] * len(own)
            h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, kind)], names=["h1", "h2", "d"])

    return run


def _losers(min_docs: int):
    """Streams rows sorted by (h1, h2, d descending); yields those that lose the line.

    Between batches it carries the first min_docs documents of the open run, no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1 = c2 = cd = np.empty(0, np.int64)
        out = False  # the carried losers have been emitted
        for b in batches:
            n = len(c1)
            h1, h2, d = (np.concatenate([c, b.column(i).to_numpy()]) for i, c in enumerate((c1, c2, cd)))
            if not len(d):
                continue
            new = np.ones(len(d), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            step = new.copy()
            step[1:] |= d[1:] != d[:-1]
            begin = np.flatnonzero(new)
            run_no = np.cumsum(new) - 1
            rank = np.cumsum(step) - 1
            rank -= rank[begin][run_no]  # 0: the run's largest document
            count = np.append(rank[begin[1:] - 1], rank[-1]) + 1
            lose = (rank > 0) & (count[run_no] >= min_docs)
            if out and n:
                lose[:n] = False
            yield pa.RecordBatch.from_arrays([pa.array(h1[lose]), pa.array(h2[lose]), pa.array(d[lose])], names=["h1", "h2", "d"])
            same = out and begin[-1] == 0
            tail = np.flatnonzero(step[begin[-1] :])[:min_docs] + begin[-1]
            c1, c2, cd, out = h1[tail], h2[tail], d[tail], same or bool(count[-1] >= min_docs)

    return run


def losing_keys(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id and the sorted key hashes (16 bytes each, joined) that it loses; documents that lose none are absent."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    docs = documents.select(_id(documents, doc_id).alias("d"), col(text).alias("t"))
    kind = docs.schema["d"].dataType
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("d", kind)])
    rows = written(map_arrow(docs, _key_rows(min_chars, to_arrow_type(kind)), schema), "line-keys")
    if not isinstance(kind, T.LongType):  # ids that are no numbers: the stream compares whole numbers only
        return _gathered(rows.join(_verdict(rows, min_docs), ["h1", "h2"]).where("d < keeper").select("h1", "h2", "d"))
    n = partitions(rows)
    total = rows.count()
    counts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") * (2 * n) > max(total, 1)).select("h1", "h2")  # 2n keys at most
    hot = spark.createDataFrame(hot.collect(), "h1 bigint, h2 bigint")
    cold = rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    streamed = cold.repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", F.col("d").desc())
    lost = map_arrow(streamed, _losers(min_docs), "h1 bigint, h2 bigint, d bigint")
    busy = rows.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    lost = lost.unionByName(busy.join(F.broadcast(_verdict(busy, min_docs)), ["h1", "h2"]).where("d < keeper").select("h1", "h2", "d"))
    return _gathered(lost)


def _id(documents: DataFrame, doc_id: str) -> Column:
    """Ids as they are; whole numbers of any size as bigint."""
    own = col(doc_id)
    return own.cast("bigint") if isinstance(documents.select(own).schema[0].dataType, (T.ByteType, T.ShortType, T.IntegerType)) else own


def _verdict(rows: DataFrame, min_docs: int) -> DataFrame:
    """Keys in enough documents, with the largest."""
    by = rows.groupBy("h1", "h2", "d").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
    return by.agg(F.count("d").alias("docs"), F.max("d").alias("keeper")).where(F.col("docs") >= min_docs)


def _gathered(lost: DataFrame) -> DataFrame:
    return lost.groupBy("d").agg(F.collect_set(F.struct("h1", "h2")).alias("keys")).select(F.col("d").alias("doc_id"), "keys")


def _apply(min_chars: int, whole: bool, plain: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lost = b.column(b.num_columns - 1)
            out: dict[str, list] = {"n_lines": [], "n_dropped": [], "keep": [], "sha": [], "text": [], "bits": []}
            flat = lost.values if hasattr(lost, "values") else lost
            h = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], 1).astype("<i8") if len(flat) else np.empty((0, 2), "<i8")
            ends = lost.offsets.to_numpy()
            for i, t in enumerate(text_bytes(b.column(1))):
                lines = t.split(b"\n")
                dropped = {x.tobytes() for x in h[ends[i] : ends[i + 1]]} if lost[i].is_valid else set()
                if dropped:
                    keep = [line_key(x, min_chars) not in dropped for x in lines]
                    t = b"\n".join(x for x, k in zip(lines, keep) if k)
                    out["n_dropped"].append(len(lines) - sum(keep))
                else:
                    keep = np.ones(len(lines), bool)
                    out["n_dropped"].append(0)
                bits = np.packbits(keep).tobytes()
                if plain:
                    out["bits"].append((np.asarray(keep, np.uint8) + 48).tobytes().decode())
                out["n_lines"].append(len(lines))
                out["keep"].append(zlib.compress(bits, 1))
                out["sha"].append(hashlib.sha256(t).hexdigest())
                if whole:
                    out["text"].append(t)
            cols = [b.column(0), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["keep"], pa.binary()), pa.array(out["sha"], pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"]
            if whole:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns - 1)), cols[2], pa.array(out["text"], pa.binary()).cast(pa.string())], names=["row", "n", "kept"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out["bits"], pa.string())] if plain else cols, names=[*names, "keep_bits"] if plain else names)

    return run


def line_bitmaps(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, plain: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_bitmap (zlib over one bit a line, first line first, 1: stays), kept_sha256.  plain: keep_bits too, the bits as text."""
    lost = losing_keys(documents, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs)
    docs = documents.select(_id(documents, doc_id).alias("doc_id"), col(text).alias("text"))
    joined = docs.join(lost.hint("shuffle_hash"), "doc_id", "left")
    out = T.StructType.fromDDL("n_lines bigint, n_dropped bigint, keep_bitmap binary, kept_sha256 string" + ", keep_bits string" * plain)
    return map_arrow(joined, _apply(min_chars, False, plain), T.StructType([docs.schema["doc_id"], *out]))


def drop_lines(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """documents with those lines dropped; a text that loses nothing stays as it was, null included."""
    lost = losing_keys(documents, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs)
    docs = documents.select(_id(documents, doc_id).alias("id"), col(text).alias("text"), F.struct(*map(col, documents.columns)).alias("row"))
    lost = lost.select(F.col("doc_id").alias("lost"), "keys")
    joined = docs.join(lost.hint("shuffle_hash"), F.col("id") == F.col("lost"), "left").select("id", "text", "row", "keys")
    out = T.StructType([docs.schema["row"], T.StructField("n", T.LongType()), T.StructField("kept", T.StringType())])
    done = map_arrow(joined, _apply(min_chars, True), out)
    kept = F.when(F.col("n") > 0, F.col("kept")).otherwise(F.col("row")[text])
    return done.select(*((kept if c == text else F.col("row")[c]).alias(c) for c in documents.columns))
