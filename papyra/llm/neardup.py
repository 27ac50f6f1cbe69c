"""Near-duplicate documents by weighted MinHash.

Shingles are five consecutive words (a text of fewer is one shingle), weighted by
count times inverse document frequency; document frequencies are counted over all documents by shingle:
texts are packed in blocks, a block sends its distinct hashes to shards, and a shard answers with the frequencies.  Texts with the same shingles are one node.  Improved
consistent weighted sampling gives each node BANDS x ROWS samples; nodes that agree on all
samples of a band share a bucket.  Candidates are verified by weighted Jaccard similarity on the full shingle sets.

Buckets are never expanded into pairs.  A bucket's members, with their shingles, go to one task, or in chunks of
about GROUP to several; there a member is compared with those that aren't in its component
yet, through an index of the chunk's shingles, and only links that join components come out.  A few bands go first, and buckets
that they leave in one component aren't looked at again.  In buckets of several chunks, members outside the largest
component are then copied to every chunk and compared with all of it, in rounds of twice as many each, until no bucket
holds two components.  So each two nodes of a bucket have been compared, or were in one component already.
Components come from distributed star contraction.

Cases.  Null texts and texts without words are alone in their class.  Null ids: such a row belongs
to its text's class, which is named by the smallest id that isn't null, if any.  Repeated rows fall
in one class.  Very long texts are sampled in pieces, whole.  Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from papyra.llm.blocks import Numbers, numbered, unzipped, unzipped_words, zipped, zipped_words
from papyra.llm.common import WORD_TABLE, col, fresh, map_arrow, partitions, text_bytes, written
from papyra.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
#: Bands are handled in these steps.
STEPS = (0, 1, 4, BANDS)
#: Members of a bucket in one task, about.
GROUP = 512
BLOCK_BYTES = 4 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their counts."""
    h = np.sort(h)
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[heads], np.diff(np.append(heads, len(h)))


def _hashed(w: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words, from the words' hashes."""
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _PRIME + w[i : len(w) - k + 1 + i]
    return _mix(h)


def sets_of(types: list[bytes], at: np.ndarray, ends: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted 64-bit shingle hashes of each text and their counts.  types: words; at: the words of all texts, by number; ends: of each text."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, types), np.uint64, len(types))[at]
    runs = _hashed(w, SHINGLE) if len(w) >= SHINGLE else np.empty(0, np.uint64)
    out = []
    for a, b in zip([0, *ends[:-1]], ends):
        k = min(SHINGLE, b - a)
        out.append(_distinct(runs[a : b - SHINGLE + 1] if k == SHINGLE else _hashed(w[a:b], k) if k else np.empty(0, np.uint64)))
    return out


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit shingle hashes of a text and their counts."""
    words = text.translate(WORD_TABLE).split()
    return sets_of(words, np.arange(len(words)), [len(words)])[0]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
    ln_c = np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
    return r, ln_c, (np.arange(1 << 16, dtype=np.float32) + 0.5) / (1 << 16)


_R, _LN_C, _BETA = _tables()
_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None] | np.uint64(1)


def samples(h: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
    """BANDS x ROWS improved consistent weighted samples of a set of hashes with log weights."""
    n = len(_SEEDS)
    best, sig = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
    every = np.arange(n)
    for i in range(0, len(h), 1024):
        some = h[i : i + 1024].astype(np.uint64)
        x = (some * np.uint64(0xD6E8FEB86659FD93) + _PRIME) * _SEEDS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        r, beta = _R[(x >> np.uint64(48)).astype(np.int32)], _BETA[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)]
        t = np.floor(ln_w[i : i + 1024] / r + beta)
        a = _LN_C[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - beta) - r
        at = a.argmin(1)
        low = a[every, at]
        new = low < best
        best[new] = low[new]
        sig[new] = (_mix(some[at] * _PRIME + t[every, at].astype(np.int64).astype(np.uint64)))[new]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    b = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = key * _PRIME + b[:, i]
    return _mix(key).view(np.int64)


def _packed(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh_block() -> tuple:
            return [], [], [], Numbers(), [], []

        (ids, ts, us, types, at, ends), size, k = fresh_block(), 0, 0

        def block() -> pa.RecordBatch:
            words = np.concatenate(at)
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([ids], pa.list_(kind)), pa.array([ts], pa.list_(pa.int64())), pa.array([us], pa.list_(pa.int64())),
                 pa.array([zipped_words(types)], pa.binary()), pa.array([zipped(words)], pa.binary()), pa.array([ends], pa.list_(pa.int64()))],
                names=["block", "ids", "ts", "us", "types", "at", "ends"],
            )

        for b in batches:
            for i, h, u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), text_bytes(b.column(3))):
                if ids and size + len(t) > BLOCK_BYTES:
                    yield block()
                    (ids, ts, us, types, at, ends), size, k = fresh_block(), 0, k + 1
                words = t.translate(WORD_TABLE).split()
                at.append(np.fromiter(map(types.__getitem__, words), np.uint32, len(words)))
                ids.append(i), ts.append(h), us.append(u), ends.append((ends[-1] if ends else 0) + len(words))
                size += len(t)
        if ids:
            yield block()

    return run


def _sets(types: bytes, at: bytes, ends: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    return sets_of(unzipped_words(types), unzipped(at, np.uint32), ends)


def _asked(bits: int):
    """For each block and shard (top bits of the hash) a row: the block's distinct shingles, and in how many of its texts each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, types, at, ends in zip(*(b.column(i).to_pylist() for i in range(4))):
                h, n = _distinct(np.concatenate([h for h, _ in _sets(types, at, ends)]))
                cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                for shard in np.flatnonzero(np.diff(cut)):
                    own = slice(cut[shard], cut[shard + 1])
                    row = (zipped(np.diff(h[own], prepend=np.uint64(int(shard) << (64 - bits)))), zipped(n[own].astype(np.uint32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["shard", "block", "h", "n"]
                    )

    return run


def _answered(bits: int):
    """Rows sorted by shard: each block's frequencies become the corpus's."""

    def answers(shard: int, rows: list) -> Iterator[pa.RecordBatch]:
        base = np.uint64(shard << (64 - bits))
        every = [np.cumsum(unzipped(h, np.uint64), dtype=np.uint64) + base for _, h, _ in rows]
        size = [len(h) for h in every]
        keys, at = numbered(np.concatenate(every))
        del every
        total = np.bincount(at, np.concatenate([unzipped(n, np.uint32) for _, _, n in rows]), len(keys)).astype(np.int64)
        done = 0
        for (block, *_), n in zip(rows, size):
            c = zipped(total[at[done : done + n]])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([c], pa.binary())], names=["block", "shard", "c"])
            done += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for shard, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if shard != now and rows:
                    yield from answers(now, rows)
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield from answers(now, rows)

    return run


def _counted(docs: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of texts, each with the document frequencies of its distinct shingles in the order of their hashes; and the number of documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    blocks = written(map_arrow(docs, _packed(to_arrow_type(kind)), f"block bigint, ids array<{kind.simpleString()}>, ts array<bigint>, us array<bigint>, types binary, at binary, ends array<bigint>"), "blocks")
    many, rows = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ends")), F.lit(0))).first()
    bits = min(16, max(3, (many // 4).bit_length()))
    asked = map_arrow(blocks.select("block", "types", "at", "ends"), _asked(bits), "shard int, block bigint, h binary, n binary")
    asked = asked.repartition(max(1, min(1 << bits, 4 * partitions(blocks))), "shard").sortWithinPartitions("shard")
    answers = map_arrow(asked, _answered(bits), "block bigint, shard int, c binary")
    lists = written(answers.groupBy("block").agg(F.collect_list(F.struct("shard", "c")).alias("known")), "frequencies")  # a block's shingles: bounded by its size
    return blocks.join(lists.hint("shuffle_hash"), "block", "left"), rows


def _weighted(types: bytes, at: bytes, ends: list[int], known: list[dict] | None, docs: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, counts and weights of each text of a block."""
    sets = _sets(types, at, ends)
    every, place = numbered(np.concatenate([h for h, _ in sets]))
    parts = [unzipped(x["c"], np.int64) for x in sorted(known or [], key=lambda x: x["shard"])]
    idf = np.log1p(docs / np.concatenate([np.empty(0, np.int64), *parts])).astype(np.float32) + np.float32(0.1)
    weight = np.take(idf, place) if len(every) else np.empty(0, np.float32)
    out, done = [], 0
    for h, n in sets:
        out.append((h, n, n.astype(np.float32) * weight[done : done + len(h)]))
        done += len(h)
    return out


def _signatures(kind: pa.DataType, docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, ids, ts, us, types, at, ends, known = (b.column(j)[i].as_py() for j in range(8))
                fp, bands = [], []
                for h, n, w in _weighted(types, at, ends, known, docs):
                    if not len(h):
                        fp.append(None), bands.append(None)
                        continue
                    fp.append(xxhash.xxh3_64_intdigest(h.tobytes() + n.tobytes()) - (1 << 63))
                    bands.append(band_keys(samples(h, np.log(w).astype(np.float32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), pa.array(ts, pa.int64()), pa.array(us, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32())],
                    names=["doc_id", "t", "u", "fp", "bands", "block", "at"],
                )

    return run


def _features(docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                types, at, ends, known, wanted = (b.column(j)[i].as_py() for j in range(5))
                sets = _weighted(types, at, ends, known, docs)
                got = [(x["fp"], sets[x["at"]][0].tobytes(), sets[x["at"]][2].tobytes()) for x in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got), (pa.int64(), pa.binary(), pa.binary()))], names=["fp", "h", "w"])

    return run


def _one(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32)


def jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets with sorted hashes."""
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    both = np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64)
    return float(both / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both))


def linked(fps: list[int], roots: list[int], leads: list[bool], sets: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of a group: each leader is compared with all members that aren't in its component yet."""
    n = len(fps)
    _, label = np.unique(np.array(roots), return_inverse=True)
    h, w = np.concatenate([x for x, _ in sets]), np.concatenate([x for _, x in sets]).astype(np.float64)
    owner = np.repeat(np.arange(n), [len(x) for x, _ in sets])
    total = np.bincount(owner, w, n)
    by = np.argsort(h, kind="stable")
    h, w, owner = h[by], w[by], owner[by]
    out = []
    done = np.zeros(n, bool)
    for i in np.flatnonzero(leads):
        done[i] = True
        other = (label != label[i]) & ~done
        if not other.any():
            continue
        own, weight = sets[i]
        lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
        count = hi - lo
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(owner[at], np.minimum(np.repeat(weight.astype(np.float64), count), w[at]), n)
        near = np.flatnonzero(other & (both >= (similarity - 1e-9) * (total[i] + total - both)))
        for j in near:
            if label[j] != label[i]:
                out.append((fps[i], fps[j]))
                label[label == label[j]] = label[i]
    return out


def _linked_groups(similarity: float):
    """Streams rows sorted by group; a group has about GROUP members and its leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def links() -> pa.RecordBatch:
            seen = {}
            for fp, root, lead, h, w in rows:  # a leader is also among the members of one chunk
                if fp not in seen or lead:
                    seen[fp] = (root, lead, h, w)
            got = linked(
                list(seen), [x[0] for x in seen.values()], [x[1] for x in seen.values()], [_one(x[2], x[3]) for x in seen.values()], similarity
            )
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

        for b in batches:
            for bucket, chunk, *row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (bucket, chunk) != key and rows:
                    yield links()
                    rows = []
                key = (bucket, chunk)
                rows.append(row)
        if rows:
            yield links()

    return run


def _links(rows: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """rows: bucket, chunk, fp, root, lead.  The links that each group's leaders have."""
    own = features.withColumnRenamed("fp", "f")
    full = rows.join(own, F.col("fp") == F.col("f")).select("bucket", "chunk", "fp", "root", "lead", "h", "w")
    grouped = full.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk")
    return written(map_arrow(grouped, _linked_groups(similarity), "a bigint, b bigint"), "links")


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold several components, with each bucket's largest component."""
    known = members.withColumn("root", F.col("fp"))
    if roots is not None:
        known = members.join(roots, F.col("fp") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "fp").alias("root"))
    sizes = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max_by("root", F.struct("k", "root")).alias("giant"))
    return known.join(sizes.where("parts > 1").select("bucket", "giant"), "bucket")


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, also: str | None = None) -> DataFrame:
    """doc_id, t (hash of the text), u (the bigint column `also`, or 0), fp (node; null without words), root (its component; null without words): one row per row of documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    u = F.lit(0).cast("bigint") if also is None else col(also)
    docs = documents.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("t"), u.alias("u"), col(text).alias("text"))
    blocks, many = _counted(docs)
    kind = docs.schema["doc_id"].dataType
    rows = blocks.select("block", "ids", "ts", "us", "types", "at", "ends", "known")
    sigs = written(map_arrow(rows, _signatures(to_arrow_type(kind), many), f"doc_id {kind.simpleString()}, t bigint, u bigint, fp bigint, bands array<bigint>, block bigint, at int"), "signatures")
    nodes = sigs.where("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct("block", "at")).alias("place"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    buckets = nodes.select("fp", "place", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(buckets.join(shared, "bucket"), "members")
    wanted = members.groupBy("fp").agg(F.first("place").alias("p")).select("fp", F.col("p.block").alias("block"), F.col("p.at").alias("at"))
    wanted = wanted.groupBy("block").agg(F.collect_list(F.struct("fp", "at")).alias("wanted"))  # some of a block's texts
    rows = blocks.join(wanted.hint("shuffle_hash"), "block").select("types", "at", "ends", "known", "wanted")
    features = written(map_arrow(rows, _features(many), "fp bigint, h binary, w binary"), "features")
    members = members.select("bucket", "band", "size", "fp")

    links, roots = None, None
    chunk = F.pmod(F.xxhash64("fp"), F.ceil(F.col("size") / GROUP)).cast("int").alias("chunk")

    def add(new: DataFrame) -> None:
        nonlocal links, roots
        if roots is None or not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            roots = components(links)

    for lo, hi in zip(STEPS, STEPS[1:]):  # what the first bands join needn't be compared again
        some = _open(members.where((F.col("band") >= lo) & (F.col("band") < hi)), roots)
        add(_links(some.select("bucket", chunk, "fp", "root", F.lit(True).alias("lead")), features, similarity))
    left = members.where(F.col("size") > GROUP)  # compared within chunks only, so far
    most = GROUP
    while True:
        known = written(_open(left, roots), "open")
        if known.isEmpty():
            break
        # Any two components of a bucket have a member outside the largest: those are the leaders.
        # A round takes more of them than the one before, in parts of GROUP; each part meets each chunk.
        rank = F.row_number().over(W.partitionBy("bucket").orderBy("fp")) - 1
        leads = known.where("root <> giant").withColumn("k", rank).where(F.col("k") < most)
        leads = written(leads.select("bucket", "size", "fp", "root", F.floor(F.col("k") / GROUP).cast("int").alias("part")), "leaders")
        parts = leads.groupBy("bucket").agg(F.max("part").alias("last"))
        chunks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / GROUP).cast("int") - 1)).alias("chunk")
        ours = leads.select("bucket", chunks, "part", "fp", "root", F.lit(True).alias("lead"))
        rest = known.join(parts, "bucket").select("bucket", chunk, F.explode(F.sequence(F.lit(0), "last")).alias("part"), "fp", "root", F.lit(False).alias("lead"))
        rows = ours.unionByName(rest).withColumn("chunk", F.col("chunk") * F.lit(1 << 31) + F.col("part")).drop("part")
        add(_links(rows, features, similarity))
        most *= 2
        left = left.join(leads.select("bucket", "fp"), ["bucket", "fp"], "left_anti")
    out = sigs.select("doc_id", "t", "u", "fp").join(roots, F.col("fp") == F.col("node"), "left")
    return out.select("doc_id", "t", "u", "fp", F.coalesce("root", "fp").alias("root"))


def duplicate_classes(documents: DataFrame, **names) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size: one row per row of documents."""
    rows = written(near_duplicates(documents, **names), "classes")
    by = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size"))
    out = rows.join(by.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left")
    return out.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("class_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("class_size"))


def keep_one(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """documents with one row of each class, all columns as they are: that of the smallest id, nulls last.

    Of rows with that id, the one with the smallest hash of its text stays, then that with the smallest hash of its other columns,
    so reruns agree.  Rows without words all stay, whatever the others are.
    """
    id_, t_, u_, many_ = fresh(documents, "id_", "text_", "other_", "many_")
    other = [c for c in documents.columns if c not in (doc_id, text) and not _unhashable(documents.select(col(c)).schema[0].dataType)]
    u = F.xxhash64(F.lit(0), *map(col, other))
    rows = written(near_duplicates(documents.withColumn(u_, u), doc_id=doc_id, text=text, also=u_, similarity=similarity), "classes")
    keys = rows.groupBy("root", "doc_id", "t", "u").agg((F.count(F.lit(1)) > 1).alias("many"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "t", "u", "many")
    kept = keys.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("k")).select("k.id", "k.t", "k.u", "k.many")
    kept = kept.unionByName(keys.where("root IS NULL").select(F.col("doc_id").alias("id"), "t", "u", F.lit(False).alias("many")))
    kept = kept.select(F.col("id").alias(id_), F.col("t").alias(t_), F.col("u").alias(u_), F.col("many").alias(many_))
    same = col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(col(text)) == F.col(t_)) & (u == F.col(u_))
    found = documents.join(kept.hint("shuffle_hash"), same)
    once, twice = found.where(~F.col(many_)), found.where(F.col(many_)).dropDuplicates([id_, t_, u_])  # rows alike in all columns
    return once.unionByName(twice).select(*map(col, documents.columns))


def _unhashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _unhashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unhashable(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))
