"""Chroma audio fingerprints of a media column.

A clip is mono 16-bit PCM in a binary column.  Frames of 4096 samples, two thirds of each shared with the
next, are folded into 12 pitch classes and smoothed.  Sixteen
filters, differences of rectangle sums in an integral image of 16 frames by
12 classes, are each quantised to two bits (Gray code), so every frame yields one packed 32-bit
integer.  Two recordings are compared at every offset at which any of their
integers agree in the upper 24 bits, by the share of bits that differ there; of the alignments, that of most agreements counts.

Queries (ids divisible by 20) are matched against all clips: both sides are
joined on the keys of their frames, and all pairs that share a key are compared; rows of a
key that very many clips share are salted.  Frames without any sound have no key, and don't count where both recordings have them.

Cases.  Null, empty and very short audio: no integers, no match.  A trailing odd byte is left out.  Silence matches nothing.
Null ids are fingerprinted but not matched.  Repeated rows are fingerprinted each; they match as one id, and so do rows of one id with different audio.
Long clips are read in pieces of frames.  Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import map_arrow, written

RATE = 11_025
FRAME, HOP = 4096, 1365
WIDTH = 16
KEY_SHIFT = 8
#: Share of differing bits up to which a match is an alignment, and frames that it takes.
MAX_ERROR, MIN_FRAMES = 0.15, 8
#: Matches in one row of grouped_matches, about.
LIST = 1024
_PIECE = 512


#: kind, first class, classes, frames.  Own choice: all kinds of difference, spread over classes and lengths.
_SHAPES = [(1, 0, 6, 16), (1, 6, 6, 16), (1, 3, 6, 12), (2, 0, 3, 16), (2, 3, 3, 16), (2, 6, 3, 16), (2, 9, 3, 16), (3, 0, 6, 16),
           (3, 4, 8, 14), (4, 1, 6, 16), (4, 6, 6, 12), (5, 0, 4, 15), (5, 4, 4, 15), (5, 8, 4, 15), (1, 1, 2, 16), (1, 8, 2, 16)]
#: Thresholds between each filter's four levels: the quartiles of its answers over 300 random melodies, so that each bit halves what it sees.
_CUTS = [
    (-0.504, -0.091, 0.334), (-0.344, 0.054, 0.469), (-0.455, 0.018, 0.488), (-0.43, -0.009, 0.404),
    (-0.44, 0.011, 0.454), (-0.432, -0.002, 0.438), (-0.42, 0.001, 0.417), (-0.387, -0.017, 0.36),
    (-0.349, -0.001, 0.344), (-1.108, -0.651, -0.243), (-1.125, -0.634, -0.187), (-0.928, -0.575, -0.269),
    (-0.946, -0.571, -0.233), (-0.926, -0.569, -0.252), (-0.684, -0.009, 0.636), (-0.575, 0.021, 0.63),
]


_GRAY = np.array([0, 1, 3, 2], np.uint32)


_WINDOW = np.hamming(FRAME).astype(np.float32)


@lru_cache
def _folds(rate: int) -> tuple[slice, np.ndarray]:
    """The spectrum's bins from 28 to 3520 Hz, and the matrix that adds them up by pitch class."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hertz >= 28) & (hertz <= 3520))
    fold = np.zeros((len(use), 12), np.float32)
    fold[np.arange(len(use)), np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12] = 1
    return slice(int(use[0]), int(use[-1]) + 1), fold


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Pitch-class energies of each frame, each row of length one (or zeros for silence)."""
    frames = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    out = np.zeros((frames, 12), np.float64)
    if not frames:
        return out
    use, fold = _folds(rate)
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for i in range(0, frames, _PIECE):
        f = np.fft.rfft(views[i : i + _PIECE] * _WINDOW, axis=1)[:, use]
        out[i : i + _PIECE] = (f.real**2 + f.imag**2) @ fold
    smooth = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    padded = np.pad(out, ((2, 2), (0, 0)), mode="edge")
    out = sum(w * padded[k : k + frames] for k, w in enumerate(smooth))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-9), 0.0)


def _areas(kind: int, c: int, n: int, w: int) -> list[tuple[float, int, int, int, int]]:
    """Signed rectangles (sign, frame from, to, class from, to) of a filter."""
    half_w, half_n, third = w // 2, n // 2, w // 3
    if kind == 1:
        return [(1, 0, w, c + half_n, c + n), (-1, 0, w, c, c + half_n)]
    if kind == 2:
        return [(1, half_w, w, c, c + n), (-1, 0, half_w, c, c + n)]
    if kind == 3:
        return [(1, 0, half_w, c + half_n, c + n), (1, half_w, w, c, c + half_n), (-1, 0, half_w, c, c + half_n), (-1, half_w, w, c + half_n, c + n)]
    if kind == 4:
        return [(1, 0, w, c + n // 3, c + n - n // 3), (-1, 0, w, c, c + n // 3), (-1, 0, w, c + n - n // 3, c + n)]
    return [(1, third, w - third, c, c + n), (-1, 0, third, c, c + n), (-1, w - third, w, c, c + n)]


def fingerprint(pcm: bytes | None, rate: int = RATE) -> np.ndarray:
    """Packed 32-bit integers of a clip, one for each frame that WIDTH frames start at."""
    data = (pcm or b"")[: len(pcm or b"") // 2 * 2]
    image = chroma(np.frombuffer(data, "<i2").astype(np.float32) / 32768, rate)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)
    out = np.zeros(n, np.uint32)
    for value, cuts in zip(responses(integral, at), _CUTS):
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(cuts, value)]
    return out


#: The integer of a frame without any sound: it votes for nothing and is left out where both sides have it.
SILENT = np.uint32(sum(int(_GRAY[np.searchsorted(cuts, 0.0)]) << (30 - 2 * i) for i, cuts in enumerate(_CUTS)))


def responses(integral: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """What each filter answers at some frames: the log ratio of its two areas."""
    for kind, c, classes, w in _SHAPES:
        plus = minus = 0.0
        for sign, f0, f1, c0, c1 in _areas(kind, c, classes, w):
            s = integral[at + f1, c1] - integral[at + f0, c1] - integral[at + f1, c0] + integral[at + f0, c0]
            plus, minus = (plus + s, minus) if sign > 0 else (plus, minus + s)
        yield np.log((1 + plus) / (1 + minus))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """The alignment of b against a, of all offsets at which a key agrees: offset, frames that overlap there and aren't silent in both, share of differing bits.

    Where several offsets are alignments, the one at which most keys agree, then that of the fewest errors, then the smallest shift;
    where none is, that of the fewest errors.
    """
    ka, kb = a >> np.uint32(KEY_SHIFT), b >> np.uint32(KEY_SHIFT)
    order = np.flatnonzero(b != SILENT)
    order = order[np.argsort(kb[order], kind="stable")]
    lo, hi = (np.searchsorted(kb[order], ka, side=s) for s in ("left", "right"))
    hist = np.zeros(len(a) + len(b), np.int64)
    for i in np.flatnonzero((hi > lo) & (a != SILENT)):  # one frame of a with all frames of b of its key
        np.add.at(hist, order[lo[i] : hi[i]] - i + len(a), 1)
    if not hist.any():
        return 0, 0, 1.0
    found, best = (0, 0, 1.0), (False, 0, -1.0, 0)
    for off in np.flatnonzero(hist) - len(a):
        i0, j0 = max(0, -off), max(0, off)
        n = min(len(a) - i0, len(b) - j0)
        x, y = a[i0 : i0 + n], b[j0 : j0 + n]
        heard = (x != SILENT) | (y != SILENT)
        n = int(heard.sum())
        error = float(np.bitwise_count((x ^ y)[heard]).sum() / (32 * n)) if n else 1.0
        ok = n >= MIN_FRAMES and error <= MAX_ERROR
        rank = (ok, int(hist[off + len(a)]) if ok else 0, -error, -abs(int(off)))
        if rank > best:
            found, best = (int(off), int(n), error), rank
    return found


def _prints(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [fingerprint(p, rate).view(np.int32) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.int32()))], names=["id", "fp"])

    return run


def fingerprints(media: DataFrame, *, id: str = "id", audio: str = "audio", rate: int = RATE) -> DataFrame:
    """id, fp array<int>: one row per row of media."""
    rows = media.select(F.col(id).cast("bigint").alias("id"), F.col(audio).alias("audio"))
    return map_arrow(rows, _prints(rate), "id bigint, fp array<int>")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fa, fb = ([np.array(x, np.int32).view(np.uint32) for x in b.column(i).to_pylist()] for i in (2, 3))
        got = [align(x, y) for x, y in zip(fa, fb)]
        ok = pa.array([n >= MIN_FRAMES and e <= MAX_ERROR for _, n, e in got], pa.bool_())
        cols = [b.column(0), b.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64())))]
        yield pa.RecordBatch.from_arrays([c.filter(ok) for c in cols], names=["query_id", "match_id", "offset", "frames", "bit_error"])


def match_recordings(media: DataFrame, *, id: str = "id", audio: str = "audio", rate: int = RATE, every: int = 20) -> DataFrame:
    """query_id, match_id, offset, frames, bit_error: clips that align with a query (an id divisible by every)."""
    return match_prints(written(fingerprints(media, id=id, audio=audio, rate=rate).where("id IS NOT NULL AND size(fp) > 0"), "prints"), every=every)


def match_prints(prints: DataFrame, *, every: int = 20) -> DataFrame:
    """match_recordings of fingerprints: id, fp.  Rows of one id with different audio are compared each; of their alignments that of the fewest errors counts."""
    prints = prints.select("id", F.xxhash64("id", "fp").alias("row"), "fp")
    keys = prints.select("id", "row", F.explode("fp").alias("v")).where(F.col("v") != F.lit(int(np.uint32(SILENT).view(np.int32))))
    keys = keys.select("id", "row", F.shiftrightunsigned("v", KEY_SHIFT).alias("key")).distinct()
    q = keys.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), F.col("key").alias("qk"))
    # Hot keys: the queries' rows are copied to each salt, the clips' rows are spread over them.
    q = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("qs"))
    c = keys.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(8)).cast("int"))
    pairs = q.join(c, (F.col("qk") == F.col("key")) & (F.col("qs") == F.col("s"))).where("query_id <> id").select("query_id", "query_row", F.col("id").alias("match_id"), F.col("row").alias("match_row")).distinct()
    one = prints.groupBy("row").agg(F.first("fp").alias("fp"))  # repeated rows are alike
    a = one.select(F.col("row").alias("query_row"), F.col("fp").alias("fa"))
    b = one.select(F.col("row").alias("match_row"), F.col("fp").alias("fb"))
    rows = pairs.join(a, "query_row").join(b, "match_row").select("query_id", "match_id", "fa", "fb")
    found = map_arrow(rows, _aligned, "query_id bigint, match_id bigint, offset int, frames int, bit_error double")
    best = F.min(F.struct("bit_error", (-F.col("frames")).alias("less"), F.abs("offset").alias("shift"), "offset")).alias("x")
    found = found.groupBy("query_id", "match_id").agg(best)
    return found.select("query_id", "match_id", "x.offset", (-F.col("x.less")).alias("frames"), "x.bit_error")


def grouped_matches(matches: DataFrame) -> DataFrame:
    """query_id, part, matches (array of struct match_id, offset, frames, bit_error, by id): all matches, in lists of about LIST."""
    matches = written(matches, "matches")
    n = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("query_id", "q")
    part = F.pmod(F.xxhash64("match_id"), F.ceil(F.col("n") / LIST)).cast("int")
    rows = matches.join(n, F.col("query_id") == F.col("q")).withColumn("part", part)
    one = F.struct("match_id", "offset", "frames", "bit_error")
    return rows.groupBy("query_id", "part").agg(F.array_sort(F.collect_list(one)).alias("matches"))


# --- a media table for tests and for the query


NOTE = 1500


@lru_cache
def _notes(rate: int) -> np.ndarray:
    """The 24 half tones from 220 Hz."""
    t = np.arange(NOTE) / rate
    hertz = 220 * 2 ** (np.arange(24) / 12)
    return (12000 * (np.sin(2 * np.pi * hertz[:, None] * t) + 0.4 * np.sin(4 * np.pi * hertz[:, None] * t))).astype("<i2")


def render(values: np.ndarray, rate: int = RATE) -> bytes:
    """PCM of a melody: each value is a note of NOTE samples, its pitch one of 24 half tones by the value's rank among fixed steps."""
    tone = np.clip(np.floor((np.asarray(values, np.float64) + 0.3) * 40), 0, 23)
    return _notes(rate)[tone.astype(np.int32)].tobytes()


def rerecorded(pcm: bytes, seed: int) -> bytes:
    """The same melody as another device might take it: it starts up to a few notes late and in mid frame, at another volume, with noise."""
    rng = np.random.default_rng(seed)
    x = np.frombuffer(pcm, "<i2").astype(np.float32)[int(rng.integers(0, min(4 * NOTE, len(pcm) // 8 + 1))) :]
    x = x * np.float32(rng.uniform(0.3, 1.0)) + rng.normal(0, 300, len(x)).astype(np.float32)
    return np.clip(x, -32768, 32767).astype("<i2").tobytes()


def _rendered(again: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one clip at a time: a clip is far larger than its vector
                n, v = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                pcm = render(np.array([x for x in v if x is not None])) if v else None
                rows = [(None if n is None else 2 * n, pcm)]
                if n is not None and n % again == 0:
                    rows.append((2 * n + 1, None if pcm is None else rerecorded(pcm, n & 0xFFFFFFFF)))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["id", "audio"])

    return run


def clips(embeddings: DataFrame, *, id: str = "vec_id", vector: str = "embedding", again: int = 10) -> DataFrame:
    """id, audio: each vector as a melody, with twice its id; of ids divisible by `again` one more recording, with the id after.  A null or empty vector as null audio."""
    rows = embeddings.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return map_arrow(rows, _rendered(again), "id bigint, audio binary")
