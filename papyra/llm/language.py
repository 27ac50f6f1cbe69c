"""Language identification: nearest of several centroids a language, by cosine.

Texts become TF-IDF vectors of hashed byte 2- and 3-grams.  Document
frequencies are counted over all rows that may be learned from.  Spherical
k-means then finds ``clusters`` centroids for each language among at most
``per_language`` of its rows (those with the smallest id hash).  A text gets the
language of its nearest centroid; it is marked as rejected if its distance is
beyond what nearly all learned rows of that language show.

Cases.  Null text and text without a letter: ``und``, score 0, rejected.  Nothing to
learn from: the same for all.  Null languages are not learned from.  Very long texts are
counted in pieces.  Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import fold, map_arrow

DIMS = 2048
PER_LANGUAGE = 1000
_LETTER = regex.compile(r"\p{L}")
_GAPS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PIECE = 1 << 20


def _grams(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_GAPS).split()) + b" "


def counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed 2- and 3-grams, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    at = 0
    while at < len(texts):
        if len(texts[at]) > _PIECE:
            out[at] = _long(np.frombuffer(_grams(texts[at]), np.uint8))
            at += 1
            continue
        some, size = [], 0
        while at + len(some) < len(texts) and (not some or size < _PIECE) and len(texts[at + len(some)]) <= _PIECE:
            some.append(_grams(texts[at + len(some)]))
            size += len(some[-1])
        b = np.frombuffer(b"".join(some), np.uint8).astype(np.uint32)
        doc = np.repeat(np.arange(len(some)), [len(x) for x in some])
        two, three = _two(b), _three(b)
        keys = [doc[k:][doc[k:] == doc[: len(doc) - k]] * DIMS + h[doc[k:] == doc[: len(doc) - k]] for k, h in ((1, two), (2, three))]
        out[at : at + len(some)] = np.bincount(np.concatenate(keys), minlength=len(some) * DIMS).reshape(-1, DIMS)
        at += len(some)
    return out


def _two(b: np.ndarray) -> np.ndarray:
    return (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(21)


def _three(b: np.ndarray) -> np.ndarray:
    return (b[:-2] * np.uint32(0xC2B2AE35) + b[1:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)) >> np.uint32(21)


def _long(b: np.ndarray) -> np.ndarray:
    """counts() of one text, in pieces that share the bytes a gram needs."""
    out = np.zeros(DIMS, np.int64)
    for i in range(0, len(b), _PIECE):
        for width, hashed in ((2, _two), (3, _three)):
            piece = b[i : i + _PIECE + width - 1].astype(np.uint32)
            if len(piece) >= width:
                out += np.bincount(hashed(piece), minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    langs: list[str]  # of each centroid
    rows: np.ndarray
    idf: np.ndarray
    limit: np.ndarray  # of each centroid: beyond this distance a text is rejected
    temperature: float = 0.02

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        names = sorted(set(self.langs))
        if not names or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = vectors(texts, self.idf) @ self.rows.T
        best = cos.argmax(1)
        by = np.stack([cos[:, [i for i, x in enumerate(self.langs) if x == n]].max(1) for n in names], 1).astype(np.float64)
        e = np.exp((by - by.max(1, keepdims=True)) / self.temperature)
        far = 1 - cos[np.arange(len(best)), best] > self.limit[best]
        return [self.langs[i] for i in best], np.clip(e.max(1) / e.sum(1), 0, 1), far


def _kmeans(x: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    centers = [x.mean(0)]
    while len(centers) < min(k, len(x)):  # the row farthest from all centroids so far comes next
        centers.append(x[(x @ np.stack(centers).T).max(1).argmin()])
    c = np.stack(centers)
    for _ in range(steps):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        texts = b.column(0).to_pylist()
        for i in range(0, len(texts), 256):
            total += (counts(texts[i : i + 256]) > 0).sum(0)
        n += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS, dtype=np.int32)), pa.array(np.append(n, total))], names=["dim", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = counts(b.column(1).to_pylist()).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def fit_language(rows: DataFrame, *, per_language: int = PER_LANGUAGE, clusters: int = 3, quantile: float = 0.999) -> Centroids:
    """rows: id, lang, text; all of them are learned from, as far as lang and text are not null."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("id", "lang"))
    df = {r["dim"]: r["n"] for r in map_arrow(rows.select("text"), _frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))).astype(np.float32) + 0.1
    # Thresholds of the hash first, by the ids alone; the texts of the few rows below them then.
    w = F.row_number().over(_window())
    tops = rows.select("lang", "h").withColumn("k", w).where(F.col("k") <= per_language).groupBy("lang").agg(F.max("h").alias("top"))
    langs, cents, limit = [], [], []
    picked = map_arrow(rows.join(F.broadcast(tops.withColumnRenamed("lang", "l")), (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("top"))).select("lang", "text"), _sampled, "lang string, x binary")
    by: dict[str, list] = {}
    for r in picked.toLocalIterator():
        by.setdefault(r["lang"], []).append(np.frombuffer(r["x"], np.uint32))
    for lang in sorted(by):
        x = np.log1p(np.stack(sorted(by[lang], key=bytes)).astype(np.float32)) * idf
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        c = _kmeans(x, clusters)
        cos = x @ c.T
        far = 1 - cos.max(1)
        langs += [lang] * len(c)
        cents.append(c)
        limit += [float(np.quantile(far, quantile))] * len(c)
    return Centroids(langs, np.concatenate(cents) if cents else np.zeros((0, DIMS), np.float32), idf, np.array(limit))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy("h")


def _predict(model: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            ok = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
            for k in range(0, len(ok), 256):
                some = ok[k : k + 256]
                names, s, f = model.predict([texts[i] for i in some])
                score[some], far[some] = s, f
                for i, name in zip(some, names):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify_languages(documents: DataFrame, *, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fit) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row of documents."""
    held = fold(F.col(doc_id), 3, 1) if held_out is None else held_out
    docs = documents.select(F.col(doc_id).alias("id"), held.alias("held"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    model = fit_language(docs.where("NOT held").select("id", "lang", "text"), **fit)
    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs.select("id", "held", "text"), _predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
