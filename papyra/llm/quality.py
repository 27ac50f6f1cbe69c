"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text is turned into a short vector of transformed statistics.  Class means and covariances come from at most
``sample`` labelled rows (those with the smallest id hash).  Each covariance is
shrunk towards the pooled one and that towards a sphere; the inverse of its Cholesky factor is computed once and goes to the
tasks with the model.  The difference of the two log densities, by Mahalanobis
distances, is turned into a probability by a logistic
curve fitted on the same rows.

Cases.  Null and empty texts get the statistics of an empty text.  Rows without
a label, or with a null one, are scored but not learned from.  If a class has
fewer than two rows, the score is the share of label 1, smoothed.  Rows that repeat are scored each.
Only the text is used for a score.  Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import col, fold, map_arrow, picked, text_bytes

SAMPLE = 20_000
_CLASS = np.full(256, 7)
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[ord("!")] = 6


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a UTF-8 text, all finite, of any length."""
    n = len(text)
    by = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 8) if n else np.zeros(8)
    words = text.split()
    k = len(words)
    seen = len(set(words))
    again = sum(map(eq, words, words[1:])) / max(k, 1)
    lines = text.split(b"\n")
    letters = max(by[0] + by[1] + by[2], 1)
    root = lambda x: math.sqrt(max(x, 0.0))  # noqa: E731 - spreads small shares
    return [
        math.log1p(k),
        math.log1p((n - by[4]) / max(k, 1)),
        root(by[1] / letters),
        root(by[3] / max(n, 1)),
        root(by[5] / max(n, 1)),
        root(by[6] / max(k, 1)),
        root(by[7] / max(n, 1)),
        root(by[0] / letters),
        root(again),
        math.log1p(seen) / math.log1p(max(k, 1)) if k else 1.0,
        root(1 - len(set(lines)) / len(lines)),
        root((text.count(b". ") + text.count(b".\n") + text.endswith(b".")) / max(k, 1)),
        root(text.count(b" | ") / max(k, 1)),
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t) for t in text_bytes(b.column(b.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "x"])


@dataclass
class Discriminant:
    """Standardising means and scales; per class a mean, the inverse Cholesky factor and the log density's constant."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    const: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.3, to_sphere: float = 0.1) -> Discriminant:
        counts = [int((y == c).sum()) for c in (0, 1)]
        if min(counts) < 2:
            d = x.shape[1] if x.ndim == 2 else 1
            return cls(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), prior=(counts[1] + 1) / (sum(counts) + 2))
        center, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.clip((x - center) / scale, -8, 8)
        parts = [z[y == c] for c in (0, 1)]
        covs = [np.cov(p.T, bias=True) for p in parts]
        pooled = sum(n * s for n, s in zip(counts, covs)) / sum(counts)
        factors, const = [], []
        for s in covs:
            s = (1 - to_pooled) * s + to_pooled * pooled
            s = (1 - to_sphere) * s + to_sphere * np.trace(s) / len(s) * np.eye(len(s))
            low = np.linalg.cholesky(s)
            factors.append(np.linalg.inv(low))
            const.append(-np.log(np.diag(low)).sum())
        m = cls(center, scale, np.stack([p.mean(0) for p in parts]), np.stack(factors), np.array(const))
        m._calibrate(m.difference(x), y)
        return m

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0."""
        z = np.clip((x - self.center) / self.scale, -8, 8)
        dens = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.const)]
        return np.clip(dens[1] - dens[0], -60, 60)

    def _calibrate(self, d: np.ndarray, y: np.ndarray) -> None:
        sign = 2.0 * y - 1

        def loss(v: np.ndarray) -> float:
            return float(np.logaddexp(0, -sign * (v[0] * d + v[1])).sum() + 5e-4 * (v @ v))

        v, now = np.zeros(2), loss(np.zeros(2))
        for _ in range(100):  # Newton steps of a logistic regression on one number, halved until they help
            p = 1 / (1 + np.exp(-np.clip(v[0] * d + v[1], -500, 500)))
            w = p * (1 - p)
            g = np.array([((p - y) * d).sum(), (p - y).sum()]) + 1e-3 * v
            h = np.array([[(w * d * d).sum(), (w * d).sum()], [(w * d).sum(), w.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            while (new := loss(v - step)) > now and np.abs(step).max() > 1e-12:
                step = step / 2
            if new > now or now - new < 1e-10 * max(now, 1):
                break
            v, now = v - step, new
        a, b = map(float, v)
        self.slope, self.shift = max(a, 1e-3), b

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.shift)))


def fit_quality(documents: DataFrame, labels: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Discriminant:
    """The model of at most ``sample`` labelled rows.  learn: rows of documents whose labels may be used."""
    learn = ~fold(F.col(doc_id), 4, 2) if learn is None else learn
    own = labels.select(F.col("doc_id").alias("lid"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND lid IS NOT NULL")
    own = picked(own, F.xxhash64("lid", "y"), sample)
    # At most `sample` pairs of numbers are broadcast; only the texts they name are looked at.
    docs = documents.where(learn).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    rows = docs.join(F.broadcast(own), F.col("d") == F.col("lid")).select("d", "y", "t")
    kind = rows.schema["d"].dataType.simpleString()
    got = map_arrow(rows, _stats, f"d {kind}, y int, x array<double>").collect()
    got = sorted((r["d"], r["y"], r["x"]) for r in got)
    return Discriminant.fit(np.array([x for _, _, x in got]), np.array([y for _, y, _ in got]))


def _scores(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in text_bytes(b.column(2))]).reshape(b.num_rows, -1)
            s = model.score(x) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "learn", "score"])

    return run


def quality_scores(documents: DataFrame, labels: DataFrame, *, learn: Column | None = None, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of documents.  learn: rows whose labels may be used."""
    learn = ~fold(F.col(doc_id), 4, 2) if learn is None else learn
    model = fit_quality(documents, labels, learn=learn, doc_id=doc_id, text=text, label=label, sample=sample)
    docs = documents.select(F.col(doc_id).alias("doc_id"), learn.alias("learn"), F.col(text).alias("text"))
    done = map_arrow(docs, _scores(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, learn boolean, score double")
    return done.select("doc_id", (~F.col("learn")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of documents that score at least the threshold, all columns as they are; all of them if there is nothing to learn a difference from."""
    model = fit_quality(documents, labels, doc_id=doc_id, text=text, label=label, sample=sample)
    if model.prior is not None:
        return documents
    rows = documents.select(F.struct(*map(col, documents.columns)).alias("row"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in text_bytes(b.column(1))]).reshape(b.num_rows, -1)
            keep = model.score(x) >= threshold if b.num_rows else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep))], names=["row"])

    return map_arrow(rows, run, rows.select("row").schema).select("row.*")
