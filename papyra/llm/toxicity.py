"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features are hashed words and word stems (the first five bytes).  Those
associated with toxic labels beyond chance are kept.  Severity grades 0 to 3 order the
labelled rows: 0 for label 0; toxic rows get 1, 2 or 3 by how many kept
features' words they hold (thirds of the toxic rows).  One weight vector is shared by the
ordered thresholds: P(grade > k) = logistic(w x - t_k), t_0 < t_1 < t_2.  The model is fitted
on at most ``sample`` labelled rows (smallest hash; crc32(doc_id as text) mod 4 is not 2) and scores every whole text.

Cases.  Null and empty texts hold no feature.  Without labelled toxic rows all severities are 0.
Null labels and ids are not learned from.  Repeated rows are scored each.
Columns other than those named are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import WORD_TABLE, fold, map_arrow, picked, text_bytes

BITS = 20
SAMPLE = 20_000
GRADES = 4
_MASK = (1 << BITS) - 1


def features(text: bytes) -> Counter:
    """Hashed words and stems of a text with their counts."""
    out: Counter = Counter()
    for w, n in Counter(text.translate(WORD_TABLE).split()).items():
        out[xxhash.xxh3_64_intdigest(w) & _MASK] += n
        if len(w) > 5:
            out[xxhash.xxh3_64_intdigest(b"^" + w[:5]) & _MASK] += n
    return out


@dataclass
class Ordinal:
    keys: np.ndarray  # sorted hashes of the kept features
    weights: np.ndarray
    cuts: np.ndarray  # ordered thresholds

    def grades(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the grades, from the linear scores x."""
        above = 1 / (1 + np.exp(-np.clip(x[:, None] - self.cuts, -60, 60)))
        return -np.diff(np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], 1), axis=1)


def fit_ordinal(sets: list[np.ndarray], labels: list[int], z: float = 4.0, steps: int = 1500, l2: float = 1e-3) -> Ordinal:
    """sets: a row's features and counts, uint32 [n, 2]; labels: toxic, 0 or 1."""
    toxic = np.array(labels, bool)
    rows = len(toxic)
    none = Ordinal(np.empty(0, np.int64), np.empty(0), np.array([30.0, 31.0, 32.0]))
    if not toxic.any() or toxic.all():
        return none
    n1, n0 = float(toxic.sum()), float((~toxic).sum())
    r = np.repeat(np.arange(rows, dtype=np.int32), [len(s) for s in sets])
    every = np.concatenate(sets)
    keys, c = np.unique(every[:, 0], return_inverse=True)
    a = np.bincount(c, toxic[r], len(keys))
    b = np.bincount(c, minlength=len(keys)) - a
    # Log odds of a feature's presence against its standard error; and most of the documents that hold it are toxic.
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    err = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
    keep = (a >= 3) & (odds / err > z / 2) & (a - b > 0.4 * (a + b))
    if not keep.any():
        return none
    some = keep[c]
    r, v = r[some], np.log1p(every[some, 1])
    c = (np.cumsum(keep) - 1)[c[some]]
    keys = keys[keep].astype(np.int64)
    hits = np.bincount(r, v, rows)
    lo, hi = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (hits > lo) + (hits > hi), 0)
    w, cuts = np.zeros(len(keys)), np.array([1.0, 2.0, 3.0])
    mw, vw, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros(3), np.zeros(3)
    above = (grade[:, None] > np.arange(3)).astype(float)
    for step in range(1, steps + 1):  # Adam on the mean log loss of the three cumulative links
        x = np.bincount(r, v * w[c], rows)
        d = 1 / (1 + np.exp(-np.clip(x[:, None] - cuts, -60, 60))) - above
        gw = np.bincount(c, v * d.sum(1)[r], len(keys)) / rows + l2 * w / len(keys)
        gc = -d.mean(0)
        for g, m, s, p in ((gw, mw, vw, w), (gc, mc, vc, cuts)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        cuts = np.sort(cuts)
    return Ordinal(keys, w, cuts)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [features(t) for t in text_bytes(b.column(2))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([np.array(list(x.items()), np.uint32).tobytes() for x in f], pa.binary())], names=["d", "y", "f"]
        )


def _score(model: Ordinal):
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}  # words seen lately; most hold no kept feature
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            x = np.zeros(b.num_rows)
            for i, t in enumerate(text_bytes(b.column(1))):
                n: dict[int, int] = {}
                for w in t.translate(WORD_TABLE).split():
                    own = known.get(w)
                    if own is None:
                        if len(known) > 200_000:
                            known.clear()
                        own = tuple(k for k in (digest(w) & _MASK, *((digest(b"^" + w[:5]) & _MASK,) if len(w) > 5 else ())) if k in weight)
                        known[w] = own
                    for k in own:
                        n[k] = n.get(k, 0) + 1
                x[i] = sum(np.log1p(c) * weight[k] for k, c in sorted(n.items()))
            p = model.grades(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(1).astype(np.int32)), pa.array(1 - p[:, 0]), pa.array(p[:, 0] < 0.5)],
                names=["doc_id", "held_out", "severity", "grade", "p_toxic", "toxic"],
            )

    return run


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """The model of at most ``sample`` labelled rows.  learn: rows of documents whose labels may be used."""
    learn = ~fold(F.col(doc_id), 4, 2) if learn is None else learn
    docs = documents.where(learn).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    kind = docs.schema["d"].dataType.simpleString()
    own = labels.select(F.col("doc_id").alias("lid"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND lid IS NOT NULL")
    own = picked(own, F.xxhash64("lid", "y"), sample)
    # At most `sample` pairs of numbers are broadcast.
    rows = docs.join(F.broadcast(own), F.col("d") == F.col("lid")).select("d", "y", "t")
    got = sorted((r["d"], r["y"], bytes(r["f"])) for r in map_arrow(rows, _sampled, f"d {kind}, y int, f binary").toLocalIterator())
    return fit_ordinal([np.frombuffer(f, np.uint32).reshape(-1, 2) for _, _, f in got], [y for _, y, _ in got])


def grade_toxicity(documents: DataFrame, labels: DataFrame, *, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, severity (expected grade, 0 to 3), grade (likeliest), p_toxic, toxic: one row per row of documents.  learn: rows whose labels may be used."""
    learn = ~fold(F.col(doc_id), 4, 2) if learn is None else learn
    model = fit_toxicity(documents, labels, learn=learn, doc_id=doc_id, text=text, label=label, sample=sample)
    docs = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), (~learn).alias("held"))
    kind = docs.schema["d"].dataType.simpleString()
    return map_arrow(docs, _score(model), f"doc_id {kind}, held_out boolean, severity double, grade int, p_toxic double, toxic boolean")
