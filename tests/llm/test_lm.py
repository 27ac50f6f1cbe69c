"""Language-model scores against a mixer in plain Python."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

from papyra.llm import lm
from papyra.llm.blocks import Numbers
from papyra.llm.common import mark_written
from papyra.llm.lm import score_texts
from tests.llm.helpers import LOWER, TOKEN, awkward, empty, row
from tests.llm.test_operators import held, plain, sample_rows


def tokens_of(text):
    return [w.encode() for w in TOKEN.findall((text or "").translate(LOWER))]


def code(word, ranks):
    """Coded bytes of a token, and their kinds."""
    if word is None:
        return [lm.END], [0]
    k = ranks.get(word, lm.DICTIONARY)
    if k < lm.ONE:
        return [k], [0]
    if k < lm.DICTIONARY:
        return [lm.ONE + (k - lm.ONE) // 256, (k - lm.ONE) % 256], [0, 1]
    out = [lm.SPELL, *word, 32]
    return out, [0] + [2] * (len(out) - 1)


def contexts(bytes_, kinds):
    for i, b in enumerate(bytes_):
        yield [(o, kinds[i], min(i, o), bytes(bytes_[max(0, i - o) : i])) for o in lm.ORDERS], b, kinds[i]


class Plain:
    """Counts of the training texts, and the cost of a text by loops over its bits."""

    def __init__(self, training):
        self.words = Counter(w for t in training for w in t if w is not None)
        ranked = sorted((w for w, n in self.words.items() if n > 1), key=lambda w: (-self.words[w], xxhash.xxh3_64_intdigest(w)))
        self.ranks = {w: i for i, w in enumerate(ranked)}
        self.bytes, self.follow = defaultdict(Counter), defaultdict(Counter)
        for t in training:
            for w in t:
                for keys, b, _ in contexts(*code(w, self.ranks)):
                    for k in keys:
                        self.bytes[k][b] += 1
            for a, b, c in zip([-2, -1, *t], [-1, *t], t):
                self.follow[a, b][c] += 1

    def nats(self, text, without, start):
        total = 0.0
        past, seen = [], [defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])]
        rows = []
        for a, b, c in zip([-2, -1, *text], [-1, *text], text):
            both, own = sum(self.follow[a, b].values()) - without, max(0, self.follow[a, b][c] - without)
            state = 0
            if both > 0:
                level = 1 + math.ceil(8 * math.log2(both))
                bucket = min(level // 8, 31)
                p1, p2 = ([0, 0] + past)[-1], ([0, 0] + past)[-2]
                state = 2 if own else 1
                t = 0.0
                for table, prior, key, blend in zip(seen, start.priors, (bucket, (p1 * 3 + p2) * 4 + min(bucket, 3)), start.blend):
                    up, n = table[key]
                    p = (up + 4 * prior[key]) / (n + 4)
                    t += blend * math.log(p / (1 - p))
                    table[key] = [up + (state == 2), n + 1]
                total += math.log1p(math.exp(-t if state == 2 else t))
                if own:
                    total += (level - 1 - math.floor(8 * math.log2(own))) * math.log(2) / 8
            past.append(state)
            if state != 2:
                rows += contexts(*code(c, self.ranks))
        w = {(s, k, j): float(start.weights[s, k, j]) for s in range(lm.SETS) for k in range(lm.K) for j in range(8)}
        squares = dict.fromkeys(w, lm._SLOW)
        done, step = 0, 64
        while done < len(rows):
            slope = defaultdict(float)
            for keys, b, kind in rows[done : done + step]:
                n0 = sum(self.bytes[keys[-1]].values()) - without
                gate = kind * 4 + (n0 > 0) + (n0 > 3) + (n0 > 31)
                for j in range(8):
                    x = []
                    for key in keys:
                        upper = [v for v in self.bytes[key] if v >> (8 - j) == b >> (8 - j)]
                        n = sum(self.bytes[key][v] for v in upper)
                        own = sum(self.bytes[key][v] for v in upper if v >> (7 - j) == b >> (7 - j))
                        odds = math.log((max(own - without, 0) + 0.3) / (n - own + 0.3)) * lm._SCALE
                        x.append(min(120, max(-120, round(odds))) / lm._SCALE)
                    t = sum(w[gate, k, j] * x[k] for k in range(lm.K))
                    place = min(1280, max(0, int(t * 32 + 640.5)))
                    total -= math.log(start.right[gate, place])
                    for k in range(lm.K):
                        slope[gate, k, j] += x[k] * (1 - 1 / (1 + math.exp(-(place - 640) / 32)))
            for key, g in slope.items():
                squares[key] += g * g
                w[key] += lm._RATE * g / math.sqrt(squares[key])
            done, step = done + step, min(step * 2, 1024)
        return total


def test_base_scores(spark):
    docs = awkward(spark, sample_rows())
    got = score_texts(docs).collect()
    rows = plain(docs)
    tokens = [tokens_of(t) + [None] for _, t in rows]
    count = Counter(x for (i, _), k in zip(rows, tokens) if not held(i, 7, 2) for x in k)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i, 7, 2), len(k), sum(count[x] > 0 for x in k), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in k), 5)) for (i, _), k in zip(rows, tokens))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert score_texts(empty(spark)).collect() == []


def test_scores_match_a_plain_mixer(spark, monkeypatch):
    rng = np.random.default_rng(4)
    start = lm.Start()
    start.weights = (start.weights + rng.normal(0, 0.1, start.weights.shape)).astype(np.float32)
    right = np.clip(start.right + rng.normal(0, 0.02, start.right.shape), 1e-3, 1 - 1e-3)
    start.right = (right + 1 - right[:, ::-1]) / 2
    start.priors, start.blend = (rng.uniform(0.1, 0.9, 32), rng.uniform(0.1, 0.9, 36)), np.array([0.4, 0.7])
    monkeypatch.setattr(lm, "_start", lambda *_: start)
    rows = [*sample_rows(40), row(1, "Grün ünique wörds\tappear x" + "yz" * 30), row(2, None), row(3, ""), row(4, "grün ünique wörds appear twice"), row(5, "ban den " * 400), row(None, "no id")]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string").repartition(3)
    texts = [(i, tokens_of(t) + [None]) for i, t in plain(docs)]
    model = Plain([t for i, t in texts if not held(i, 7, 2)])
    got = {r["doc_id"]: r for r in score_texts(docs).collect()}
    assert {held(i, 7, 2) for i, _ in texts} == {True, False}
    for i, t in texts:
        want = -model.nats(t, 0 if held(i, 7, 2) else 1, start) / math.log(10)
        assert math.isclose(got[i]["score"], want, rel_tol=2e-3, abs_tol=1e-3), (i, got[i]["score"], want)
        assert math.isclose(got[i]["bits_per_byte"], -want * math.log2(10) / max(1, sum(len(w or b"") + (w is not None) for w in t)), rel_tol=2e-3, abs_tol=1e-3)


def test_bits_are_a_distribution():
    """Of the two values of a bit in one context the probabilities add up to 1, whatever is learnt."""
    start = lm.fitted(words_of(["some words of one kind " * 20, "and others of a kind"]), np.empty(0, np.uint64), np.empty(0, np.int64))
    assert np.allclose(start.right + start.right[:, ::-1], 1)
    keys = np.array([7 << 8 | 97, 7 << 8 | 98, 9 << 8 | 0], np.uint64)
    odds, seen = lm.path_odds(keys, np.array([3, 5, 0]), 0)
    assert (odds[0, :6] == odds[1, :6]).all() and odds[0, 6] == -odds[1, 6] and odds[2].tolist() == [0] * 8
    assert seen.tolist() == [2, 2, 0]


def words_of(texts):
    number = Numbers()
    at = [np.array([number[w] for w in tokens_of(t)], np.int32) for t in texts]
    return lm.Words(list(number), np.concatenate(at), np.cumsum([len(a) for a in at]))


def test_start_is_learned_from_all_training_texts(spark, monkeypatch):
    """Texts of other kinds in other blocks: the start is that of all of them at once, whichever block is picked by hash."""
    rows = [*sample_rows(40), *(row(300 + i, f"Other{i % 7} wörds{i % 11} follow{i % 3} " * (i + 1)) for i in range(40)), *(row(400 + i, "z" * i + f" q{i}") for i in range(40)), row(None, "no id"), row(5, None)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string").repartitionByRange(6, "doc_id")
    seen = []

    def start(*args, known=lm._start):
        seen.append((args, known(*args)))
        return seen[0][1]

    monkeypatch.setattr(lm, "_start", start)
    assert score_texts(docs).count() == len(rows)
    [((blocks, dictionary, ranks, *_), got)] = seen
    assert blocks.where("NOT held").count() > 3
    want = lm.fitted(words_of([t for i, t in plain(docs) if not held(i, 7, 2)]), dictionary, ranks)
    for x, y in zip([*got.priors, got.blend, got.weights, got.right], [*want.priors, want.blend, want.weights, want.right]):
        assert np.allclose(x, y, rtol=1e-4, atol=1e-4)
    assert np.abs(got.weights - lm.Start().weights).max() > 0.02 and np.abs(got.blend - 0.5).max() > 0.02


def test_start_needs_no_words(spark, monkeypatch):
    """Learning the start reads what the blocks' one pass has left, and no text is unpacked and coded for it again; what was written before that pass is gone."""
    rows = [*sample_rows(40), *(row(300 + i, f"Other{i % 7} wörds{i % 11} follow{i % 3} " * (i + 1)) for i in range(40)), row(None, "no id"), row(5, None)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string").repartition(3)
    known, seen = lm._start, []
    monkeypatch.setattr(lm, "_start", lambda blocks, *args: seen.append((blocks, args, mark_written())) or lm.Start())
    before = mark_written()
    score_texts(docs)
    [(blocks, args, written)] = seen
    assert written == before + 1
    want, got = known(blocks, *args), known(blocks.drop("ids", "types", "at", "known", "odds", "counts"), *args)
    assert (want.weights == got.weights).all() and (want.right == got.right).all() and (want.blend == got.blend).all()
    assert np.abs(got.weights - lm.Start().weights).max() > 0.01


def test_words_are_split_as_bytes_are():
    """Blocks' words against plain Python, for bytes of any kind: white space at either end, controls, broken UTF-8."""
    rng = np.random.default_rng(8)
    odd = [*b" \t\n\x0b\x0c\r\x00\x1c\x1f@AZ[az", 0x85, 0xA0, 0xC3, 0xE2, 0x80, 0xA8, 0xFF]
    for size in range(300):
        texts = [bytes(rng.choice(odd, rng.integers(0, 25)).tolist()) for _ in range(size % 6 + 1)]
        types, at, ends = lm._split(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        number = Numbers()
        words = [[number[w] for w in bytes(b + 32 if 65 <= b <= 90 else b for b in t).split()] for t in texts]
        assert (types.split(b"\n") if types else []) == list(number)
        assert at.tolist() == sum(words, []) and ends.tolist() == np.cumsum([len(w) for w in words]).tolist()


def test_start_costs_least():
    """Weights and blend are where the events' cost, by loops over them, is least; priors are shares of flags."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, lm.FITS, 3000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 1 << 32, 3000).astype(np.uint64))
    keys = np.array([k if k >> np.uint64(32) < lm.FITS - 1 else k & ~np.uint64(0xFFFF) for k in keys])
    count = rng.integers(1, 50, len(keys))
    start = lm.Start()
    lm.learn(start, lambda part: part(keys, count))

    def nats(weights, blend):
        total = 2.0 * float(((weights - lm._START[:, None]) ** 2).sum() + ((blend - 0.5) ** 2).sum())
        for key, n in zip(keys.tolist(), count.tolist()):
            which, x = key >> 32, [(b + 128) % 256 - 128 for b in (key & 0xFFFFFFFF).to_bytes(4, "big")]
            w = blend if which == lm.FITS - 1 else weights[which // 8, :, which % 8]
            total += n * np.logaddexp(0, -sum(a * b for a, b in zip(x, w)) / lm._SCALE)
        return total

    least = nats(start.weights.astype(float), start.blend)
    for _ in range(5):
        away = rng.normal(0, 0.01, start.weights.shape), rng.normal(0, 0.01, 2)
        assert nats(start.weights + away[0], start.blend + away[1]) > least
    assert least < nats(lm.Start().weights.astype(float), np.array([0.5, 0.5])) - 1


def test_very_long_text_in_steps():
    """A text of some megabytes is mixed step by step: memory follows its distinct words."""
    import tracemalloc

    words = words_of([" ".join(f"w{i * i % 7919}" for i in range(400_000))])
    coded = lm.Coded(words.types, words.hash, np.empty(0, np.uint64), np.empty(0, np.int64), 40)
    odds, seen = lm.path_odds(coded.keys, coded.counts(np.bincount(words.tokens)), 1)
    none = np.zeros(len(words.tokens), np.uint8)
    tracemalloc.start()
    assert 0 < lm.cost(words, coded, odds, seen, none, none, lm.Start())[0] < 8 * words.bytes[0]
    assert tracemalloc.get_traced_memory()[1] < 40 * words.bytes[0]
    tracemalloc.stop()


def test_held_out_texts_beat_the_baseline(spark):
    got = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").groupBy().sum("score", "base_score").first()
    assert got["sum(score)"] > 0.95 * got["sum(base_score)"]
    assert pq.read_metadata("/root/testdata/sf0.01/documents.parquet").num_rows == 1000
