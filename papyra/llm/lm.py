"""Language-model scores by online logistic context mixing, beside a unigram baseline.

Both models see a text as the same events: its words with A-Z lower-cased and one end.

The mixer codes them bit by bit.  Before a word a flag tells whether it is one that followed the two words before it in the
training texts; if so, the word costs what its share of those followers says.  Otherwise it is coded as
bytes: the commonest words of the training texts have codes of one or two bytes, others are spelled.  Bit predictors
are counts of bits after hashed contexts (the last 1, 2, 3 and 5 bytes of the word, and the two words before for the flag), gathered over all training texts
for each context that occurs, in shards; nothing has a fixed size.  Their stretched probabilities are summed with weights; a gate (kind of byte, and how
often the longest context has been seen) picks the weight set, and each text refines its own weights by gradient steps as it is read: after 64
of its bytes, then at growing steps of up to 1024, each byte being predicted with weights learned from the bytes before its step only.
A last stage maps the mixed odds of each gate to those observed.  Flags adapt by counts of the text itself.

What every text starts with is learned from all training texts, each event of which is predicted without itself: priors of the flags by counts, weights by
logistic regression (Newton steps that always descend), maps by counts of the odds that these weights give.  An event is its set and its predictors'
odds (Coded's int8, flags' rounded to the same steps); the blocks count equal events, shards add them up, and the regression reads these sums.

A training text is scored by counts without the very event that is predicted, so scores of both parts compare: a text does well
for what it shares with others.  The base score has plain counts.

The texts are packed in blocks, written to the shared folder.  A block sends the keys of its
distinct tokens, word triples and byte contexts to shards by hash, with their counts; a shard adds them up and answers each block in the same order.
No vocabulary or table is broadcast but the bounded list of the commonest words, and a block's answers are bounded by its size.

Cases.  Null text: as empty, one end.  Null ids belong to the training part.
Repeated rows count and are scored each.  No training text: a bit costs one bit; the base score is 0.
A very long text is a block of its own, kept as numbers of its distinct words and mixed step by step.  Columns other than those named are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.blocks import numbered, unzipped, unzipped_words, zipped
from papyra.llm.common import fold, forget_written, map_arrow, mark_written, partitions, written

BLOCK_BYTES = 8 << 20
#: Words with a code of one byte, and first bytes of codes of two.
ONE, LEADS = 64, 190
END, SPELL = 254, 255
DICTIONARY = ONE + LEADS * 256
ORDERS = (1, 2, 3, 5)
K = len(ORDERS)
SETS = 12
#: Regressions: one for each set and bit, and that of the flag.
FITS = SETS * 8 + 1
TOKENS, TRIPLES, CONTEXTS = 0, 1, 2
_SCALE = 15.0
_START = np.array([0.05, 0.15, 0.3, 0.6], np.float32)  # what the fit begins with
_RATE, _SLOW = 0.03, 4.0
_P = np.uint64(0xD6E8FEB86659FD93)
_END_HASH = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Texts:
    """Where the tokens of texts lie: of each text its words, then its end."""

    def __init__(self, ends: np.ndarray) -> None:
        self.ends = ends
        self.count = np.diff(ends, prepend=0)  # of words in each text
        self.last = ends + np.arange(len(ends))
        self.text = np.repeat(np.arange(len(ends), dtype=np.int32), self.count + 1)


class Words(Texts):
    """Texts as numbers: the distinct words of a block, and for each text its words' places among them.  The end is the last type."""

    def __init__(self, types: list[bytes], at: np.ndarray, ends: np.ndarray) -> None:
        super().__init__(ends)
        self.types, self.at = types, at
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, types), np.uint64, len(types))
        self.hash = np.append(h, _END_HASH)
        size = np.append(np.fromiter(map(len, types), np.int64, len(types)) + 1, 0)
        self.bytes = np.maximum(self._by_text(size[at]), 1)
        # All tokens: the words of each text and its end.
        self.tokens = np.full(len(at) + len(ends), len(types), np.int32)
        mine = np.ones(len(self.tokens), bool)
        mine[self.last] = False
        self.tokens[mine] = at

    def _by_text(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], self.ends])])

    def triples(self, bits: int) -> np.ndarray:
        """For each token the key of the two before it (bits) and of itself (16 bits)."""
        h = self.hash[self.tokens]
        first = self.last - self.count
        one = np.empty_like(h)
        one[1:] = h[:-1]
        one[first] = 1
        two = np.empty_like(h)
        two[1:] = one[:-1]
        two[first] = 2
        return (_mixed(one * _P + two) >> np.uint64(64 - bits)) << np.uint64(16) | h >> np.uint64(48)


class Coded:
    """The types of a block as coded bytes (rows), the distinct cases of rows, and the distinct pairs of a context and its byte."""

    def __init__(self, types: list[bytes], hashes: np.ndarray, dictionary: np.ndarray, ranks: np.ndarray, bits: int) -> None:
        n = len(types)
        rank = np.full(n, DICTIONARY, np.int64)
        if len(dictionary):
            i = np.minimum(np.searchsorted(dictionary, hashes[:n]), len(dictionary) - 1)
            rank = np.where(dictionary[i] == hashes[:n], ranks[i], DICTIONARY)
        spelled = np.flatnonzero(rank == DICTIONARY)
        length = np.where(rank < ONE, 1, 2)
        length[spelled] = np.fromiter(map(len, map(types.__getitem__, spelled.tolist())), np.int64, len(spelled)) + 2
        self.length = np.append(length, 1)
        self.start = np.cumsum(self.length) - self.length
        rows = int(self.length.sum())
        kind = np.repeat(np.append(np.where(rank == DICTIONARY, 2, 1), 1), self.length).astype(np.uint8)
        where = np.arange(rows) - np.repeat(self.start, self.length)  # in the type
        code = np.empty(rows, np.uint8)
        code[kind == 2] = np.frombuffer(b"".join([b"\xff" + types[i] + b" " for i in spelled.tolist()]), np.uint8)
        short, long = np.flatnonzero(rank < ONE), np.flatnonzero((rank >= ONE) & (rank < DICTIONARY))
        code[self.start[short]] = rank[short]
        code[self.start[long]] = ONE + (rank[long] - ONE) // 256
        code[self.start[long] + 1] = (rank[long] - ONE) % 256
        code[-1] = END
        kind[where == 0] = 0
        # Rows with the same byte after the same longest context are one case: all contexts follow from it.
        most = max(ORDERS)
        where = np.minimum(where, most).astype(np.uint8)
        past = np.ndarray(rows, ">u8", np.concatenate([np.zeros(7, np.uint8), code]), strides=(1,)).astype(np.uint64)  # the last eight bytes
        case = np.left_shift(where + 8 * kind, 48, dtype=np.uint64) | np.left_shift(code, 40, dtype=np.uint64)
        case |= past >> np.uint64(8) & np.array([(1 << 8 * i) - 1 for i in range(most + 1)], np.uint64)[where]
        case, self.case = numbered(case)
        tag = (case >> np.uint64(48)).astype(np.int64)
        where, self.kind = tag % 8, (tag // 8).astype(np.uint8)
        code = case >> np.uint64(40) & np.uint64(255)
        keys = np.empty((K, len(case)), np.uint64)
        for k, back in enumerate(ORDERS):
            tag = (np.minimum(where, back) + 8 * (self.kind.astype(np.int64) + 3 * k)).astype(np.uint64)
            ctx = case & np.uint64((1 << 8 * back) - 1)
            keys[k] = (_mixed(ctx | tag << np.uint64(56)) >> np.uint64(64 - bits)) << np.uint64(8) | code
        self.keys, at = numbered(keys.ravel())
        self.at = at.reshape(K, len(case))

    def counts(self, times: np.ndarray) -> np.ndarray:
        """How often each pair occurs, if each type occurs so many times."""
        own = self.cases(times)
        return sum(np.bincount(x, own, len(self.keys)) for x in self.at).astype(np.int64)

    def cases(self, times: np.ndarray) -> np.ndarray:
        """How often each case occurs, if each type occurs so many times."""
        return np.bincount(self.case, np.repeat(times, self.length), len(self.kind))

    def features(self, odds: np.ndarray) -> np.ndarray:
        """By context and case, [K, cases]: the eight log odds, int8, in one uint64."""
        return np.take(np.ascontiguousarray(odds).view(np.uint64)[:, 0], self.at)

    def gates(self, seen: np.ndarray) -> np.ndarray:
        """Of each case."""
        return (self.kind * 4 + np.take(seen, self.at[-1])).astype(np.uint8)


def path_odds(keys: np.ndarray, count: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each pair's eight bits, int8 [pairs, 8], when `without` of its own events are left out; how often its context was seen, 0 to 3.

    keys: sorted and distinct.
    """
    n = []
    for depth in range(9):
        head = np.concatenate([[True], np.diff(keys >> np.uint64(8 - depth)) != 0]) if len(keys) else np.empty(0, bool)
        at = np.cumsum(head) - 1
        n.append(np.add.reduceat(count, np.flatnonzero(head))[at] if len(keys) else count)
    out = np.empty((len(keys), 8), np.int8)
    for j in range(8):
        own, other = np.maximum(n[j + 1] - without, 0), n[j] - n[j + 1]
        out[:, j] = np.clip(np.round(np.log((own + 0.3) / (other + 0.3)) * _SCALE), -120, 120)
    total = np.maximum(n[0] - without, 0)
    return out, np.searchsorted([1, 4, 32], total, side="right").astype(np.uint8)


def levels(keys: np.ndarray, count: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
    """Eighths of a binary digit, 0 for none: how often each triple's first two words were seen (rounded up), and the triple (rounded down)."""
    if not len(keys):
        return np.empty(0, np.uint8), np.empty(0, np.uint8)
    head = np.concatenate([[True], np.diff(keys >> np.uint64(16)) != 0])
    both = np.maximum(np.add.reduceat(count, np.flatnonzero(head))[np.cumsum(head) - 1] - without, 0)
    own = np.maximum(count - without, 0)
    return (np.where(both > 0, 1 + np.ceil(8 * np.log2(np.maximum(both, 1))), 0).astype(np.uint8),
            np.where(own > 0, 1 + np.floor(8 * np.log2(np.maximum(own, 1))), 0).astype(np.uint8))


#: Steps of the table of probabilities: log odds from -20 to 20 by 1/32.
_ODDS = np.arange(-640, 641) / 32
_SQUASH = 1 / (1 + np.exp(-_ODDS))


class Start:
    """What every text starts with: weights by set, context and bit; odds by set as observed; the flag's priors and weights."""

    def __init__(self) -> None:
        self.weights = np.broadcast_to(_START[None, :, None], (SETS, K, 8)).astype(np.float32)
        self.right = np.broadcast_to(_SQUASH, (SETS, len(_ODDS))).copy()
        self.priors = (np.full(32, 0.1), np.full(36, 0.1))
        self.blend = np.array([0.5, 0.5])

    def table(self) -> np.ndarray:
        """In one look-up by set and odds: nats that a bit costs, and 1 - its probability before the last stage."""
        return (-np.log(self.right)).astype(np.complex64).ravel() + 1j * np.tile((1 - _SQUASH).astype(np.float32), SETS)


def _flags(texts: Texts, both: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """State of each token (0: no flag, 1: flag down, 2: up), and the contexts of the two flag predictors."""
    state = np.where(both == 0, 0, np.where(own > 0, 2, 1)).astype(np.int32)
    past = np.zeros((2, len(state)), np.int32)
    first = texts.last - texts.count
    past[0, 1:] = state[:-1]
    past[0, first] = 0
    past[1, 1:] = past[0, :-1]
    past[1, first] = 0
    bucket = np.minimum(both.astype(np.int32) // 8, 31)
    return state, [bucket, (past[0] * 3 + past[1]) * 4 + np.minimum(bucket, 3)]


def _adaptive(text: np.ndarray, ctx: np.ndarray, bit: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log odds of each flag being up, from the flags of its context earlier in the text and a prior."""
    key = text.astype(np.int64) * len(prior) + ctx
    by = np.argsort(key, kind="stable")
    key, b = key[by], bit[by].astype(np.float64)
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(heads, len(key)))
    ups = np.cumsum(b) - b
    ups -= np.repeat(ups[heads], many)
    seen = np.arange(len(key)) - np.repeat(heads, many)
    p = (ups + 4 * prior[ctx[by]]) / (seen + 4)
    out = np.empty(len(key))
    out[by] = np.log(p / (1 - p))
    return out


def _flag_parts(texts: Texts, both: np.ndarray, own: np.ndarray, start: Start) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State of each token; of those with a flag: their places, whether it is up, and the predictors' log odds [2, n]."""
    state, ctx = _flags(texts, both, own)
    at = np.flatnonzero(state)
    up = state[at] == 2
    odds = np.stack([_adaptive(texts.text[at], c[at], up, p) for c, p in zip(ctx, start.priors)]) if len(at) else np.empty((2, 0))
    return state, at, up, odds


def cost(words: Words, coded: Coded, odds: np.ndarray, seen: np.ndarray, both: np.ndarray, own: np.ndarray, start: Start) -> np.ndarray:
    """Nats that each text costs.  odds, seen: of the coded pairs; both, own: of each token."""
    n = len(words.ends)
    total = np.zeros(n)
    state, at, up, x = _flag_parts(words, both, own, start)
    if len(at):
        price = np.logaddexp(0, np.where(up, -1, 1) * (start.blend @ x))
        hit = at[up]
        price[up] += (both[hit].astype(np.float64) - own[hit]) * (np.log(2) / 8)
        total += np.bincount(words.text[at], price, n)
    feature, gate = coded.features(odds), coded.gates(seen)
    spell = state != 2
    tokens, text = words.tokens[spell], words.text[spell]
    length = coded.length[tokens]
    size = np.bincount(text, length, n).astype(np.int64)
    first = np.cumsum(size) - size
    upto = np.cumsum(length)
    table = start.table()
    by_size = np.argsort(-size, kind="stable")
    by_size = by_size[size[by_size] > 0]
    i = 0
    while i < len(by_size):  # some texts of about the same size at a time
        j, rows = i, 0
        while j < len(by_size) and (j == i or rows + min(int(size[by_size[j]]), 1024) <= 32768):
            rows += min(int(size[by_size[j]]), 1024)
            j += 1
        some = by_size[i:j]
        total[some] += _mix(first[some], size[some], tokens, upto, length, coded.start, coded.case, feature, gate, table, start.weights)
        i = j
    return total


def _mix(
    first: np.ndarray, size: np.ndarray, tokens: np.ndarray, upto: np.ndarray, length: np.ndarray, begin: np.ndarray, case: np.ndarray,
    feature: np.ndarray, gate: np.ndarray, table: np.ndarray, weights: np.ndarray,
) -> np.ndarray:
    """Nats of the coded bytes of some texts, longest first."""
    d = len(size)
    w = np.tile(weights.transpose(1, 0, 2), (1, d, 1)) * np.float32(32 / _SCALE)  # [K, d * SETS, 8], in steps of _ODDS
    past = np.full_like(w, _SLOW)
    total = np.zeros(d)
    done, step = 0, 64
    while done < size[0]:
        live = int(np.searchsorted(-size, -done))
        m = np.minimum(size[:live] - done, step)
        # The coded bytes done .. done + m of each text, by way of the tokens that hold them.
        lo = first[:live] + done
        t0, t1 = np.searchsorted(upto, lo, "right"), np.searchsorted(upto, lo + m, "left") + 1
        many = t1 - t0
        tok = np.arange(many.sum()) + np.repeat(t0 - (np.cumsum(many) - many), many)
        a = np.maximum(np.repeat(lo, many), upto[tok] - length[tok])
        b = np.minimum(np.repeat(lo + m, many), upto[tok])
        row0 = begin[tokens[tok]] + a - (upto[tok] - length[tok])
        span = b - a
        row = case[np.arange(span.sum()) + np.repeat(row0 - (np.cumsum(span) - span), span)]
        key = np.repeat(np.arange(live, dtype=np.int32) * SETS, m) + gate[row]
        by = np.argsort(key.astype(np.uint16) if live * SETS < 1 << 16 else key, kind="stable")
        key, row = key[by], row[by].astype(np.intp)
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(heads, len(key)))
        sets = key[heads].astype(np.intp)
        f, t = [], np.float32(640.5)
        for k in range(K):
            f.append(np.take(feature[k], row).view(np.int8).reshape(-1, 8).astype(np.float32))
            own = np.repeat(w[k][sets], count, axis=0)
            own *= f[k]
            t = np.add(t, own, out=own)
        np.maximum(t, 0, out=t)
        np.minimum(t, 1280, out=t)
        place = t.astype(np.intp)
        place += np.repeat(sets % SETS * len(_ODDS), count)[:, None]
        got = np.take(table, place)
        np.add.at(total, sets // SETS, np.add.reduceat(got.real.ravel(), heads * 8))
        wrong = np.ascontiguousarray(got.imag)
        for k in range(K):
            f[k] *= wrong
            g = np.add.reduceat(f[k], heads, axis=0) * np.float32(1 / _SCALE)
            p = past[k][sets] + g * g
            past[k][sets] = p
            w[k][sets] += np.float32(_RATE * 32 / _SCALE) * g / np.sqrt(p)
        done += step
        step = min(step * 2, 1024)
    return total


def flag_counts(texts: Texts, both: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of the contexts of both flag predictors, one after the other: [flags up, flags]."""
    state, ctx = _flags(texts, both, own)
    at = np.flatnonzero(state)
    up = state[at] == 2
    sizes = [len(p) for p in Start().priors]
    return np.stack([np.concatenate([np.bincount(c[at], w, n) for c, n in zip(ctx, sizes)]) for w in (up, None)]).astype(np.int64)


def priors(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = len(Start().priors[0])
    up, n = counts[:, :first].sum(1)
    p = np.clip((counts[0] + 2 * (up / n if n else 0.1)) / (counts[1] + 2), 0.002, 0.998)
    return p[:first], p[first:]


def byte_events(words: Words, coded: Coded, odds: np.ndarray, seen: np.ndarray, both: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct events of coded bytes, sorted, and their counts.  An event: a regression's number, and the odds of what came by each of its K predictors, int8."""
    many = coded.cases(np.bincount(words.tokens[(both == 0) | (own == 0)], minlength=len(coded.length)))
    some = np.flatnonzero(many)
    gate, many = coded.gates(seen)[some].astype(np.uint64) * np.uint64(8), many[some]
    keys, count = [], []
    for j in range(8):  # bit by bit: less memory at once
        key, bit = gate + np.uint64(j), np.ascontiguousarray(odds[:, j]).view(np.uint8)
        for at in coded.at:
            key = key << np.uint64(8) | bit[at[some]]
        key, at = numbered(key)
        keys.append(key), count.append(np.bincount(at, many, len(key)))
    keys, count = np.concatenate(keys), np.concatenate(count)
    by = np.argsort(keys)
    return keys[by], count[by].astype(np.int64)


def flag_events(texts: Texts, both: np.ndarray, own: np.ndarray, start: Start) -> tuple[np.ndarray, np.ndarray]:
    """The distinct events of flags, sorted, and their counts.  They are of the last regression, with the odds of two predictors, in steps as those of bytes."""
    _, _, up, x = _flag_parts(texts, both, own, start)
    flag = np.full(len(up), FITS - 1, np.uint64)
    flat = np.clip(np.round(np.where(up, 1, -1) * x * _SCALE), -120, 120).astype(np.int8).view(np.uint8)
    for k in range(K):
        flag = flag << np.uint64(8) | (flat[k] if k < len(flat) else np.uint64(0))
    return np.unique(flag, return_counts=True)


def _parted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Events' regressions, and their odds [K, events]."""
    odds = (keys & np.uint64(0xFFFFFFFF)).astype(">u4").view(np.int8).reshape(-1, K)
    return (keys >> np.uint64(32)).astype(np.int64), odds.T / _SCALE


def _slopes(weights: np.ndarray, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By regression: nats that its events cost, their slope by weight downwards and their curve."""
    which, x = _parted(keys)
    t = sum(x[k] * weights[which, k] for k in range(K))
    wrong = np.exp(-np.logaddexp(0, t))
    slope, curve = count * wrong, count * wrong * (1 - wrong)
    parts = [count * np.logaddexp(0, -t), *(slope * a for a in x), *(curve * a * b for a in x for b in x)]
    return np.stack([np.bincount(which, p, FITS) for p in parts], 1)


def _places(weights: np.ndarray, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """By set and step of _ODDS: how many bits came that had these odds."""
    which, x = _parted(keys)
    t = sum(x[k] * weights[which, k] for k in range(K))
    mixed = which < FITS - 1
    place = np.clip(t * 32 + 640.5, 0, 1280).astype(np.int64) + which // 8 * len(_ODDS)
    return np.bincount(place[mixed], count[mixed], SETS * len(_ODDS)).reshape(SETS, -1)


def learn(start: Start, total: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]) -> None:
    """Fits weights, blend and maps.  total: of a function of events and their counts, the sum over all parts of the training texts' events."""
    centre = np.concatenate([np.tile(_START, (FITS - 1, 1)), [[0.5, 0.5, 0, 0]]]).astype(np.float64)
    kept, best, new = centre, np.full(FITS, np.inf), centre
    step = np.zeros_like(centre)
    for _ in range(40):
        got = total(partial(_slopes, new))
        loss = got[:, 0] + 2 * ((new - centre) ** 2).sum(1)
        down = loss <= best + 1e-9 * np.abs(loss)
        kept, best = np.where(down[:, None], new, kept), np.where(down, loss, best)
        newton = np.linalg.solve(got[:, K + 1 :].reshape(FITS, K, K) + 4 * np.eye(K), (got[:, 1 : K + 1] - 4 * (new - centre))[:, :, None])[:, :, 0]
        step = np.where(down[:, None], newton, step / 2)  # back half the way where the last one was too long
        new = kept + step
        if np.abs(step).max() < 1e-3:
            break
    start.weights = kept[:-1].reshape(SETS, 8, K).transpose(0, 2, 1).astype(np.float32)
    start.blend = kept[-1, :2]
    right = total(partial(_places, kept))
    wrong, prior = right[:, ::-1], 200.0
    start.right = np.clip((right + prior * _SQUASH) / (right + wrong + prior), 1e-6, 1 - 1e-6)
    start.right = (start.right + 1 - start.right[:, ::-1]) / 2


def fitted(words: Words, dictionary: np.ndarray, ranks: np.ndarray) -> Start:
    """A start learned from training texts at hand, each event of which is predicted without itself."""
    start = Start()
    if not len(words.ends):
        return start
    coded = Coded(words.types, words.hash, dictionary, ranks, 48)
    odds, seen = path_odds(coded.keys, coded.counts(np.bincount(words.tokens, minlength=len(words.types) + 1)), 1)
    keys, at, count = np.unique(words.triples(48), return_inverse=True, return_counts=True)
    both, own = (x[at] for x in levels(keys, count, 1))
    start.priors = priors(flag_counts(words, both, own))
    own_events = [np.concatenate(x) for x in zip(byte_events(words, coded, odds, seen, both, own), flag_events(words, both, own, start))]
    learn(start, lambda part: part(*own_events))
    return start


# --- Spark


def _split(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The distinct words of texts as they come, A-Z lower-cased, each but the last with a line feed; each word's place among them; where each text's words end."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends, words = words.offsets.to_numpy()[1:], words.values
    some = pc.not_equal(pc.binary_length(words), 0)  # none is where a text begins or ends with white space
    ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[ends]
    words = words.filter(some).dictionary_encode()
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), pa.scalar("\n", pa.large_string()))
    return joined[0].as_buffer().to_pybytes(), words.indices.to_numpy().astype(np.uint32), ends


def _packed(kind: pa.DataType):
    """Blocks of texts of one part each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        open_: dict[bool, list] = {}  # ids, texts, bytes
        rows: dict[bool, list[int]] = {False: [], True: []}  # of this batch, in the open block

        def keep(held: bool) -> None:
            if rows[held]:
                open_[held][1].append(texts.take(pa.array(rows[held])))
                rows[held] = []

        def block(held: bool) -> pa.RecordBatch:
            nonlocal made
            ids, parts, _ = open_.pop(held)
            made += 1
            types, at, ends = _split(pa.concat_arrays(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + made]), pa.array([held]), pa.array([ids], pa.list_(kind)),
                 pa.array([zstandard.compress(types, 3)], pa.binary()), pa.array([zipped(at)], pa.binary()), pa.array([ends], pa.list_(pa.int64()))],
                names=["block", "held", "ids", "types", "at", "ends"],
            )

        for b in batches:
            texts = pc.fill_null(b.column(2).cast(pa.large_binary()).view(pa.large_string()), "")  # a view: bytes need not be UTF-8
            for row, (i, h, size) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(texts).to_pylist())):
                if h in open_ and open_[h][2] + size > BLOCK_BYTES:
                    keep(h)
                    yield block(h)
                own = open_.setdefault(h, [[], [], 0])
                own[0].append(i), rows[h].append(row)
                own[2] += size
            keep(False), keep(True)
        for h in list(open_):
            yield block(h)

    return run


BLOCK = "types binary, at binary, ends array<bigint>"


def _words(types: bytes, at: bytes, ends: pa.Scalar) -> Words:
    return Words(unzipped_words(types), unzipped(at, np.uint32).astype(np.int32), np.asarray(ends.values, np.int64))


def _slices(kind: int, block: int, held: bool, keys: np.ndarray, count: np.ndarray, width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard (top bits of keys of a width): sorted distinct keys and their counts."""
    shard_of = keys >> np.uint64(width - bits)
    cut = np.searchsorted(shard_of, np.arange((1 << bits) + 1, dtype=np.uint64))
    for shard in np.flatnonzero(np.diff(cut)):
        own = slice(cut[shard], cut[shard + 1])
        near = np.diff(keys[own], prepend=np.uint64(int(shard) << (width - bits)))
        row = (zipped(near), zipped(count[own].astype(np.uint32)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([held]), *(pa.array([x], pa.binary()) for x in row)],
            names=["shard", "kind", "block", "held", "k", "n"],
        )


ASKED = "shard int, kind int, block bigint, held boolean, k binary, n binary"
ANSWERED = "block bigint, kind int, shard int, c binary"


def _asked(bits: int, width: int):
    """The tokens and word triples of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, held, types, at = (b.column(j)[i].as_py() for j in range(4))
                words = _words(types, at, b.column(4)[i])
                times = np.bincount(words.at, minlength=len(words.types)) * (not held)
                by = np.argsort(words.hash[:-1], kind="stable")
                yield from _slices(TOKENS, block, held, words.hash[by], times[by], 64, bits)
                keys, count = np.unique(words.triples(width), return_counts=True)
                yield from _slices(TRIPLES, block, held, keys, count * (not held), width + 16, bits)

    return run


def _contexts(bits: int, width: int, dictionary: np.ndarray, ranks: np.ndarray):
    """The pairs of a context and a byte of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, held, types, at = (b.column(j)[i].as_py() for j in range(4))
                words = _words(types, at, b.column(4)[i])
                coded = Coded(words.types, words.hash, dictionary, ranks, width)
                times = np.bincount(words.tokens, minlength=len(words.types) + 1) * (not held)
                yield from _slices(CONTEXTS, block, held, coded.keys, coded.counts(times), width + 8, bits)

    return run


def _answered(bits: int, width: int):
    """Rows sorted by shard and kind: for each block, what the whole corpus says of its keys, in their order.

    Of tokens a shard's last row, of block -1, has its sum and number of training tokens, and its commonest tokens with their counts.
    """

    def row(block: int, kind: int, shard: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["block", "kind", "shard", "c"])

    def answers(shard: int, kind: int, rows: list) -> Iterator[pa.RecordBatch]:
        base = np.uint64(shard << ({TOKENS: 64, TRIPLES: width + 16, CONTEXTS: width + 8}[kind] - bits))
        every = [np.cumsum(unzipped(k, np.uint64), dtype=np.uint64) + base for _, _, k, _ in rows]
        size = [len(k) for k in every]
        keys, at = numbered(np.concatenate(every))
        del every
        count = np.bincount(at, np.concatenate([unzipped(n, np.uint32) for *_, n in rows]), len(keys)).astype(np.int64)
        if kind == TOKENS:
            told = [count, count]
        elif kind == TRIPLES:
            told = [np.stack(levels(keys, count, without), 1) for without in (1, 0)]
        else:
            told = [np.concatenate([x, y[:, None].view(np.int8)], 1) for x, y in (path_odds(keys, count, without) for without in (1, 0))]
        done = 0
        for (block, held, *_), n in zip(rows, size):
            yield row(block, kind, shard, zipped(told[held][at[done : done + n]]))
            done += n
        if kind == TOKENS:
            top = np.argsort(-count, kind="stable")[:DICTIONARY]
            top = top[count[top] > 1]
            sums = np.array([count.sum(), (count > 0).sum()], np.uint64)
            yield row(-1, kind, shard, zipped(np.concatenate([sums, keys[top], count[top].astype(np.uint64)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for shard, kind, *one in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (shard, kind) != now and rows:
                    yield from answers(*now, rows)
                    rows = []
                now = (shard, kind)
                rows.append(one)
        if rows:
            yield from answers(*now, rows)

    return run


def _ask(rows: DataFrame, bits: int, width: int) -> DataFrame:
    asked = rows.repartition(max(1, min(1 << bits, 4 * partitions(rows))), "shard").sortWithinPartitions("shard", "kind", "block")
    return map_arrow(asked, _answered(bits, width), ANSWERED)


def _levels_of(count: np.ndarray) -> np.ndarray:
    """Counts in steps of a sixteenth of a binary digit."""
    return np.floor(16 * np.log2(np.maximum(count.astype(np.float64), 1))).astype(np.int64)


def _dictionary(tops: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Sum and number of training words, and the commonest of them: their hashes, sorted, and ranks.  tops: a row for each shard.

    The words of the highest counts, by steps, that are DICTIONARY at most: shards send a histogram of theirs, then the words above the step.
    """

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = 0
        hist = np.zeros(1024, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                x = unzipped(data, np.uint64)
                n, v, half = n + int(x[0]), v + int(x[1]), (len(x) - 2) // 2
                hist += np.bincount(_levels_of(x[2 + half :]), minlength=1024)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([v], pa.int64()), pa.array([hist.tolist()], pa.list_(pa.int64()))], names=["n", "v", "hist"])

    sums = map_arrow(tops.select("c").coalesce(32), histogram, "n bigint, v bigint, hist array<bigint>").collect()
    n, v = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    hist = np.sum([r["hist"] for r in sums] or [np.zeros(1024, np.int64)], axis=0)
    above = np.cumsum(hist[::-1])[::-1]  # words of a step or higher
    cut = int(np.argmax(above <= DICTIONARY))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                x = unzipped(data, np.uint64)
                half = (len(x) - 2) // 2
                h, c = x[2 : 2 + half], x[2 + half :]
                keep = _levels_of(c) >= cut
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], names=["h", "c"])

    got = map_arrow(tops.select("c"), words, "h binary, c binary").collect()  # DICTIONARY words in all
    h = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["h"], np.uint64) for r in got)])
    c = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["c"], np.uint64) for r in got)])
    order = np.lexsort((h, -c.astype(np.int64)))
    ranks = np.empty(len(h), np.int64)
    ranks[order] = np.arange(len(h))
    by = np.argsort(h)
    return n, v, h[by], ranks[by]


def _told(answers: list, which: int, wide: int, like: type) -> np.ndarray:
    """What the shards answered a block of one kind, in the order of its keys."""
    parts = [x["c"] for x in sorted(answers or [], key=lambda x: x["shard"]) if x["kind"] == which]
    got = [np.frombuffer(zstandard.decompress(c), np.uint8).reshape(wide, -1).T for c in parts]
    return np.ascontiguousarray(np.concatenate([np.empty((0, wide), np.uint8), *got])).view(like)


def _levels_told(words: Words, width: int, known: list) -> tuple[np.ndarray, np.ndarray]:
    """Levels of each token's triple."""
    _, place = numbered(words.triples(width))
    level = _told(known, TRIPLES, 2, np.uint8)[place]
    return level[:, 0], level[:, 1]


PREPARED = "counts binary, levels binary, flags binary, keys binary, times binary"


def _event_rows(keys: np.ndarray, count: np.ndarray, bits: int) -> list[dict]:
    """A row for each shard: sorted distinct events and their counts."""
    shard = _mixed(keys) >> np.uint64(64 - bits)
    by = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[by], np.arange((1 << bits) + 1, dtype=np.uint64))
    parts = [(int(x), by[cut[x] : cut[x + 1]]) for x in np.flatnonzero(np.diff(cut))]
    return [{"shard": x, "k": zipped(np.diff(keys[mine], prepend=np.uint64(0))), "n": zipped(count[mine])} for x, mine in parts]


def _prepared(out: pa.Schema, dictionary: np.ndarray, ranks: np.ndarray, width: int):
    """What later passes need of each block: its types' counts and tokens' levels, and of training blocks the counts of flags and the events of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                held, types, at, known, odds = (b[x][i].as_py() for x in ("held", "types", "at", "known", "odds"))
                words = _words(types, at, b["ends"][i])
                level = _levels_told(words, width, known)
                flags = keys = times = None
                if not held:
                    flags = flag_counts(words, *level).tobytes()
                    coded = Coded(words.types, words.hash, dictionary, ranks, width)
                    pair = _told(odds, CONTEXTS, 9, np.int8)
                    keys, times = byte_events(words, coded, pair[:, :8], pair[:, 8].view(np.uint8), *level)
                    keys, times = zipped(np.diff(keys, prepend=np.uint64(0))), zipped(times)
                new = {"counts": zipped(_told(known, TOKENS, 8, np.int64)[:, 0]), "levels": zipped(np.stack(level, 1)), "flags": flags, "keys": keys, "times": times}
                yield pa.RecordBatch.from_arrays([pa.array([new[x.name]], x.type) if x.name in new else b[x.name].slice(i, 1) for x in out], names=out.names)

    return run


def _levels(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As _prepared has written them."""
    both, own = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, -1)
    return both, own


def _start(blocks: DataFrame, dictionary: np.ndarray, ranks: np.ndarray, bits: int, width: int) -> Start:
    """Learned from all training blocks.  blocks: prepared, with the bytes coded by these ranks and in contexts of this width."""
    training = blocks.where("NOT held")
    start = Start()

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, np.int64) for b in batches for x in b.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(parts).tobytes()], pa.binary())], names=["n"])

    counts = map_arrow(training.select("flags"), flags, "n binary").collect()  # a row of some hundred bytes for each task
    if not counts:
        return start
    start.priors = priors(sum(np.frombuffer(r["n"], np.int64) for r in counts).reshape(2, -1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                flag, many = flag_events(Texts(np.asarray(b.column(0)[i].values, np.int64)), *_levels(b.column(1)[i].as_py()), start)
                keys = np.concatenate([np.cumsum(unzipped(b.column(2)[i].as_py(), np.uint64), dtype=np.uint64), flag])  # flags are the last regression
                yield pa.RecordBatch.from_pylist(_event_rows(keys, np.concatenate([unzipped(b.column(3)[i].as_py(), np.int64), many]), bits), pa.schema([("shard", pa.int32()), ("k", pa.binary()), ("n", pa.binary())]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def whole() -> pa.RecordBatch:
            keys, at = numbered(np.concatenate([np.cumsum(unzipped(k, np.uint64), dtype=np.uint64) for k, _ in rows]))
            count = np.bincount(at, np.concatenate([unzipped(n, np.int64) for _, n in rows]), len(keys)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, count)], names=["k", "n"])

        for b in batches:
            for shard, *one in zip(*(b.column(i).to_pylist() for i in range(3))):
                if shard != now and rows:
                    yield whole()
                    rows = []
                now = shard
                rows.append(one)
        if rows:
            yield whole()

    every = map_arrow(training.select("ends", "levels", "keys", "times"), counted, "shard int, k binary, n binary")
    every = every.repartition(max(1, min(1 << bits, partitions(blocks))), "shard").sortWithinPartitions("shard")
    every = written(map_arrow(every, summed, "k binary, n binary"), "events")

    def total(part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [part(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)) for b in batches for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([sum(own).astype(np.float64).tobytes()], pa.binary())], names=["x"])

        got = map_arrow(every.coalesce(32), run, "x binary").collect()
        return sum(np.frombuffer(r["x"], np.float64) for r in got).reshape(part(np.empty(0, np.uint64), np.empty(0, np.int64)).shape)

    learn(start, total)
    return start


def _collect_garbage(df: DataFrame) -> None:
    """Files of shuffles whose result is written stay on the executors' disks until the driver collects its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _scored(kind: pa.DataType, width: int, n: int, v: int, dictionary: np.ndarray, ranks: np.ndarray, start: Start, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                held, ids, types, at, counts, level, asked = (b[x][i].as_py() for x in ("held", "ids", "types", "at", "counts", "levels", "odds"))
                words = _words(types, at, b["ends"][i])
                by = np.argsort(words.hash[:-1], kind="stable")
                count = np.empty(len(by) + 1, np.float64)
                count[by] = unzipped(counts, np.int64)
                count[-1] = ends
                each = np.log10(count + 1) - np.log10(n + v + 1)
                size = words.count + 1
                base = np.bincount(words.text, each[words.tokens], len(ids))
                in_training = np.bincount(words.text, count[words.tokens] > 0, len(ids)).astype(np.int64)
                pair = _told(asked, CONTEXTS, 9, np.int8)
                coded = Coded(words.types, words.hash, dictionary, ranks, width)
                nats = cost(words, coded, pair[:, :8], pair[:, 8].view(np.uint8), *_levels(level), start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), pa.array([held] * len(ids)), pa.array(size, pa.int64()), pa.array(in_training), pa.array([n] * len(ids), pa.int64()),
                     pa.array(base), pa.array(-nats / np.log(10)), pa.array(nats / np.log(2) / words.bytes)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )

    return run


def score_texts(documents: DataFrame, *, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the words, each with one byte for the gap or end): one row per row of documents."""
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import StructType

    held = fold(F.col(doc_id), 7, 2) if held_out is None else held_out
    docs = documents.select(F.col(doc_id).alias("doc_id"), held.alias("held"), F.col(text).alias("text"))
    name, kind = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    before = mark_written()
    blocks = written(map_arrow(docs, _packed(kind), f"block bigint, held boolean, ids array<{name}>, {BLOCK}"), "blocks")
    many, ends = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(~F.col("held"), F.size("ends"))), F.lit(0))).first()
    bits = min(16, max(3, many.bit_length() - 1))
    width = min(48, many.bit_length() + 27)  # of hashed contexts: 30 for each that a block can hold, or more
    rows = blocks.select("block", "held", "types", "at", "ends")
    answers = written(_ask(map_arrow(rows, _asked(bits, width), ASKED), bits, width), "counts")
    _collect_garbage(documents)
    n, v, dictionary, ranks = _dictionary(answers.where("block = -1"))
    n, v = n + ends, v + (ends > 0)
    contexts = _ask(map_arrow(rows, _contexts(bits, width, dictionary, ranks), ASKED), bits, width)
    listed = F.collect_list(F.struct("kind", "shard", "c"))  # a block's answers: bounded by its size
    known = answers.where("block >= 0").groupBy("block").agg(listed.alias("known"))
    odds = contexts.groupBy("block").agg(listed.alias("odds"))
    rows = blocks.join(known.hint("shuffle_hash"), "block", "left").join(odds.hint("shuffle_hash"), "block", "left")
    kept = f"held boolean, ids array<{name}>, {BLOCK}, odds array<struct<kind int, shard int, c binary>>, {PREPARED}"
    schema = to_arrow_schema(StructType.fromDDL(kept))
    rows = written(map_arrow(rows.select("held", "ids", "types", "at", "ends", "known", "odds"), _prepared(schema, dictionary, ranks, width), kept), "prepared")
    forget_written(before, but=1)
    del answers, contexts, known, odds, blocks
    _collect_garbage(documents)
    start = _start(rows, dictionary, ranks, bits, width)
    out = f"doc_id {name}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return map_arrow(rows.drop("flags", "keys", "times"), _scored(kind, width, n, v, dictionary, ranks, start, ends), out)
