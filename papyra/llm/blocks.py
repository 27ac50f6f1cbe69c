"""Texts packed in blocks as numbers of their distinct words, and keys of 64 bits sent to shards and back."""

from __future__ import annotations

import numpy as np
import zstandard

_P = np.uint64(0xD6E8FEB86659FD93)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and each key's place among them.  Most are told apart by one scatter, the rest by sorting."""
    bits = max(8, len(keys).bit_length() - 1)
    slot = (keys * _P >> np.uint64(64 - bits)).astype(np.int32)
    table, used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool)
    table[slot] = keys
    used[slot] = True
    place = (np.cumsum(used, dtype=np.int32) - np.int32(1))[slot]
    bad = np.flatnonzero(table[slot] != keys)
    rest, own = np.unique(keys[bad], return_inverse=True)
    found = table[used]
    place[bad] = len(found) + own
    found = np.concatenate([found, rest])
    by = np.argsort(found)
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    return found[by], rank[place]


def zipped(x: np.ndarray) -> bytes:
    """Numbers, compressed: all first bytes, all second ones and so on."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.nbytes // max(1, len(x))).T.tobytes(), 1)


def unzipped(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind)[:, 0]


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def zipped_words(words: list[bytes]) -> bytes:
    """Words without line feeds."""
    return zstandard.compress(b"\n".join(words), 3)


def unzipped_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    return raw.split(b"\n") if raw else []
