"""Sums of fixed-size dense arrays over all partitions, without collecting one array for each of them.

A partition sends its array in compressed blocks.  Blocks are added up in two
shuffles, first by (block, salt), so that no task reads the blocks of all partitions, and then by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.common import map_arrow

SCHEMA = "block int, salt int, data binary"


def pack(array: np.ndarray, block: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Rows for an integer array (its length a multiple of block); blocks of zeros are left out."""
    for i in range(0, len(array), block):
        part = array[i : i + block]
        if part.any():
            data = zlib.compress(part.astype(np.int64).tobytes() if part.max() >= 1 << 31 else part.astype(np.int32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // block], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())], names=["block", "salt", "data"]
            )


def unpack(data: bytes, block: int) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, np.int64 if len(raw) == 8 * block else np.int32).astype(np.int64)


def _add(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        salt = 0
        for b in batches:
            for k, s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x, salt = unpack(d, block), s
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sorted(sums.items()):
            for row in pack(x, block, salt):
                yield row.set_column(0, "block", pa.array([k], pa.int32()))

    return run


def summed(rows: DataFrame, block: int, blocks: int) -> DataFrame:
    """One row for each block that isn't zero.  rows: of pack(), with salts from 0 to 3."""
    first = map_arrow(rows.repartition(min(blocks * 4, 128), "block", "salt"), _add(block), SCHEMA)
    return map_arrow(first.repartition(min(blocks, 64), "block"), _add(block), SCHEMA)


def gathered(rows: DataFrame, block: int, blocks: int) -> np.ndarray:
    """The whole sum, on the driver: blocks x block numbers, whatever the input."""
    out = np.zeros(blocks * block, np.int64)
    for r in summed(rows, block, blocks).toLocalIterator():
        out[r["block"] * block : (r["block"] + 1) * block] = unpack(bytes(r["data"]), block)
    return out
