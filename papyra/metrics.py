"""Counters of a collection since it was opened; never persisted."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CollectionMetrics:
    index_lookups: int = 0
    covered_queries: int = 0
    full_scans: int = 0
    partition_scans: int = 0
    bytes_read: int = 0
    bytes_written: int = 0
    compaction_count: int = 0
    last_compaction_duration: float | None = None
    shards_recovered_from_dirty: int = 0


@dataclass(frozen=True)
class CollectionStats:
    name: str
    document_count: int
    shard_count: int
    size_in_bytes: int
    indexes: dict[str, int]
    fragmentation_ratio: float


class Counters:
    def __init__(self) -> None:
        self.now = CollectionMetrics()

    def add(self, **more: int | float) -> None:
        self.now = replace(self.now, **{k: v if k == "last_compaction_duration" else getattr(self.now, k) + v for k, v in more.items()})
