"""Options of databases and collections."""

from __future__ import annotations


from dataclasses import dataclass, field
from enum import Enum

from papyra.errors import UnsupportedCompression


class Compression(str, Enum):
    NONE = "none"
    GZIP = "gzip"
    LZFSE = "lzfse"
    LZ4 = "lz4"

    @property
    def codec(self) -> str:
        """The Parquet codec; lzfse is none."""
        if self is Compression.LZFSE:
            raise UnsupportedCompression(self.value)
        return {"none": "uncompressed", "gzip": "gzip", "lz4": "lz4_raw"}[self.value]


class Format(str, Enum):
    """Kept in the manifest; documents are stored as Parquet either way."""

    JSON = "json"
    MSGPACK = "msgpack"


class Protection(str, Enum):
    """File protection of mobile systems: kept in the manifest, without effect elsewhere."""

    NONE = "none"
    COMPLETE = "complete"
    COMPLETE_UNLESS_OPEN = "completeUnlessOpen"
    UNTIL_FIRST_AUTHENTICATION = "completeUntilFirstUserAuthentication"


@dataclass(frozen=True)
class AutoSync:
    """off(), after_writes(n) or interval(seconds); an interval is checked on the next write."""

    writes: int | None = None
    seconds: float | None = None

    @classmethod
    def off(cls) -> AutoSync:
        return cls()

    @classmethod
    def after_writes(cls, n: int) -> AutoSync:
        return cls(writes=max(1, n))

    @classmethod
    def interval(cls, seconds: float) -> AutoSync:
        return cls(seconds=seconds)


@dataclass(frozen=True)
class DatabaseOptions:
    compression: Compression = Compression.NONE
    protection: Protection = Protection.NONE
    format: Format = Format.JSON
    encryption_key: bytes | None = field(default=None, repr=False)
    max_fragmentation: float = 0.2
    auto_sync: AutoSync = AutoSync()
    #: Seconds that files no commit lists are left alone at open: another writer may be about to commit them.
    recovery_grace: float = 86_400.0
    #: Deleted and replaced ids up to which they are broadcast to readers; beyond, both sides are shuffled.
    broadcast_ids: int = 1_000_000


@dataclass(frozen=True)
class CollectionOptions:
    id_field: str = "id"
    partition_key: str | None = None
    indexed_fields: tuple[str, ...] = ()



