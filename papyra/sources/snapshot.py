"""The commit log of a collection: which segments of Parquet are live.

A commit is one new numbered file that lists all live segments; creating it is
the atomic step of every write.  Segments that no commit lists are leftovers of
writes that failed or are still under way; they are ignored, and removed once they are old.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field, replace

from papyra.errors import CorruptedRecord, IOFailure
from papyra.sources.files import Files

LOG, DATA, CHECKPOINT = "log", "data", "checkpoint"


@dataclass(frozen=True)
class Segment:
    """kind: rows (new documents), delta (replacements) or tomb (deleted keys)."""

    seq: int
    kind: str
    #: Names the folder: two writers never share one, even with the same number.
    run: str = ""
    shards: dict[str, int] = field(default_factory=dict)  # rows by shard
    size: int = 0
    key_bytes: int = 0  # of replaced or deleted keys

    @property
    def rows(self) -> int:
        return sum(self.shards.values())

    @property
    def place(self) -> str:
        return f"_run={self.run}/_seq={self.seq}"


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    segments: tuple[Segment, ...] = ()
    #: Documents replaced or deleted since the last rewrite, by shard.
    dead: dict[str, int] = field(default_factory=dict)
    next_seq: int = 1

    @property
    def documents(self) -> int:
        return sum(s.rows for s in self.segments if s.kind != "tomb") - sum(self.dead.values())

    def with_segments(self, new: list[Segment], dead: dict[str, int]) -> Snapshot:
        more = dict(self.dead)
        for k, n in dead.items():
            more[k] = more.get(k, 0) + n
        return Snapshot(self.version + 1, (*self.segments, *new), more, max([self.next_seq, *(s.seq + 1 for s in new)]))

    def rebased(self, base: Segment | None, next_seq: int) -> Snapshot:
        return Snapshot(self.version + 1, (base,) if base else (), {}, next_seq)


def _encode(s: Snapshot) -> bytes:
    body = json.dumps(asdict(s), sort_keys=True)
    return json.dumps({"crc": zlib.crc32(body.encode()), "body": body}).encode()


def _decode(data: bytes) -> Snapshot | None:
    try:
        outer = json.loads(data)
        if zlib.crc32(outer["body"].encode()) != outer["crc"]:
            return None
        raw = json.loads(outer["body"])
        raw["segments"] = tuple(Segment(**s) for s in raw["segments"])
        return Snapshot(**raw)
    except (ValueError, KeyError, TypeError):
        return None


class CommitLog:
    def __init__(self, files: Files, name: str) -> None:
        self.files, self.name = files, name

    def _at(self, version: int) -> str:
        return f"{self.name}/{LOG}/{version:020d}.json"

    def latest(self) -> Snapshot:
        """The newest snapshot.  The checkpoint spares the listing if it is sound; commits after it are found by their numbers."""
        found = Snapshot()
        mark = f"{self.name}/{CHECKPOINT}"
        if self.files.exists(mark):
            found = _decode(self.files.read(mark)) or found
        if not found.version:
            numbers = [int(n[:-5]) for n in self.files.names(f"{self.name}/{LOG}") if n.endswith(".json")]
            if numbers:
                found = self._sound(max(numbers))
        while self.files.exists(self._at(found.version + 1)):
            found = self._sound(found.version + 1)
        return found

    def _sound(self, version: int) -> Snapshot:
        """A commit.  Commits appear whole, so one that is damaged has lost data: that is an error, not a reason to read an older one."""
        got = _decode(self.files.read(self._at(version)))
        if got is None:
            raise CorruptedRecord(0, f"commit {version} of {self.name}")
        return got

    def commit(self, snapshot: Snapshot) -> None:
        for s in snapshot.segments[-4:]:  # those just staged are the last
            if s.rows and not self.files.exists(f"{self.name}/{DATA}/{s.place}"):
                raise IOFailure(f"segment {s.run} of {self.name} is gone")
        if not self.files.write_new(self._at(snapshot.version), _encode(snapshot)):
            raise IOFailure(f"commit {snapshot.version} of {self.name} exists: another writer was first")

    def checkpoint(self, snapshot: Snapshot) -> None:
        if snapshot.version:
            self.files.replace(f"{self.name}/{CHECKPOINT}", _encode(snapshot))

    def orphans(self, snapshot: Snapshot) -> list[str]:
        live = {f"_run={s.run}" for s in snapshot.segments}
        return [n for n in self.files.names(f"{self.name}/{DATA}") if n not in live]

    def trim(self, snapshot: Snapshot) -> None:
        """Removes commits before the checkpointed snapshot."""
        for n in self.files.names(f"{self.name}/{LOG}"):
            if n.endswith(".json") and int(n[:-5]) < snapshot.version:
                self.files.delete(f"{self.name}/{LOG}/{n}")


__all__ = ["CommitLog", "DATA", "Segment", "Snapshot", "replace"]
