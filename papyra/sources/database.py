"""Databases: a folder of collections."""

from __future__ import annotations

import json
import logging
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from papyra import crypto
from papyra.errors import CollectionNotFound, CollectionTypeMismatch, DatabaseClosed, DecryptionFailed, InvalidFileFormat
from papyra.options import CollectionOptions, DatabaseOptions
from papyra.sources.collection import Collection
from papyra.sources.files import Files
from papyra.sources.snapshot import DATA, CommitLog

MANIFEST = "manifest.json"
VERSION = 1
LOG = logging.getLogger("papyra")
_MAY_CHANGE = ("indexedFields", "maxFragmentation")


class Database:
    """Opens or creates the folder at path; collections are cached by name."""

    def __init__(self, spark: SparkSession, path: str, options: DatabaseOptions = DatabaseOptions()) -> None:
        options.compression.codec  # noqa: B018 - raises for a codec that isn't there
        self.spark, self.options = spark, options
        self._files = Files(spark, path)
        self._files.make("")
        self._open: dict[str, Collection] = {}
        self._closed = False

    @property
    def path(self) -> str:
        return self._files.root

    def _check(self) -> None:
        if self._closed:
            raise DatabaseClosed()

    def _manifest(self, name: str) -> dict[str, Any] | None:
        at = f"{name}/{MANIFEST}"
        if not self._files.exists(at):
            return None
        data, key = self._files.read(at), self.options.encryption_key
        try:
            plain = json.loads(data)
        except ValueError:
            plain = None
        if key is not None and plain is None:
            crypto.hide_key(self.spark, key)
            return json.loads(crypto.unseal(self.spark, data, key))
        if plain is None:
            raise DecryptionFailed()
        if not isinstance(plain, dict) or "idField" not in plain:
            raise InvalidFileFormat(f"manifest of {name}")
        return plain

    def _save(self, name: str, manifest: dict[str, Any]) -> None:
        data, key = json.dumps(manifest, sort_keys=True).encode(), self.options.encryption_key
        if key is not None:
            crypto.hide_key(self.spark, key)
            data = crypto.seal(self.spark, data, key)
        self._files.replace(f"{name}/{MANIFEST}", data)

    def collection(self, name: str, schema: T.StructType | str | None = None, options: CollectionOptions = CollectionOptions()) -> Collection:
        """A handle on the collection, created if it isn't there.  All but its indexed fields and the fragmentation limit must be as they were."""
        self._check()
        o = self.options
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        wanted = {
            "version": VERSION, "name": name, "idField": options.id_field, "partitionKey": options.partition_key, "indexedFields": sorted(options.indexed_fields),
            "compression": o.compression.value, "protection": o.protection.value, "format": o.format.value, "isEncrypted": o.encryption_key is not None,
            "maxFragmentation": o.max_fragmentation,
        }
        found = self._manifest(name)
        if found is not None and any(found.get(k) != v for k, v in wanted.items() if k not in _MAY_CHANGE):
            raise CollectionTypeMismatch(name)
        if name in self._open and found == wanted and self._open[name].schema == schema:
            return self._open[name]
        recovered = 0
        if found != wanted:
            self._files.make(f"{name}/{DATA}")
            self._save(name, wanted)
        if name in self._open:
            self._open.pop(name).close()
        else:
            recovered = self.vacuum(name)
        self._open[name] = Collection(self.spark, self._files, name, wanted, schema, o, recovered)
        return self._open[name]

    def vacuum(self, name: str, older_than: float | None = None) -> int:
        """Removes segments that no commit lists and that have not changed for so many seconds; returns how many shards they had touched.

        Done at open with DatabaseOptions.recovery_grace, so that writes under way elsewhere are spared.
        """
        grace = self.options.recovery_grace if older_than is None else older_than
        log = CommitLog(self._files, name)
        shards = set()
        for orphan in log.orphans(log.latest()):
            at = f"{name}/{DATA}/{orphan}"
            if self._files.age(at) < grace:
                continue
            LOG.info("removing %s, which no commit of %s lists", orphan, name)
            for part in self._files.names(at):
                shards |= {n for n in self._files.names(f"{at}/{part}") if n.startswith("_shard=")}
            self._files.delete(at)
        return len(shards)

    def list_collections(self) -> list[str]:
        self._check()
        return [n for n in self._files.names("") if self._files.exists(f"{n}/{MANIFEST}")]

    def drop(self, name: str) -> None:
        self._check()
        if not self._files.exists(f"{name}/{MANIFEST}"):
            raise CollectionNotFound(name)
        LOG.info("dropping %s", name)
        if name in self._open:
            self._open.pop(name).close()
        self._files.delete(name)

    def compact(self) -> None:
        """Compacts each open collection that needs it."""
        self._check()
        for c in self._open.values():
            if c.needs_compaction():
                c.compact()

    def sync(self) -> None:
        self._check()
        for c in self._open.values():
            c.sync()

    def close(self) -> None:
        """Syncs and closes all; later calls raise, closing again doesn't."""
        for c in self._open.values():
            c.close()
        self._closed = True
