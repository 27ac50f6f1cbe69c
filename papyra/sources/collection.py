"""Collections: documents as immutable Parquet segments under a commit log.

Stored rows carry _key (the id as text), _shard and _seq (the segment's number).  The live view is the union of
all segments without the rows whose key a later segment replaces or deletes:
one anti-join, and none where nothing has been replaced.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import crypto
from papyra.errors import (
    DatabaseClosed, DecodingFailed, DocumentNotFound, DuplicateId, EncodingFailed, IdFieldMissing, PapyraError, PartitionKeyMissing, UnsupportedOperation,
)
from papyra.functions.paths import Dynamic, Resolved, Resolver, Typed
from papyra.functions.values import canonical, compare, describe, describe_column, is_scalar, rank, seconds
from papyra.metrics import CollectionMetrics, CollectionStats, Counters
from papyra.operators.query import Query
from papyra.options import CollectionOptions, DatabaseOptions
from papyra.sources.files import Files
from papyra.sources.snapshot import DATA, CommitLog, Segment, Snapshot

DOC = "doc"
INTERNAL = ("_key", "_shard", "_seq")
LOG = logging.getLogger("papyra")
#: Documents that stream() asks for at a time, at least, and how often it asks at most.
FETCH, MAX_PIECES = 4096, 20_000
#: Bytes of replaced and deleted ids up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
MIN_SLOTS = 100
REWRITE_SHARE = 0.5


class Source:
    """What a query needs of the rows it reads."""

    indexed: frozenset[str] = frozenset()
    partition_key: str | None = None
    resolver: Resolver
    counters: Counters

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def documents(self, rows: DataFrame) -> DataFrame:
        return rows

    def tiebreak(self) -> tuple[Typed | Dynamic, ...]:
        return ()

    def shard_filter(self, value: Any) -> Column | None:
        return None

    def describe(self, field: str, value: Any) -> str:
        """The text of a value of a field, as _text_of() gives it for stored ones."""
        at = self.resolver(field)
        return describe(value, None if at is None or isinstance(at, Dynamic) else at.dtype)

    def check_open(self) -> None:
        pass

    def delete_rows(self, rows: DataFrame) -> int:
        raise UnsupportedOperation("the collection is read-only")

    def find(self) -> Query:
        return Query(self)


class FrameCollection(Source):
    """A read-only collection over any DataFrame or Parquet files.

    json: string columns that hold JSON documents, into which paths may lead.
    """

    def __init__(self, df: DataFrame, *, id_field: str | None = "id", partition_key: str | None = None, indexed: Iterable[str] = (), json: Iterable[str] = ()) -> None:
        self._df, self.id_field, self.partition_key = df, id_field, partition_key
        self.indexed = frozenset(indexed) | ({id_field} if id_field else set())
        self.resolver = Resolver(df.schema, frozenset(json))
        self.counters = Counters()

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, **options: Any) -> FrameCollection:
        return cls(spark.read.parquet(path), **options)

    def frame(self) -> DataFrame:
        return self._df

    def tiebreak(self) -> tuple[Typed | Dynamic, ...]:
        return (Typed(F.col(f"`{self.id_field}`"), self._df.schema[self.id_field].dataType),) if self.id_field else ()

    def all(self) -> DataFrame:
        return self._df

    def get(self, id: Any) -> Row | None:
        return self.find().where(self.id_field, equal_to=id).first()

    def scan_partition(self, value: Any) -> DataFrame:
        at = self.resolver(self.partition_key)
        hit = None if at is None else compare(at.column, at.dtype, "eq", value)
        return self._df.where(F.lit(False) if hit is None else hit)

    def count(self) -> int:
        return self._df.count()

    def stream(self, batch_size: int = 64) -> Iterator[Row]:
        from papyra.streaming.pull import pull

        return pull(self._df, batch_size)


def shard_name(text: str, key: bytes | None = None) -> str:
    """The shard of a partition value's text."""
    if key is not None:
        return crypto.hmac_text(text, key)
    return urllib.parse.quote(text, safe="-_.").replace("~", "%7E") or "_"


def _shard_column(text: Column, key: bytes | None) -> Column:
    if key is not None:
        return crypto.hmac_hex(text, key)
    coded = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.when(text == "", F.lit("_")).otherwise(coded)


class WriteBatch:
    """Collects operations; they take effect together, or none does."""

    def __init__(self) -> None:
        self.operations: list[tuple[str, Any]] = []

    def insert(self, *documents: Mapping[str, Any]) -> None:
        self.operations += [("insert", d) for d in documents]

    def update(self, document: Mapping[str, Any]) -> None:
        self.operations.append(("update", document))

    def upsert(self, document: Mapping[str, Any]) -> None:
        self.operations.append(("upsert", document))

    def delete(self, id: Any) -> None:
        self.operations.append(("delete", id))


class Collection(Source):
    """A handle.  With a schema documents are typed columns, and null is missing; without one they are VARIANT documents."""

    def __init__(self, spark: SparkSession, files: Files, name: str, manifest: dict[str, Any], schema: T.StructType | None, options: DatabaseOptions, recovered: int = 0) -> None:
        self.spark, self.name, self.schema, self.options = spark, name, schema, options
        self._files, self._log = files, CommitLog(files, name)
        self.id_field, self.partition_key = manifest["idField"], manifest["partitionKey"]
        self.indexed = frozenset(manifest["indexedFields"]) | {self.id_field}
        self._secret = options.encryption_key
        if self._secret is not None:
            crypto.hide_key(spark, self._secret)
        self.resolver = Resolver(schema) if schema is not None else Resolver(T.StructType(), document=DOC)
        self.counters = Counters()
        self.counters.add(shards_recovered_from_dirty=recovered)
        self._lock = threading.RLock()
        self._closed = False
        self._snapshot = self._log.latest()
        self._garbage: list[str] = []
        self._writes, self._synced = 0, time.monotonic()

    # reading

    def check_open(self) -> None:
        if self._closed:
            raise DatabaseClosed()

    def _stored(self) -> T.StructType:
        if self._secret is not None:
            body = [T.StructField("payload", T.BinaryType())]
        elif self.schema is None:
            body = [T.StructField(DOC, T.VariantType())]
        else:
            body = [T.StructField(f.name, f.dataType, True) for f in self.schema.fields]
        ends = [T.StructField("_key", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_shard", T.StringType())]
        return T.StructType([*body, *ends])

    def _read(self, segments: Iterable[Segment], schema: T.StructType) -> DataFrame:
        paths = [self._files.at(f"{self.name}/{DATA}/{s.place}") for s in segments if s.rows]
        if not paths:
            return self.spark.createDataFrame([], schema)
        base = self._files.at(f"{self.name}/{DATA}")
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def _live(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Stored rows that no later segment replaces or deletes."""
        s = snapshot or self._snapshot
        rows = self._read([x for x in s.segments if x.kind != "tomb"], self._stored())
        later = [x for x in s.segments if x.kind != "rows"]
        if not later or not s.segments or min(x.seq for x in s.segments) == max(x.seq for x in later):
            return rows
        dead = self._read(later, self._ids()).groupBy("_key").agg(F.max("_seq").alias("_last")).withColumnRenamed("_key", "_gone")
        if sum(x.rows for x in later) <= self.options.broadcast_ids and sum(x.key_bytes for x in later) <= BROADCAST_BYTES:
            dead = F.broadcast(dead)
        return rows.join(dead, (F.col("_key") == F.col("_gone")) & (F.col("_seq") < F.col("_last")), "left_anti")

    def _opened(self, rows: DataFrame) -> DataFrame:
        """Rows with the payload decrypted to columns."""
        if self._secret is None:
            return rows
        text = crypto.decrypt(F.col("payload"), self._secret).cast("string")
        # A payload that doesn't authenticate fails the read; it is never a document of nulls.
        text = F.coalesce(text, F.raise_error(F.lit(crypto.BAD_PAYLOAD)).cast("string"))
        if self.schema is None:
            return rows.select(F.try_parse_json(text).alias(DOC), *INTERNAL)
        return rows.select(F.from_json(text, self.schema).alias("_doc"), *INTERNAL).select("_doc.*", *INTERNAL)

    def frame(self) -> DataFrame:
        self.check_open()
        return self._opened(self._live())

    def documents(self, rows: DataFrame) -> DataFrame:
        return rows.select(*([f"`{f.name}`" for f in self.schema.fields] if self.schema is not None else [DOC]))

    def tiebreak(self) -> tuple[Typed | Dynamic, ...]:
        return (self.resolver(self.id_field),)

    def shard_filter(self, value: Any) -> Column | None:
        return F.col("_shard") == shard_name(self.describe(self.partition_key, value), self._secret)

    def _key_of(self, id: Any) -> str:
        return self._hashed(f"{rank(id)}:{self.describe(self.id_field, id)}")

    def all(self) -> DataFrame:
        """All documents; a DataFrame that has been handed out keeps reading the snapshot it was made from."""
        self.counters.add(full_scans=1, bytes_read=self._bytes())
        return self.documents(self.frame())

    def scan_partition(self, value: Any) -> DataFrame:
        """Documents of the value's shard; an unknown value has none."""
        self.counters.add(partition_scans=1)
        return self.documents(self.frame().where(self.shard_filter(value))) if self.partition_key else self.documents(self.frame())

    def _by_key(self, id: Any) -> DataFrame:
        rows = self._live().where(F.col("_key") == self._key_of(id))
        if self.schema is not None and self._secret is None:  # statistics of the typed column skip row groups
            at = self.resolver(self.id_field)
            hit = compare(at.column, at.dtype, "eq", id)
            rows = rows.where(hit if hit is not None else F.lit(False))
        return rows

    def get(self, id: Any) -> Row | Any | None:
        self.check_open()
        with crypto.decrypting():
            got = self.documents(self._opened(self._by_key(id))).limit(1).collect()
        self.counters.add(index_lookups=1)
        return self._out(got[0]) if got else None

    def _out(self, row: Row) -> Any:
        return row if self.schema is not None else json.loads(row[DOC].toJson())

    def count(self) -> int:
        self.check_open()
        return self._snapshot.documents

    def stream(self, batch_size: int = 64) -> Iterator[Any]:
        """Each live document once, by shard and id text; the snapshot is that of the call.

        The documents are ranged into pieces of about batch_size, FETCH at least (more where that would be over MAX_PIECES pieces),
        and the driver holds one piece at a time: one shuffle, then as many fetches.
        """
        from papyra.streaming.pull import pull

        self.check_open()
        count = self._snapshot.documents
        pieces = min(MAX_PIECES, -(-count // max(FETCH, batch_size)))
        rows = self.frame()
        rows = rows.repartitionByRange(pieces, "_shard", "_key") if pieces > 1 else rows.coalesce(1)
        rows = self.documents(rows.sortWithinPartitions("_shard", "_key"))

        def documents() -> Iterator[Any]:
            with crypto.decrypting():
                for r in pull(rows, batch_size, self.check_open):
                    yield self._out(r)

        return documents()

    # writing

    def _hashed(self, key: str) -> str:
        return crypto.hmac_text(key, self._secret) if self._secret is not None else key

    def _frame_of(self, documents: Iterable[Any] | DataFrame) -> DataFrame:
        """Documents as rows: the stored body and _id, _part (texts), _key, _shard."""
        if isinstance(documents, DataFrame):
            df = documents
            if self.schema is not None:
                missing = [f.name for f in self.schema.fields if f.name not in df.columns]
                df = df.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name in missing else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields))
            elif df.columns != [DOC] or not isinstance(df.schema[DOC].dataType, T.VariantType):
                df = df.select(F.parse_json(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)))).alias(DOC))
        elif self.schema is not None:
            rows = [self._typed(d) for d in documents]
            try:
                df = self.spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema.fields]))
            except (TypeError, ValueError) as e:
                raise EncodingFailed(str(e).splitlines()[0]) from e
            except Exception as e:  # pyspark's own errors for values of the wrong type
                raise EncodingFailed(str(e).splitlines()[0]) from e
        else:
            texts = []
            for d in documents:
                if not isinstance(d, Mapping):
                    raise EncodingFailed("top level is not an object")
                try:
                    texts.append((json.dumps(d, default=_json_scalar),))
                except (TypeError, ValueError) as e:
                    raise EncodingFailed(str(e)) from e
            df = self.spark.createDataFrame(texts, "t string").select(F.parse_json("t").alias(DOC))
        return self._routed(df)

    def _typed(self, d: Any) -> list[Any]:
        if isinstance(d, Row):
            d = d.asDict(recursive=True)
        if not isinstance(d, Mapping):
            raise EncodingFailed("top level is not an object")
        out = []
        for f in self.schema.fields:
            v = d.get(f.name)
            try:
                v = canonical(v) if v is not None and not isinstance(v, (list, tuple, dict, bytes, Row)) else v
            except TypeError:
                pass
            if v is not None and is_scalar(f.dataType) and not _fits(v, f):
                raise EncodingFailed(f"'{f.name}' doesn't fit the schema")
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and isinstance(v, (int, Decimal)) and not isinstance(v, bool):
                v = float(v)
            if isinstance(f.dataType, T.DecimalType) and isinstance(v, (int, float)) and not isinstance(v, bool):
                v = Decimal(str(v))
            out.append(v)
        return out

    def _text_of(self, at: Resolved) -> tuple[Column, Column]:
        """A scalar field's text and type rank; null where missing."""
        if at is None:
            return F.lit(None).cast("string"), F.lit(None).cast("int")
        if isinstance(at, Dynamic):
            return at.label, at.rank
        kind = 3 if isinstance(at.dtype, T.StringType) else 1 if isinstance(at.dtype, T.BooleanType) else 2
        return describe_column(at.column, at.dtype), F.when(at.column.isNotNull(), F.lit(kind))

    def _routed(self, df: DataFrame) -> DataFrame:
        body = [F.col(f"`{c}`") for c in df.columns]
        at = {f: self.resolver(f) for f in (self.id_field, self.partition_key) if f}
        for n, f in enumerate(at):
            if isinstance(at[f], Dynamic):
                df, at[f] = at[f].held(df, f"_{n}", "key", "label")
        text, kind = self._text_of(at[self.id_field])
        key = F.concat(kind.cast("string"), F.lit(":"), text)
        part = self._text_of(at[self.partition_key])[0] if self.partition_key else F.lit("default")
        shard = (_shard_column(part, self._secret) if self.partition_key else part).alias("_shard")
        if self._secret is not None:
            payload = F.to_json(DOC) if self.schema is None else F.to_json(F.struct(*body))
            body = [crypto.encrypt(payload.cast("binary"), self._secret).alias("payload")]
            key_out = crypto.hmac_hex(key, self._secret)
        else:
            key_out = key
        return df.select(*body, text.alias("_id"), part.alias("_part"), key_out.alias("_key"), shard)

    def _held(self, rows: DataFrame) -> DataFrame:
        """Rows that are read several times before they are committed: those of a batch, or keys to delete."""
        return rows.persist()

    def _stage(self, documents: Iterable[Any] | DataFrame, kind: str) -> tuple[Segment, DataFrame]:
        """Writes a segment that no commit lists yet, and checks it; returns it and its keys.

        The documents are computed once; checks read back only the keys.  Whatever is wrong, the segment is removed.
        """
        seen = Observation()
        rows = self._frame_of(documents).observe(
            seen, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_key").isNull(), 1)).alias("no_id"), F.count(F.when(F.col("_part").isNull(), 1)).alias("no_part"),
        )
        seq = self._snapshot.next_seq
        segment, twice = self._put(rows.withColumn("_shard", F.coalesce("_shard", F.lit("_"))), kind, seq, keyed=True)
        keys = self._read([segment], self._ids())
        try:
            if seen.get["no_id"]:
                raise IdFieldMissing(self.id_field)
            if seen.get["no_part"]:
                raise PartitionKeyMissing(self.partition_key)
            if twice is not None:
                raise DuplicateId(self._id_text(segment, twice))
        except PapyraError:
            self._discard(segment)
            raise
        return segment, keys

    def _discard(self, segment: Segment) -> None:
        self._files.delete(f"{self.name}/{DATA}/_run={segment.run}")

    def _id_text(self, segment: Segment, key: str) -> str:
        """The id that a key stands for, of one of the segment's documents."""
        row = self._opened(self._read([segment], self._stored()).where(F.col("_key") == key))
        return row.select(self._text_of(self.resolver(self.id_field))[0].alias("id")).first()["id"]

    def _ids(self) -> T.StructType:
        return T.StructType([f for f in self._stored().fields if f.name in INTERNAL])

    def _write(self, rows: DataFrame, kind: str, seq: int) -> Segment:
        return self._put(rows, kind, seq)[0]

    def _put(self, rows: DataFrame, kind: str, seq: int, keyed: bool = False) -> tuple[Segment, str | None]:
        """Writes a segment and counts it; keyed: finds a key that it holds twice, too."""
        stored = [f.name for f in self._stored().fields if f.name != "_seq"]
        columns = ["_key", "_shard"] if kind == "tomb" else stored
        segment = Segment(seq, kind, f"r{uuid.uuid4().hex[:12]}")
        name = f"{self.name}/{DATA}/{segment.place}"
        writer = rows.select(*columns).write.option("compression", self.options.compression.codec)
        if kind != "tomb":
            for f in sorted(self.indexed):
                if self._secret is None and self.schema is not None and f in self.schema.names:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{f}", "true")
        writer.partitionBy("_shard").parquet(self._files.at(name))
        back = self.spark.read.schema(self._ids()).option("basePath", self._files.at(f"{self.name}/{DATA}")).parquet(self._files.at(name))
        if keyed:
            back = back.groupBy("_key").agg(F.count(F.lit(1)).alias("m"), F.min("_shard").alias("_shard"))
        n = F.col("m") if keyed else F.lit(1)
        counts = back.groupBy("_shard").agg(
            F.sum(n).alias("n"), (F.sum(F.octet_length("_key") * n) if kind != "rows" else F.lit(0)).alias("bytes"), (F.min(F.when(F.col("m") > 1, F.col("_key"))) if keyed else F.lit(None)).alias("twice"),
        ).collect()
        size = self._files.size(name)
        self.counters.add(bytes_written=size)
        segment = replace(segment, shards={r["_shard"]: r["n"] for r in counts}, size=size, key_bytes=sum(r["bytes"] or 0 for r in counts))
        return segment, min((r["twice"] for r in counts if r["twice"] is not None), default=None)

    def _dead(self, keys: DataFrame) -> dict[str, int]:
        """Live rows, by shard, that a write of these keys replaces."""
        if not self._snapshot.documents:
            return {}
        got = self._live().join(keys.select("_key").distinct(), "_key", "left_semi").groupBy("_shard").count().collect()
        return {r["_shard"]: r["count"] for r in got}

    def _commit(self, snapshot: Snapshot, writes: int) -> None:
        self._log.commit(snapshot)
        self._snapshot = snapshot
        LOG.info("%s: commit %d, %d documents in %d segments", self.name, snapshot.version, snapshot.documents, len(snapshot.segments))
        self._writes += writes
        auto = self.options.auto_sync
        if auto.writes is not None and self._writes >= auto.writes or auto.seconds is not None and time.monotonic() - self._synced >= auto.seconds:
            self.sync()

    def insert(self, document: Mapping[str, Any]) -> None:
        self.insert_many([document])

    def insert_many(self, documents: Iterable[Any] | DataFrame) -> int:
        """All documents, or none: ids must be new, in the collection and among themselves."""
        with self._lock:
            self.check_open()
            if not isinstance(documents, DataFrame):
                documents = list(documents)
                if not documents:
                    return 0
            segment, keys = self._stage(documents, "rows")
            if segment.rows and self._snapshot.documents:
                old = keys.join(self._live().select("_key"), "_key", "left_semi").agg(F.min("_key").alias("k")).first()["k"]
                if old is not None:
                    error = DuplicateId(self._id_text(segment, old))
                    self._discard(segment)
                    raise error
            return self._add(segment, {})

    insert_batch = insert_many

    def _add(self, segment: Segment, dead: dict[str, int]) -> int:
        if segment.rows:
            try:
                self._commit(self._snapshot.with_segments([segment], dead), segment.rows)
            except PapyraError:
                self._discard(segment)
                raise
        else:
            self._discard(segment)
        return segment.rows

    def _replace(self, documents: Iterable[Any] | DataFrame, must_exist: bool) -> int:
        with self._lock:
            self.check_open()
            segment, keys = self._stage(documents, "delta")
            if not segment.rows:
                return self._add(segment, {})
            dead = self._dead(keys)
            if must_exist and sum(dead.values()) < segment.rows:
                gone = keys.join(self._live().select("_key"), "_key", "left_anti").agg(F.min("_key").alias("k")).first()["k"]
                error = DocumentNotFound(self._id_text(segment, gone))
                self._discard(segment)
                raise error
            return self._add(segment, dead)

    def update(self, document: Mapping[str, Any]) -> None:
        self._replace([document], must_exist=True)

    def upsert(self, document: Mapping[str, Any]) -> None:
        self._replace([document], must_exist=False)

    def update_many(self, documents: Iterable[Any] | DataFrame) -> int:
        return self._replace(documents if isinstance(documents, DataFrame) else list(documents), must_exist=True)

    def upsert_many(self, documents: Iterable[Any] | DataFrame) -> int:
        return self._replace(documents if isinstance(documents, DataFrame) else list(documents), must_exist=False)

    def patch(self, id: Any, changes: Mapping[str, Any]) -> Any:
        """Sets top-level scalars and returns the document; nothing is written unless the result fits the schema."""
        with self._lock:
            self.check_open()
            for name, value in changes.items():
                if "." in name:
                    raise UnsupportedOperation(f"patch of the nested field '{name}'")
                if name == self.id_field:
                    raise UnsupportedOperation("patch of the id field")
                try:
                    canonical(value)
                except TypeError as e:
                    raise UnsupportedOperation(f"patch of '{name}' with a value that is no scalar") from e
            old = self.get(id)
            if old is None:
                raise DocumentNotFound(self.describe(self.id_field, id))
            if not changes:
                return old
            merged = {**(old.asDict(recursive=True) if isinstance(old, Row) else old), **changes}
            if self.schema is not None:
                unknown = [n for n in changes if n not in self.schema.names]
                bad = [f.name for f in self.schema.fields if f.name in changes and not _fits(changes[f.name], f)]
                if unknown or bad:
                    raise DecodingFailed(f"'{(unknown + bad)[0]}' doesn't fit the schema")
            self._replace([merged], must_exist=True)
            return self.get(id)

    def delete(self, id: Any) -> bool:
        return self.delete_many([id]) == 1

    def delete_many(self, ids: Iterable[Any]) -> int:
        """Removes those that are there; returns their number."""
        with self._lock:
            self.check_open()
            keys = sorted({self._key_of(i) for i in ids})
            if not keys:
                return 0
            return self._delete(self.spark.createDataFrame([(k,) for k in keys], "_key string"))

    def delete_rows(self, rows: DataFrame) -> int:
        with self._lock:
            self.check_open()
            return self._delete(rows.select("_key"))

    def _delete(self, keys: DataFrame) -> int:
        if not self._snapshot.documents:
            return 0
        hit = self._held(self._live().join(keys.distinct(), "_key", "left_semi").select("_key", "_shard"))
        try:
            dead = {r["_shard"]: r["count"] for r in hit.groupBy("_shard").count().collect()}
            n, seq = sum(dead.values()), self._snapshot.next_seq
            if not n:
                return 0
            if n >= REWRITE_SHARE * self._snapshot.documents:  # rewriting the survivors is the smaller work
                left = self._live().join(hit.select("_key"), "_key", "left_anti")
                self._rebase(left, self._snapshot.documents - n, n)
            else:
                self._commit(self._snapshot.with_segments([self._write(hit, "tomb", seq)], dead), n)
            return n
        finally:
            hit.unpersist()

    def _rebase(self, rows: DataFrame, count: int, writes: int) -> None:
        old, seq = self._snapshot, self._snapshot.next_seq
        if self.schema is not None and self._secret is None:
            at = self.resolver(self.id_field)
            rows = rows.repartition("_shard", F.pmod(F.xxhash64("_key"), F.lit(8))).sortWithinPartitions("_shard", at.column)
        base = self._write(rows, "rows", seq) if count else None
        self._commit(old.rebased(base, seq + 1), writes)
        self._sweep()
        for n in dict.fromkeys(f"{self.name}/{DATA}/_run={s.run}" for s in old.segments):
            self._files.replace(f"{n}/_replaced", b"")  # from now on it ages
            self._garbage.append(n)

    def _sweep(self) -> None:
        """Deletes what was replaced longer ago than the grace time; other handles may still read what is younger."""
        for n in list(self._garbage):
            if self._files.age(n) >= self.options.recovery_grace:
                self._files.delete(n)
                self._garbage.remove(n)

    def write_batch(self, body: Callable[[WriteBatch], None]) -> None:
        """Runs body on a buffer and applies it in one commit.  If body raises, or anything is wrong, nothing is written."""
        batch = WriteBatch()
        body(batch)
        with self._lock:
            self.check_open()
            if not batch.operations:
                return
            if all(kind == "insert" for kind, _ in batch.operations):
                self.insert_many([d for _, d in batch.operations])
                return
            by = {k: [d for kind, d in batch.operations if kind == k] for k in ("insert", "update", "upsert", "delete")}
            frames = {k: self._held(self._frame_of(by[k])) for k in ("insert", "update", "upsert") if by[k]}
            try:
                self._apply(batch, frames, by["delete"])
            finally:
                for f in frames.values():
                    f.unpersist()

    def _apply(self, batch: WriteBatch, frames: dict[str, DataFrame], deletes: list[Any]) -> None:
        seen: dict[str, str] = {}
        rows = {k: iter(f.select("_key", "_id", "_part").collect()) for k, f in frames.items()}  # as many as the caller passed in
        for kind, value in batch.operations:
            if kind == "delete":
                key, id = self._key_of(value), self.describe(self.id_field, value)
            else:
                r = next(rows[kind])
                key, id = r["_key"], r["_id"]
                if key is None:
                    raise IdFieldMissing(self.id_field)
                if r["_part"] is None:
                    raise PartitionKeyMissing(self.partition_key)
            if key in seen:
                if kind == seen[key] == "insert":
                    raise DuplicateId(id)
                raise UnsupportedOperation(f"two operations on the id '{id}' in one batch")
            seen[key] = kind
        live = self._live().select("_key")
        if "insert" in frames:
            old = frames["insert"].join(live, "_key", "left_semi").agg(F.min("_id").alias("id")).first()["id"]
            if old is not None:
                raise DuplicateId(old)
        if "update" in frames:
            gone = frames["update"].join(live, "_key", "left_anti").agg(F.min("_id").alias("id")).first()["id"]
            if gone is not None:
                raise DocumentNotFound(gone)
        seq, new = self._snapshot.next_seq, []
        keys = self.spark.createDataFrame([(self._key_of(i),) for i in deletes] or [], "_key string")
        dead: dict[str, int] = {}
        if "insert" in frames:
            new.append(self._write(frames["insert"], "rows", seq + len(new)))
        for k in ("update", "upsert"):
            if k in frames:
                for s, n in self._dead(frames[k]).items():
                    dead[s] = dead.get(s, 0) + n
                new.append(self._write(frames[k], "delta", seq + len(new)))
        if deletes:
            hit = self._live().join(keys, "_key", "left_semi").select("_key", "_shard")
            tomb = self._write(hit, "tomb", seq + len(new))
            if tomb.rows:
                new.append(tomb)
                for s, n in tomb.shards.items():
                    dead[s] = dead.get(s, 0) + n
        if new:
            self._commit(self._snapshot.with_segments(new, dead), len(batch.operations))

    # upkeep

    def _bytes(self) -> int:
        return sum(s.size for s in self._snapshot.segments)

    def compact(self) -> None:
        """Rewrites the live documents without what has been replaced or deleted, and syncs."""
        with self._lock:
            self.check_open()
            began, size = time.monotonic(), self._bytes()
            self._rebase(self._live(), self._snapshot.documents, 0)
            self.sync()
            self.counters.add(compaction_count=1, bytes_read=size, last_compaction_duration=time.monotonic() - began)

    def needs_compaction(self) -> bool:
        """Some shard has more than 100 slots, and the set share of them is dead."""
        self.check_open()
        slots: dict[str, int] = {}
        for s in self._snapshot.segments:
            if s.kind != "tomb":
                for k, n in s.shards.items():
                    slots[k] = slots.get(k, 0) + n
        return any(n > MIN_SLOTS and self._snapshot.dead.get(k, 0) / n >= self.options.max_fragmentation for k, n in slots.items())

    def sync(self) -> None:
        with self._lock:
            self.check_open()
            self._log.checkpoint(self._snapshot)
            self._log.trim(self._snapshot)
            self._writes, self._synced = 0, time.monotonic()

    def stats(self) -> CollectionStats:
        self.check_open()
        s, rows = self._snapshot, self.frame()
        paths = sorted(self.indexed)
        def present(p: str) -> Column:
            at = self.resolver(p)
            return F.lit(False) if at is None else at.present if isinstance(at, Dynamic) else at.column.isNotNull()
        got = rows.agg(*(F.count(F.when(present(p), 1)).alias(f"c{i}") for i, p in enumerate(paths))).first()
        slots = sum(x.rows for x in s.segments if x.kind != "tomb")
        shards = {k for x in s.segments if x.kind != "tomb" for k in x.shards}
        return CollectionStats(self.name, s.documents, len(shards), self._bytes(), {p: got[i] for i, p in enumerate(paths)}, sum(s.dead.values()) / slots if slots else 0.0)

    def metrics(self) -> CollectionMetrics:
        self.check_open()
        return self.counters.now

    def close(self) -> None:
        """Syncs and closes; closing again does nothing."""
        with self._lock:
            if not self._closed:
                self.sync()
                self._sweep()
                self._closed = True


def _json_scalar(value: Any) -> Any:
    v = canonical(value)
    return v if isinstance(v, (bool, int, float, str, type(None))) else float(v) if isinstance(v, Decimal) else seconds(v)


def _fits(value: Any, f: T.StructField) -> bool:
    try:
        v = canonical(value)
    except TypeError:
        return False
    t = f.dataType
    if v is None:
        return f.nullable
    if isinstance(t, T.BooleanType):
        return isinstance(v, bool)
    if isinstance(v, bool):
        return False
    if isinstance(t, T.StringType):
        return isinstance(v, str)
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return isinstance(v, (int, float, Decimal))
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        bits = {T.LongType: 63, T.IntegerType: 31, T.ShortType: 15, T.ByteType: 7}[type(t)]
        return isinstance(v, int) and -(1 << bits) <= v < 1 << bits
    return rank(v) == 2 and not isinstance(v, (int, float, str, Decimal))
