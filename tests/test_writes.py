"""Writes: all or nothing, against a dict as the model; upkeep, recovery and encryption."""

from __future__ import annotations

import random

import pytest

from papyra import AutoSync, CollectionOptions, Compression, Database, DatabaseOptions, crypto
from papyra import errors as E
from papyra.streaming.changes import changes

SCHEMA = "id BIGINT, name STRING, age BIGINT, city STRING"
OPTIONS = CollectionOptions("id", "city", ("age",))


def doc(i, city="BR", **more):
    return {"id": i, "name": f"n{i}", "age": i % 50, "city": city, **more}


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def state(c):
    return {r["id"]: r.asDict() for r in c.all().collect()}


def test_single_writes(db):
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert(doc(1))
    with pytest.raises(E.DuplicateId):
        c.insert(doc(1))
    c.insert_many([doc(2, "US"), doc(3, "")])
    with pytest.raises(E.DuplicateId):
        c.insert_many([doc(4), doc(4)])
    assert c.insert_many([]) == 0
    with pytest.raises(E.IdFieldMissing):
        c.insert({"name": "x", "city": "BR"})
    with pytest.raises(E.PartitionKeyMissing):
        c.insert({"id": 9})
    with pytest.raises(E.EncodingFailed):
        c.insert(doc(9, name=["no text"]))
    with pytest.raises(E.EncodingFailed):
        c.insert("no object")
    c.update(doc(2, "PT"))
    with pytest.raises(E.DocumentNotFound):
        c.update(doc(77))
    c.upsert(doc(5, "a/b c*~"))
    assert c.patch(5, {"name": "five", "age": None})["name"] == "five"
    assert c.patch(5, {})["name"] == "five"
    for bad, error in [({"id": 6}, E.UnsupportedOperation), ({"a.b": 1}, E.UnsupportedOperation), ({"age": "old"}, E.DecodingFailed), ({"age": [1]}, E.UnsupportedOperation)]:
        with pytest.raises(error):
            c.patch(5, bad)
    with pytest.raises(E.DocumentNotFound):
        c.patch(66, {"name": "x"})
    assert c.get(2)["city"] == "PT" and c.get(66) is None and c.count() == 4
    assert c.delete(1) is True and c.delete(1) is False
    assert [r["id"] for r in c.scan_partition("a/b c*~").collect()] == [5] and c.scan_partition("zz").count() == 0
    assert sorted(state(c)) == [2, 3, 5]
    assert str(E.DuplicateId(3)) == "A document with id '3' already exists"


def test_batches(db):
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(i) for i in range(10)])
    before, version = state(c), c._snapshot.version

    def fails(error, *steps):
        with pytest.raises(error):
            c.write_batch(lambda b: [s(b) for s in steps])
        assert c._snapshot.version == version and state(c) == before

    new = lambda b: b.insert(doc(20))
    fails(E.DuplicateId, new, lambda b: b.insert(doc(20)), lambda b: b.delete(3))
    fails(E.UnsupportedOperation, new, lambda b: b.delete(20))
    fails(E.DocumentNotFound, new, lambda b: b.update(doc(30)))
    fails(E.DuplicateId, new, lambda b: b.insert(doc(1)), lambda b: b.delete(2))
    fails(ZeroDivisionError, new, lambda b: 1 / 0)
    fails(E.PartitionKeyMissing, new, lambda b: b.upsert({"id": 5}))
    c.write_batch(lambda b: None)
    assert c._snapshot.version == version
    c.write_batch(lambda b: (b.insert(doc(20), doc(21)), b.update(doc(1, "US")), b.upsert(doc(22)), b.delete(2), b.delete(99)))
    assert c._snapshot.version == version + 1
    assert sorted(state(c)) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 20, 21, 22] and c.count() == 12 and c.get(1)["city"] == "US"


def test_random_writes_match_a_dict(db):
    c, want, rng = db.collection("c", SCHEMA, OPTIONS), {}, random.Random(7)
    for step in range(14):
        kind, some = rng.choice(["upsert", "insert", "delete", "batch", "compact", "query"]), rng.sample(range(40), 6)
        city = rng.choice(["BR", "US", "PT"])
        if kind == "upsert":
            c.upsert_many([doc(i, city, name=f"v{step}") for i in some])
            want |= {i: doc(i, city, name=f"v{step}") for i in some}
        elif kind == "insert":
            fresh = [i for i in some if i not in want]
            c.insert_many([doc(i, city) for i in fresh])
            want |= {i: doc(i, city) for i in fresh}
        elif kind == "delete":
            assert c.delete_many(some) == sum(i in want for i in some)
            want = {i: d for i, d in want.items() if i not in some}
        elif kind == "batch":
            a, b, d = some[:2], some[2:4], some[4:]
            c.write_batch(lambda x: ([x.upsert(doc(i, city)) for i in a + b], [x.delete(i) for i in d]))
            want = {i: v for i, v in {**want, **{i: doc(i, city) for i in a + b}}.items() if i not in d}
        elif kind == "compact":
            c.compact()
        else:
            hit = sorted((v["age"], i) for i, v in want.items() if v["age"] < 20)[1:4]
            assert c.find().where("age", less_than=20).sort("age").offset(1).limit(3).delete() == len(hit)
            want = {i: v for i, v in want.items() if i not in [x for _, x in hit]}
        assert state(c) == want and c.count() == len(want), (step, kind)


def test_handed_out_frames_survive_a_compaction(db):
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(i) for i in range(6)])
    c.delete_many([0])
    old = c.all()
    c.compact()
    assert old.count() == 5 and c.count() == 5
    assert c.delete_many([1, 2, 3]) == 3  # a majority: the survivors are rewritten
    assert len(c._snapshot.segments) == 1 and sorted(state(c)) == [4, 5]
    assert c.delete_many([4, 5]) == 2 and state(c) == {} and c.count() == 0


def test_needs_compaction_and_stats(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", DatabaseOptions(max_fragmentation=0.3))
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(i) for i in range(150)] + [doc(1000, "US", age=None)])
    c.delete_many(range(40))
    s = c.stats()
    assert (s.document_count, s.shard_count, s.indexes) == (111, 2, {"id": 111, "age": 110}) and s.size_in_bytes > 0 and 0.26 < s.fragmentation_ratio < 0.27
    assert not c.needs_compaction()
    c.delete_many(range(40, 50))
    assert c.needs_compaction()
    db.compact()
    assert not c.needs_compaction() and c.stats().fragmentation_ratio == 0
    m = c.metrics()
    assert m.compaction_count == 1 and m.bytes_written > 0 and m.bytes_read > 0 and m.last_compaction_duration > 0


def test_reopen_recovers_and_checks_configuration(spark, tmp_path, db):
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(i) for i in range(5)])
    rows = c._frame_of([doc(50), doc(51, "US")])
    c._write(rows, "rows", c._snapshot.next_seq)  # a write that dies before its commit
    young = Database(spark, db.path)  # another writer may be about to commit it
    assert young.collection("c", SCHEMA, OPTIONS).metrics().shards_recovered_from_dirty == 0
    again = Database(spark, db.path, DatabaseOptions(recovery_grace=0))
    with pytest.raises(E.CollectionTypeMismatch):
        again.collection("c", SCHEMA, CollectionOptions("id"))
    d = again.collection("c", SCHEMA, CollectionOptions("id", "city", ("name",)))
    assert d.metrics().shards_recovered_from_dirty == 2 and sorted(state(d)) == [0, 1, 2, 3, 4] and d.indexed == {"id", "name"}
    d.sync()
    d.insert(doc(60))
    mark = f"c/checkpoint"
    d._files.replace(mark, d._files.read(mark)[:-9] + b"garbage\"}")
    assert sorted(state(Database(spark, db.path).collection("c", SCHEMA, OPTIONS))) == [0, 1, 2, 3, 4, 60]


def test_damaged_commit_is_an_error(spark, db):
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert(doc(1))
    c.insert(doc(2))
    last = f"c/log/{c._snapshot.version:020d}.json"
    db._files.replace(last, db._files.read(last)[:-20])
    with pytest.raises(E.CorruptedRecord):
        Database(spark, db.path).collection("c", SCHEMA, OPTIONS)


def test_opening_spares_what_others_have_staged(spark, db, monkeypatch):
    a = db.collection("c", SCHEMA, OPTIONS)
    commit = a._commit

    def late(snapshot, writes):
        Database(spark, db.path).collection("c", SCHEMA, OPTIONS)
        commit(snapshot, writes)

    monkeypatch.setattr(a, "_commit", late)
    a.insert(doc(1))
    assert sorted(state(Database(spark, db.path).collection("c", SCHEMA, OPTIONS))) == [1]
    staged = a._write(a._frame_of([doc(2)]), "rows", a._snapshot.next_seq)
    a._discard(staged)
    with pytest.raises(E.IOFailure):
        commit(a._snapshot.with_segments([staged], {}), 1)


def test_one_of_many_writers_of_a_file_wins(spark, db):
    from concurrent.futures import ThreadPoolExecutor

    for k in range(20):
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(lambda i: db._files.write_new(f"log/{k}", str(i).encode()), range(8)))
        assert sum(won) == 1 and db._files.read(f"log/{k}") == str(won.index(True)).encode()


def test_readers_outlive_compactions(spark, db):
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(i) for i in range(4)])
    behind = Database(spark, db.path).collection("c", SCHEMA, OPTIONS)
    for i in range(3):
        c.delete(i)
        c.compact()
    assert len(state(behind)) == 4 and sorted(state(c)) == [3]
    assert db.vacuum("c") == 0 and db.vacuum("c", older_than=0) > 0 and sorted(state(c)) == [3]


def test_two_writers_dont_lose_writes(spark, db):
    a = db.collection("c", SCHEMA, OPTIONS)
    a.insert(doc(1))
    b = Database(spark, db.path).collection("c", SCHEMA, OPTIONS)
    a.insert(doc(2))
    with pytest.raises(E.IOFailure):
        b.insert(doc(3))
    assert sorted(state(a)) == [1, 2]


def test_databases(spark, tmp_path, db):
    db.collection("b", SCHEMA), db.collection("a", SCHEMA)
    assert db.list_collections() == ["a", "b"] and db.collection("a", SCHEMA) is db.collection("a", SCHEMA)
    db.drop("b")
    with pytest.raises(E.CollectionNotFound):
        db.drop("b")
    c = db.collection("a", SCHEMA)
    db.close(), db.close()
    for call in (lambda: c.insert(doc(1)), lambda: c.get(1), lambda: c.find().count(), lambda: db.collection("a"), lambda: db.list_collections()):
        with pytest.raises(E.DatabaseClosed):
            call()
    with pytest.raises(E.UnsupportedCompression):
        Database(spark, f"file://{tmp_path}/x", DatabaseOptions(compression=Compression.LZFSE))


def test_auto_sync(spark, tmp_path):
    c = Database(spark, f"file://{tmp_path}/db", DatabaseOptions(auto_sync=AutoSync.after_writes(3))).collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(1), doc(2)])
    assert not c._files.exists("c/checkpoint")
    c.insert(doc(3))
    assert c._files.exists("c/checkpoint")


def test_encryption(spark, tmp_path):
    key = crypto.derive_key("pass", b"salt" * 4, iterations=1000)
    assert key == crypto.derive_key("pass", b"salt" * 4, iterations=1000) != crypto.derive_key("pass", b"salt" * 4, algorithm="hkdf")
    assert len(crypto.random_key()) == 32 and len(crypto.random_salt()) == 16
    path, o = f"file://{tmp_path}/db", DatabaseOptions(encryption_key=key)
    c = Database(spark, path, o).collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(1, "Recife"), doc(2, "Olinda")])
    c.update(doc(2, "Recife", name="two"))
    assert c.find().where("city", equal_to="Recife").where("name", equal_to="two").count() == 1 and c.get(1)["name"] == "n1"
    stored = b"".join(p.read_bytes() for p in tmp_path.rglob("*") if p.is_file())
    assert b"Recife" not in stored and not [p for p in tmp_path.rglob("*Recife*")]
    assert key.hex().upper() not in c.all()._jdf.queryExecution().toString()
    for wrong in (crypto.random_key(), None):
        with pytest.raises(E.DecryptionFailed):
            Database(spark, path, DatabaseOptions(encryption_key=wrong)).collection("c", SCHEMA, OPTIONS)
    d = Database(spark, path, o).collection("c", SCHEMA, OPTIONS)
    d.compact()
    assert sorted(state(d)) == [1, 2]
    d._secret = crypto.random_key()  # as if the stored payloads had been changed
    for read in (lambda: d.find().execute(), lambda: list(d.stream()), lambda: d.find().where("age", less_than=9).count(), lambda: d.find().distinct_values("name")):
        with pytest.raises(E.DecryptionFailed):
            read()
    d._secret = key
    assert d.delete(1)


def test_changes_stream(spark, tmp_path, db):
    c = db.collection("c", SCHEMA, OPTIONS)
    c.insert_many([doc(1), doc(2)])
    q = changes(c).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        c.upsert(doc(2, "US"))
        q.processAllAvailable()
        assert sorted((r["id"], r["_seq"]) for r in spark.table("seen").collect()) == [(1, 1), (2, 1), (2, 2)]
    finally:
        q.stop()
