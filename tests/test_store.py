"""The committed ledger: conflicts, broken-off writes, streams, and verification of what is new."""

import shutil

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ledger
from lumenfold.operators.store import Conflict, LedgerStore
from lumenfold.sources.commits import CommitLog

BATCH = "seq long, session_id string, event_type string, payload_json string, redacted_text string, created_at long"


def batch(spark, first, n=5):
    return spark.createDataFrame([(i, f"s{i % 3}", "note.added", f'{{"k": {i}}}', f"text {i}" if i % 2 else None, 1000 + i) for i in range(first, first + n)], BATCH)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Two folders of a ledger of four segments: never verified, and verified after the second."""
    at = tmp_path_factory.mktemp("made")
    s = LedgerStore(spark, f"file://{at}/late")
    for i in range(4):
        s.append(batch(spark, 10 * i))
        if i == 1:
            assert s.verify().ok
    shutil.copytree(at / "late", at / "plain")
    shutil.rmtree(at / "plain" / "verified")
    return at


@pytest.fixture
def store(spark, tmp_path, made):
    shutil.copytree(made / "plain", tmp_path / "ledger")
    return LedgerStore(spark, f"file://{tmp_path}/ledger")


def rewrite(spark, store, number, change):
    """Replaces the rows of a segment, as one who tampers would."""
    folder = store._folder(store.log.entries()[number])
    rows = spark.createDataFrame(change(spark.read.parquet(folder)).collect(), spark.read.parquet(folder).schema)
    rows.coalesce(1).write.mode("overwrite").parquet(folder)


def test_appends_make_one_chain(spark, store):
    e = store.events()
    assert [r.event_id for r in e.orderBy("event_id").collect()] == [*range(1, 21)]
    assert ledger.verify(e).first() == (20, None, True) and store.version() == 4
    assert store.events(2).count() == 10 and [r.event_id for r in store.since(17).collect()] == [18, 19, 20]
    assert store.head() == (20, e.filter("event_id = 20").first().event_hash)
    assert LedgerStore(spark, store.path).head() == store.head()


def test_empty_ledger_and_empty_batch(spark, tmp_path):
    s = LedgerStore(spark, f"file://{tmp_path}/empty")
    assert s.version() == 0 and s.head() == (0, "") and s.events().count() == 0 and s.verify().ok
    assert s.append(batch(spark, 1, 0)) == 0 and s.version() == 0


def test_of_two_writers_on_one_head_one_fails(spark, store, monkeypatch):
    other, before = LedgerStore(spark, store.path), store.version()
    with pytest.raises(Conflict):
        store.append(batch(spark, 50), expected=before - 1)
    plain = CommitLog.commit

    def late(self, expected, entry):
        monkeypatch.setattr(CommitLog, "commit", plain)
        other.append(batch(spark, 90), expected=before)  # the other one commits first
        return plain(self, expected, entry)

    monkeypatch.setattr(CommitLog, "commit", late)
    with pytest.raises(Conflict):
        store.append(batch(spark, 50), expected=before)
    assert store.version() == before + 1 and ledger.verify(store.events()).first() == (25, None, True)
    store.append(batch(spark, 50))
    assert ledger.verify(store.events()).first() == (30, None, True)


def test_a_version_is_taken_in_one_step(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    log.commit(0, {"a": 1})
    monkeypatch.setattr(CommitLog, "version", lambda self: 0)  # has looked before the other one committed
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    assert log.read(1)["a"] == 1 and [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["000000000001.json"]


def test_a_path_may_lack_its_scheme(spark, tmp_path):
    s = LedgerStore(spark, str(tmp_path / "plain"))
    s.append(batch(spark, 0))
    with pytest.raises(Conflict):
        s.append(batch(spark, 0), expected=0)
    assert s.append(batch(spark, 10)) == 2 and s.verify().ok and s.events().count() == 10


def test_a_write_that_breaks_off_leaves_the_ledger_as_it_was(spark, store, monkeypatch):
    before = store.events().orderBy("event_id").collect()

    def dies(self, expected, entry):
        raise RuntimeError("lost")

    monkeypatch.setattr(CommitLog, "commit", dies)
    with pytest.raises(RuntimeError):
        store.append(batch(spark, 50))
    monkeypatch.undo()
    assert store.events().orderBy("event_id").collect() == before and store.version() == 4 and store.verify(full=True).ok
    with pytest.raises(Exception, match="rejected"):
        store.append(spark.createDataFrame([(1, "c", "tool_call.x", "{}", None, 1)], BATCH))
    assert store.version() == 4
    store.append(spark.createDataFrame([(1, "c", "tool_call.x", "{}", None, 1)], BATCH), typed=True)
    assert store.version() == 5


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    source, ledger_at = tmp_path / "in", f"file://{tmp_path}/ledger"
    store = LedgerStore(spark, ledger_at)

    def run():
        rows = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = rows.writeStream.foreachBatch(store.sink("feed")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(3):
        batch(spark, 10 * i).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert store.events().count() == 15
    sink = store.sink("feed")
    sink(batch(spark, 20), 2)  # a batch that is played again after a restart
    assert store.events().count() == 15
    batch(spark, 30).coalesce(1).write.mode("append").parquet(str(source))
    store.append(batch(spark, 70))  # another writer in between
    run()
    assert store.events().count() == 25 and ledger.verify(store.events()).first().ok


def test_a_sink_chains_anew_after_a_conflict(spark, store, monkeypatch):
    plain, other = CommitLog.commit, LedgerStore(spark, store.path)

    def late(self, expected, entry):
        monkeypatch.setattr(CommitLog, "commit", plain)
        other.append(batch(spark, 90))
        return plain(self, expected, entry)

    monkeypatch.setattr(CommitLog, "commit", late)
    store.sink("w")(batch(spark, 50), 0)
    assert store.version() == 6 and ledger.verify(store.events()).first() == (30, None, True)


# ---- verification -------------------------------------------------------------------

def test_verification_reads_what_is_new(spark, store):
    assert store.verify().n_read == 20 and store.verify().n_read == 0
    store.append(batch(spark, 50, 3))
    got = store.verify()
    assert (got.ok, got.n_events, got.n_read) == (True, 23, 3)
    assert store.verify(full=True).n_read == 23


CHANGES = {
    "payload": lambda k: lambda df: df.withColumn("payload_json", F.when(F.col("event_id") == k, '{"k":-1}').otherwise(F.col("payload_json"))),
    "session": lambda k: lambda df: df.withColumn("session_id", F.when(F.col("event_id") == k, "other").otherwise(F.col("session_id"))),
    "hash": lambda k: lambda df: df.withColumn("event_hash", F.when(F.col("event_id") == k, "0" * 64).otherwise(F.col("event_hash"))),
    "removed": lambda k: lambda df: df.filter(F.col("event_id") != k),
}


@pytest.mark.parametrize("kind", CHANGES)
@pytest.mark.parametrize(("segment", "event_id"), [(0, 1), (1, 10), (3, 18)])
def test_verification_of_the_new_finds_what_a_full_one_finds(spark, made, tmp_path, kind, segment, event_id):
    """Segments 0 and 1 are verified when they are tampered with; 2 and 3 aren't yet."""
    shutil.copytree(made / "late", tmp_path / "late")
    fresh = LedgerStore(spark, f"file://{tmp_path}/late")
    rewrite(spark, fresh, segment, CHANGES[kind](event_id))
    got, full = fresh.verify(), fresh.verify(full=True)
    assert not got.ok and got.broken_at == full.broken_at and (got.n_read, full.n_read) <= (20, 20)
    if kind in ("payload", "session"):
        assert got.broken_at == event_id
    if segment == 3:
        assert got.n_read <= 10
    assert not fresh.verify().ok  # it isn't forgotten


def test_lost_segments_are_found(spark, store):
    assert store.verify().ok
    shutil.rmtree(store._folder(store.log.entries()[1]).removeprefix("file://"))
    assert store.verify().broken_at == 10 == store.verify(full=True).broken_at
    cut = LedgerStore(spark, store.path + "-cut")
    for i in range(2):
        cut.append(batch(spark, 10 * i))
    assert cut.verify().ok
    cut.log._fs.delete(cut.log._path(cut.log._name(2)), False)  # a log that goes back
    assert cut.verify().broken_at == 6 == cut.verify(full=True).broken_at


def test_verification_after_an_anchor(spark, store):
    anchor = store.events().filter("event_id = 8").first()
    got = store.verify_after(8, anchor.event_hash)
    assert got.ok and got.n_read == 13  # events 9 to 20, and the anchor
    assert store.verify_after(8, "0" * 64).broken_at == 8 and store.verify_after(99, "0" * 64).broken_at == 99
    last = store.events().filter("event_id = 20").first()
    assert store.verify_after(20, last.event_hash).n_read == 1
    rewrite(spark, store, 0, CHANGES["payload"](3))
    assert store.verify_after(8, anchor.event_hash).ok  # what comes before an anchor is its own matter
    rewrite(spark, store, 2, CHANGES["removed"](12))
    assert store.verify_after(8, anchor.event_hash).broken_at == 13
    rewrite(spark, store, 3, CHANGES["removed"](20))
    assert store.verify_after(8, anchor.event_hash).broken_at == 13
    assert store.verify_after(15, store.events().filter("event_id = 15").first().event_hash).broken_at == 20


def test_a_sparse_ledger_has_slices_by_rank(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SLICE_ROWS", 8)
    rows = batch(spark, 1, 60).withColumnRenamed("seq", "event_id").withColumn("event_id", F.xxhash64("event_id"))
    s = LedgerStore(spark, f"file://{tmp_path}/sparse")
    s.adopt(rows)
    assert s.events().select(ledger.slice_of(s.events(), "event_id")).distinct().count() in range(6, 10)
    assert s.verify(full=True).ok and ledger.verify(s.events()).first() == (60, None, True)
    with pytest.raises(Conflict):
        s.adopt(rows)
