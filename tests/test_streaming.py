"""Streams against their batch forms: any cut into batches, any order within the lateness, restarts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import machines
from lumenfold.streaming import sessions, stateful

OPS = "server_id string, tool_name string, seq long, op string, hash string, at long"
LATE = 100


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k) for k in (*stateful.ROCKSDB, "spark.sql.shuffle.partitions")}
    for k, v in (stateful.ROCKSDB | {"spark.sql.shuffle.partitions": "2"}).items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def play(spark, batches, schema, make, folder, restart_after=None):
    """Writes batches as files, one for each micro-batch, runs make(stream) over them, and
    returns what came out, with the number of the batch; optionally in two runs."""
    out = []

    def keep(df, number):
        out.extend((number, *r) for r in df.collect())

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
        q = make(stream).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        q.awaitTermination()

    (folder / "in").mkdir(parents=True)
    names = [f.split()[0] for f in schema.split(", ")]
    for i, rows in enumerate(batches):
        path = folder / "in" / f"{i:04d}.json"
        path.write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        os.utime(path, (1_000_000 + i, 1_000_000 + i))  # files are taken by their time
        if restart_after == i:
            run()
    run()
    return out


def observations(n):
    rng = random.Random(n)
    at, rows = 1000, []
    for seq in range(n):
        at += rng.randrange(0, 20)
        op = rng.choices(["observe", "approve", "reject", "approve_to", "register"], [8, 2, 1, 1, 1])[0]
        rows.append((f"s{rng.randrange(2)}", None if rng.random() < 0.1 else f"t{rng.randrange(2)}", seq, op, rng.choice(["a", "b", "c", None]), at))
    return rows


@pytest.mark.parametrize(("kind", "seed", "restart"), [("descriptor", 1, None), ("command", 2, 1), ("program", 3, 3)])
def test_streamed_drift_equals_the_fold(spark, rocks, tmp_path, kind, seed, restart):
    rows, rng = observations(150), random.Random(seed)
    shuffled = sorted(rows, key=lambda r: r[5] + rng.random() * (LATE - 1))  # out of order, none too late
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    end = [("end", "end", 10**6, "observe", "x", 10**6), ("end", "end", 10**6 + 1, "observe", "x", 2 * 10**6)]
    out = play(spark, [*batches, end[:1], end[1:]], OPS, lambda s: stateful.drift(s, ["server_id", "tool_name"], kind, f"{LATE} seconds"), tmp_path, restart)
    last = {}
    for number, *row in out:
        if row[0] != "end":
            assert last.get(tuple(row[:2]), (0, [0]))[1][-1] <= row[-1]
            last[tuple(row[:2])] = number, row
    wanted = machines.fold(spark.createDataFrame(rows, OPS), ["server_id", "tool_name"], kind).collect()
    assert sorted(map(str, (tuple(r[:-1]) for _, r in last.values()))) == sorted(str(tuple(r)) for r in wanted)


ITEMS = "item_id string, op string, at long, expires_at long"


@pytest.mark.parametrize("restart", [None, 2])
def test_items_expire_once_and_by_the_watermark(spark, rocks, tmp_path, restart):
    batches = [
        [("left alone", "open", 1000, 1300), ("in time", "open", 1000, 1300), ("too late", "open", 1010, 1310), ("closed first", "close", 1020, None), ("prolonged", "open", 1000, 1200)],
        [("in time", "close", 1299, None), ("closed first", "open", 1015, 1315), ("too late", "close", 1310, None), ("prolonged", "open", 1050, 1900)],
        [("clock", "open", 1350, 99_999)],  # the watermark goes to 1250
        [("clock", "open", 1500, 99_999)],  # to 1400
        [("left alone", "close", 1450, None), ("clock", "open", 1600, 99_999)],
        [("clock", "open", 1700, 99_999)],
        [("prolonged", "close", 1650, None), ("clock", "open", 3000, 99_999)],
        [("clock", "open", 3500, 99_999)],
    ]
    out = play(spark, batches, ITEMS, lambda s: stateful.expiries(s, f"{LATE} seconds"), tmp_path, restart)
    assert sorted(r[1:] for r in out) == [("left alone", 1300), ("too late", 1310)]


def test_activity_windows_by_the_watermark(spark, rocks, tmp_path):
    schema = "ts timestamp, event_type string"
    batches = [[("2024-01-01T00:10:00", "a"), ("2024-01-01T00:50:00", "a"), ("2024-01-01T00:20:00", "b")], [("2024-01-01T00:55:00", "b"), ("2024-01-01T02:00:00", "a")], [("2024-01-01T05:00:00", "c")], [("2024-01-01T00:30:00", "a"), ("2024-01-01T09:00:00", "c")]]
    out = play(spark, batches, schema, sessions.activity_windows, tmp_path)
    got = sorted((str(r[1]), *r[2:]) for r in out)
    # the event of 00:30 comes after a watermark of 01:50
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:00:00", "b", 2), ("2024-01-01 02:00:00", "a", 1), ("2024-01-01 05:00:00", "c", 1)]


def test_expired_approvals_filter(spark):
    rows = spark.createDataFrame([(1, "Pending", 5), (2, "Pending", 50), (3, "Denied", 5)], "approval_id int, status string, expires_at long")
    assert [tuple(r) for r in sessions.expired_approvals(rows, 10).collect()] == [(1, "Expired", 5)]
    assert rows.select(F.max("expires_at")).first()[0] == 50


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the synthetic tables")
def test_the_registered_stream_equals_the_registered_fold(spark):
    import __spark_entry__ as entry

    streamed, folded = (sorted(map(str, entry.queries()[name](spark, "/root/testdata/sf0.001").collect())) for name in ("d1_streamed_drift", "d1_descriptor_drift"))
    assert streamed == folded and len(folded) > 50


def test_many_items_share_few_buckets(spark, rocks, tmp_path):
    """A call for each key took milliseconds; a bucket of keys is one call."""
    n = 4000
    opened = [(f"i{i}", "open", 1000 + i % 50, 1300 + i % 50) for i in range(n)]
    closed = [(f"i{i}", "close", 1100, None) for i in range(0, n, 2)]
    end = [("clock", "open", 5000, 99_999), ("clock", "open", 6000, 99_999)]
    out = play(spark, [opened, closed, end[:1], end[1:]], ITEMS, lambda s: stateful.expiries(s, f"{LATE} seconds", buckets=4), tmp_path, 1)
    assert sorted(r[1:] for r in out) == sorted((f"i{i}", 1300 + i % 50) for i in range(1, n, 2))
    groups = [(r[0], r[1]) for r in out]
    assert len(groups) == len(set(groups)) and len({number for number, _ in groups}) == 1
