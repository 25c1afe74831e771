"""Forms that hold at size: lines by ranges, ranks by selection, long texts, the live feed."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import redaction
from lumenfold.operators import evaluation, ledger, search
from lumenfold.operators.store import LedgerStore
from lumenfold.operators.text_index import TextIndex
from lumenfold.sources.lines import numbered_lines
from lumenfold.streaming import feed
from tests.test_store import batch


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def anchor(i):
    return json.dumps({"event_id": i, "event_hash": "0" * (i % 90), "prev_hash": "", "session_id": "s", "event_type": "é", "created_at": i, "anchored_at": i})


def test_lines_are_numbered_over_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    texts = {"a.txt": "".join("é" * rng.randrange(60) + rng.choice(["", "\r"]) + "\n" for _ in range(200)), "b.txt": "x\n" * 900 + "no end", "c.txt": "one\n", "d.txt": "\n\n\n", "e.txt": "long " * 500 + "\nz\n", "f.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = numbered_lines(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 10
    got = {}
    for r in rows.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.line, bytes(r.value), r.ended))
    for name, text in texts.items():
        parts = text.encode().split(b"\n")
        last = [(len(parts), parts[-1], False)] if parts[-1] else []
        assert sorted(got.get(name, [])) == [(i, p, True) for i, p in enumerate(parts[:-1], 1)] + last


def test_checkpoints_by_ranges_fail_or_are_quarantined(spark, tmp_path, small_ranges):
    lines = [anchor(i) for i in range(1, 120)]
    (tmp_path / "good.jsonl").write_text("\n".join(lines) + "\n")
    assert sorted((r.line, r.event_id) for r in ledger.read_checkpoints(spark, f"file://{tmp_path}/good.jsonl").collect()) == [(i, i) for i in range(1, 120)]
    lines[40], lines[77], lines[100], lines[110] = "", "{", '{"event_id": 3}', anchor(5).replace('"created_at": 5', '"created_at": "5"')
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    at = f"file://{tmp_path}/bad.jsonl"
    with pytest.raises(Exception, match="line .* (is|does)"):
        ledger.read_checkpoints(spark, at).collect()
    faults = {r.line: r.fault for r in ledger.checkpoint_lines(spark, at).filter("fault is not null").collect()}
    assert faults == {41: "is blank", 78: "is not JSON", 101: "is not an anchor", 111: "is not an anchor", 119: "does not end"}
    assert [r.line for r in ledger.read_checkpoints(spark, at, quarantine=True).orderBy("line").collect()] == [i for i in range(1, 120) if i not in faults]


@pytest.mark.parametrize("seed", range(4))
def test_ranks_by_selection(spark, monkeypatch, seed):
    monkeypatch.setattr(evaluation, "CELLS", [2, 8, 128, 128][seed])
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(5)), rng.random() * 100, None])) for _ in range(700)] + [("one", 3.0), ("same", 1.0), ("same", 1.0)] + [("tied", 7.0)] * 300 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")

    def ranks(vs):
        vs = sorted(vs)
        return tuple(vs[min(int(len(vs) * q), len(vs) - 1)] for q in (0.5, 0.95, 0.99))

    held = {}
    for g, v in rows:
        if v is not None:
            held.setdefault(g, []).append(v)
    assert {r.g: (r.p50, r.p95, r.p99) for r in evaluation.nearest_rank(df, "v", "g").collect()} == {g: ranks(vs) for g, vs in held.items()}
    every = evaluation.nearest_rank(df, "v").first()
    assert tuple(every) == ranks([v for vs in held.values() for v in vs])
    assert evaluation.nearest_rank(df.limit(0), "v", "g").count() == 0
    plan = evaluation.nearest_rank(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert all("cell" in line for line in re.findall(r"Window \[.*", plan))  # never over all the values


def test_running_folds_go_over_runs(spark, monkeypatch):
    monkeypatch.setattr(redaction, "RUN", 3)
    rng = random.Random(1)
    rows = [([rng.randrange(50) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 9, 10, 31)]
    df = spark.createDataFrame(rows, "xs array<int>")
    for (xs,), r in zip(rows, df.select(redaction.running(F.col("xs"), lambda a, x: a + x).alias("sums"), redaction.running(F.col("xs"), lambda a, x: F.greatest(a, x)).alias("tops")).collect(), strict=True):
        assert r.sums == [sum(xs[: i + 1]) for i in range(len(xs))] and r.tops == [max(xs[: i + 1]) for i in range(len(xs))]


def test_scrubbing_a_long_text_is_linear(spark):
    def took(n):
        df = spark.createDataFrame([(" ".join(f"user{i}@example.org word" for i in range(n)),)], "t string").select(redaction.scrub(F.col("t")).alias("t"))
        began = time.perf_counter()
        text = df.first().t
        assert text == " ".join(["[REDACTED email] word"] * n)
        return time.perf_counter() - began

    took(10)
    assert took(40_000) < 60


def test_the_feed_delivers_each_commit_once(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    got = []
    keep = lambda events, number: got.append((number, [r.event_id for r in events.collect()]))
    run = lambda **more: feed.feed(store, keep, str(tmp_path / "progress"), **more).awaitTermination()
    for i in range(3):
        store.append(batch(spark, 10 * i))
    (tmp_path / "ledger/commits/.000000000009.json").write_text("{")  # a draft isn't a commit
    run(commits=2)
    assert [ids for _, ids in got] == [[*range(1, 11)], [*range(11, 16)]]
    run(commits=2)
    assert len(got) == 2
    store.append(batch(spark, 40))
    run(commits=2)
    assert got[2:] == [(2, [*range(16, 21)])]
    later = []
    feed.feed(store, lambda e, n: later.extend(r.event_id for r in e.collect()), str(tmp_path / "other"), after=13).awaitTermination()
    assert later == [*range(14, 21)]


def test_an_index_follows_the_ledger(spark, tmp_path):
    store, index = LedgerStore(spark, f"file://{tmp_path}/ledger"), TextIndex(spark, f"file://{tmp_path}/index", 4)
    for i in range(2):
        store.append(batch(spark, 10 * i))
        feed.follow(store, index, str(tmp_path / f"progress{i}")).awaitTermination()  # the second one plays all again
    assert index.search("text NOT 11", store.events()).collect() == search.search(store.events(), "text NOT 11").collect()
    assert index._state()[1]["mark"] == 10


def test_a_chain_goes_on_over_slices(spark, monkeypatch):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 300)
    rows = [(i, f"s{i % 3}", "t", json.dumps({"k": i}), None if i % 5 else "x", 1000 + i) for i in ids]
    events = spark.createDataFrame(rows, "event_id long, session_id string, event_type string, payload_json string, redacted_text string, created_at long")
    one = sorted(map(tuple, ledger.build_chain(events, "ab" * 32).collect()))
    monkeypatch.setattr(ledger, "CHAIN_ROWS", 40)
    many = ledger.build_chain(events, "ab" * 32)
    assert sorted(map(tuple, many.collect())) == one and len(one) == 300
    assert many.sparkSession.createDataFrame(many.select("prev_hash").collect()).distinct().count() == 300
    assert ledger.build_chain(events.limit(0)).count() == 0


def test_slices_compare_a_row_with_few_cuts(spark):
    for n in (0, 1, 2, 3, 10, 50, 999):
        cuts = [3 * i for i in range(n)]
        df = spark.createDataFrame([(v,) for v in [None, -1, 0, 1, 3, 4, 29, 30, 31, 3 * n - 3, 3 * n, 10**6]], "v long")
        got = df.select("v", ledger._cuts_below(F.col("v"), cuts, "bigint").alias("n")).collect()
        assert [r.n for r in got] == [0 if r.v is None else sum(c < r.v for c in cuts) for r in got]


def test_lists_of_anchors_go_over_files(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from lumenfold.plans import catalog_store

    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 3, "click", 1.0, json.dumps({"k": i})) for i in range(3, 200, 2)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/sf/events.parquet")
    monkeypatch.setattr(catalog_store, "scratch_path", lambda _, label: f"file://{tmp_path}/{label}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.line, r.event_id, r.fault) for r in entry.queries()["s5_checkpoint_lines"](spark, f"{tmp_path}/sf").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "anchors").glob("part-*"))) > 1  # no task has all of them
    assert [g[0] for g in got] == list(range(1, len(rows) + 1)) and [g[1] for g in got if not g[2]] == [r[0] for r in rows]


def test_samples_are_matched_one_after_another(spark):
    rng, rows = random.Random(6), []
    for sample in range(60):
        for role in ("truth", "pred"):
            for pos in range(rng.randrange(6)):
                start = rng.randrange(12)
                rows.append((sample, role, pos, rng.choice("ab"), start, start + 1 + rng.randrange(8)))
    wanted = []
    for sample in range(60):
        truths, preds = ([r for r in rows if r[0] == sample and r[1] == role] for role in ("truth", "pred"))
        for t in truths:
            hit = next((p for p in preds if p[3] == t[3] and evaluation.iou(p[4:], t[4:]) >= 0.5), None)
            if hit:
                preds.remove(hit)
            wanted.append((sample, t[3], t[3] if hit else "none"))
        wanted += [(sample, "none", p[3]) for p in preds]
    pairs = evaluation.match_spans(spark.createDataFrame(rows, "sample_id long, role string, pos int, label string, start int, end int"))
    assert sorted(map(tuple, pairs.collect())) == sorted(wanted)
    assert "FlatMapGroupsInPandas" not in pairs._jdf.queryExecution().executedPlan().toString()
