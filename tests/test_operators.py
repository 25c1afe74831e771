"""Ledger, machines, search, evaluation and streaming on small made-up rows."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import decision, hashing
from lumenfold.operators import evaluation, ledger, machines, search
from lumenfold.plans import catalog, policy
from lumenfold.sources import derived
from lumenfold.streaming import sessions as streaming

EVENTS = [(1, "a", "x.y", "{}", "Café un_deux", 10), (2, "a", "x.z", '{"k":1}', None, 11), (3, "b", "x.y", "{}", "", 12), (4, "a", "w", "{}", "deux trois", 13)]
SCHEMA = "event_id long, session_id string, event_type string, payload_json string, redacted_text string, created_at long"


@pytest.fixture(scope="module")
def chained(spark):
    return ledger.build_chain(spark.createDataFrame(EVENTS, SCHEMA)).cache()


def broken(df, **kw):
    return ledger.verify(df, **kw).first().broken_at


def test_untouched_chain_verifies(chained, monkeypatch):
    assert broken(chained) is None and broken(chained.filter("event_id <= 3")) is None
    monkeypatch.setattr(ledger, "SLICE_ROWS", 2)
    assert broken(chained) is None


def test_tasks_grow_with_the_ledger(spark, monkeypatch):
    rows = [(i, "a", "x.y", '{"k":1}', None, i) for i in range(1, 201)]
    long = ledger.build_chain(spark.createDataFrame(rows, SCHEMA)).cache()
    monkeypatch.setattr(ledger, "SLICE_ROWS", 4)
    checks = ledger.chain_checks(long)
    assert "RepartitionByExpression" in checks._jdf.queryExecution().optimizedPlan().toString()  # 50 slices; the session has 4 partitions
    assert checks.rdd.getNumPartitions() == -(-50 // ledger.TASK_SLICES)
    assert broken(long) is None and broken(long.withColumn("payload_json", F.when(F.col("event_id") == 133, "[]").otherwise(F.col("payload_json")))) == 133
    assert ledger.protection_summary(long).first().chain_intact


@pytest.mark.parametrize("size", [2, 1 << 16])
@pytest.mark.parametrize(("column", "value"), [("payload_json", "[]"), ("payload_json", "no json"), ("event_type", "t"), ("session_id", "a"), ("redacted_text", None), ("created_at", 99), ("event_hash", "0" * 64), ("prev_hash", "0" * 64), ("chain_version", 1), ("chain_version", 7)])
def test_tampering_is_found(chained, monkeypatch, column, value, size):
    monkeypatch.setattr(ledger, "SLICE_ROWS", size)
    kind = dict(chained.dtypes)[column]
    touched = chained.withColumn(column, F.when(F.col("event_id") == 3, F.lit(value).cast(kind)).otherwise(F.col(column)))
    assert broken(touched) == 3


def test_removed_event_is_found(chained):
    assert broken(chained.filter("event_id <> 2")) == 3
    assert broken(chained.filter("session_id <> 'b'")) == 4 and broken(chained.filter("event_id > 1")) == 2


def test_gaps_other_tags_and_blanks(spark):
    rows = [(e[0] * 70_000, *e[1:]) for e in EVENTS]
    own = ledger.build_chain(spark.createDataFrame(rows, SCHEMA), tags=("t.v1", "t.v2"))
    assert broken(own, tags=("t.v1", "t.v2")) is None and broken(own) == 70_000
    assert broken(own.withColumn("payload_json", F.concat(F.lit(" "), "payload_json", F.lit("\n"))), tags=("t.v1", "t.v2")) is None


def test_old_events_before_new_ones(spark, chained):
    first = spark.createDataFrame([(0, "a", "x", '{"b":[1.0,"é"],"a":1e2}', "t", 9)], SCHEMA).withColumns({"prev_hash": F.lit(""), "chain_version": F.lit(1)})
    first = first.withColumn("event_hash", hashing.event_hash_v1(F.col("prev_hash"), F.col("payload_json"), F.col("created_at")))
    start = first.first().event_hash
    later = ledger.build_chain(spark.createDataFrame(EVENTS, SCHEMA), start)
    assert broken(first.unionByName(later)) is None
    down = later.withColumn("chain_version", F.when(F.col("event_id") == 3, 1).otherwise(F.col("chain_version")))
    down = down.withColumn("event_hash", F.when(F.col("event_id") == 3, hashing.event_hash_v1(F.col("prev_hash"), F.col("payload_json"), F.col("created_at"))).otherwise(F.col("event_hash")))
    assert broken(first.unionByName(down)) == 3  # its own hash fits


def test_append(spark, chained):
    batch = spark.createDataFrame([(7, "c", "x.y", '{"b": 1, "a": [2]}', None, 20), (3, "a", "x.y", "{}", "first", 19)], SCHEMA.replace("event_id", "seq"))
    more = ledger.append(chained, batch)
    both = chained.unionByName(more.select(*chained.columns))
    assert [(r.event_id, r.payload_json, r.redacted_text) for r in more.orderBy("event_id").collect()] == [(5, "{}", "first"), (6, '{"a":[2],"b":1}', None)] and broken(both) is None
    assert broken(ledger.append(chained.limit(0), batch)) is None
    for bad in [(1, "c", "tool_call.x", "{}", None, 1), (1, "c", "", "{}", None, 1), (1, "c", "x", "{", None, 1), (1, "c", "x", "{}", "key gh" + "p_" + "a1" * 20, 1)]:
        with pytest.raises(Exception, match="rejected|JSON"):
            ledger.append(chained, spark.createDataFrame([bad], SCHEMA.replace("event_id", "seq"))).collect()


def test_replay_and_summary_of_a_broken_ledger(spark, chained):
    assert [r.event_id for r in ledger.verified_replay(chained, "a").collect()] == [1, 2, 4]
    touched = chained.withColumn("payload_json", F.when(F.col("session_id") == "b", "[]").otherwise(F.col("payload_json")))
    assert ledger.verified_replay(touched, "a").count() == 0
    kinds = spark.createDataFrame([(1, "a", ledger.LEAK, "{}", "t", 1), (2, "a", ledger.ALIAS, "{}", "t", 1), (3, "b", "x", "{}", "t", 1)], SCHEMA)
    good = ledger.build_chain(kinds)
    bad = good.withColumn("redacted_text", F.lit("u"))
    got = [ledger.protection_summary(e).first() for e in (good, bad)]
    assert [(r.chain_intact, r.tool_result_leaks_detected, r.total_events_audited, r.sessions_covered) for r in got] == [(True, 1, 3, 2), (False, 1, 3, 2)]
    assert [[r.event_id for r in ledger.recent_protection(e, 5).collect()] for e in (good, bad)] == [[2, 1], []]


def test_checkpoints(spark, chained, tmp_path):
    point = ledger.new_checkpoint(chained, None, 100)
    assert ledger.new_checkpoint(chained, 4, 100).count() == 0
    path = f"file://{tmp_path}/points"
    point.write.mode("append").json(path)
    read = ledger.read_checkpoints(spark, path)
    assert ledger.anchor_mismatches(read, chained).count() == 0
    assert ledger.anchor_mismatches(read, chained.filter("event_id <> 4")).first().missing


def test_empty_ledger(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ledger.head(none).count() == 0 and ledger.build_chain(none).count() == 0
    got = ledger.protection_summary(ledger.build_chain(none)).first()
    assert got.total_events_audited == 0 and got.chain_intact and ledger.verify(ledger.build_chain(none)).first().ok


@pytest.mark.parametrize(("query", "ids"), [("cafe", [1]), ("un_deux", [1]), ("deux", [4]), ("deux OR cafe", [1, 4]), ("deux NOT trois", []), ('"deux trois"', [4]), ("x*", [1, 2, 3]), ("event_type:x.y session_id:a", [1]), ("(cafe OR trois) AND session_id:a", [1, 4]), ("CAFÉ", [1])])
def test_search(spark, query, ids):
    assert [r.event_id for r in search.search(spark.createDataFrame(EVENTS, SCHEMA), query).collect()] == ids


TEXTS = ["load .env now", "rm -rf x", "tiếng Việt", "мой дом", "Ελλάς ΟΔΟΣ", "cafe\u0301 noe\u0308l", "a.b-c_d", "naïve ÅNGSTRÖM", "日本 語", "x:y"]


@pytest.mark.parametrize(("query", "ids"), [
    (".env", [0]), ("env", []), ("-rf", [1]), ("rf", []), ("việt", [2]), ("viet", [2]), ("VIỆT", [2]), ("Vie\u0323\u0302t", [2]), ("мой", [3]), ("МОЙ", [3]), ("οδος", [4]), ("ΟΔΟΣ", [4]), ("ελλάς", [4]), ("cafe", [5]), ("café", [5]), ("noël", [5]), ("NOEL", [5]),
    ("a.b-c_d", [6]), ("a.b*", [6]), ("a", []), ("naive", [7]), ("ångström", [7]), ("日本", [8]), ('"日本 語"', [8]), ("x:y", [9]), ('"rm -rf"', [1]), ('"load .e"*', [0]), ('"rm rf"', []), (".env OR -rf", [0, 1]),
])
def test_search_takes_terms_as_texts(spark, query, ids):
    events = spark.createDataFrame([(i, "s", "t", "{}", x, i) for i, x in enumerate(TEXTS)], SCHEMA)
    assert [r.event_id for r in search.search(events, query).collect()] == ids


def test_search_errors(spark):
    for bad in ("", "(a", "a )", "OR"):
        with pytest.raises(ValueError):
            search.search(spark.createDataFrame(EVENTS, SCHEMA), bad)


def fold(spark, ops, kind):
    df = spark.createDataFrame([("k", i, op, h, 100 + i) for i, (op, h) in enumerate(ops)], "key string, seq long, op string, hash string, at long")
    return machines.fold(df, ["key"], kind).first()


def test_descriptor_machine(spark):
    s = fold(spark, [("observe", "a"), ("observe", "b"), ("approve", None), ("observe", "b"), ("observe", "c"), ("observe", "c"), ("observe", "d")], "descriptor")
    assert (s.hash, s.pending, s.approved_at, s.drift_at, s.n_first, s.n_drift, s.n_invalid) == ("b", "d", 102, 104, 2, 2, 0)
    s = fold(spark, [("observe", "a"), ("approve", None), ("observe", "b"), ("observe", "a")], "descriptor")
    assert (s.hash, s.pending, s.drift_at) == ("a", None, None)
    s = fold(spark, [("observe", "a"), ("approve", None), ("observe", "b"), ("approve_to", "b"), ("approve", None), ("reject", None)], "descriptor")
    assert (s.hash, s.pending, s.approved_at, s.n_invalid) == ("b", None, 103, 2)


def test_command_and_program_machines(spark):
    s = fold(spark, [("observe", "a"), ("register", "b"), ("observe", "c"), ("approve", None)], "command")
    assert (s.hash, s.pending, s.n_drift) == ("c", None, 1)
    s = fold(spark, [("observe", "a"), ("observe", "b"), ("reject", None), ("approve", None)], "program")
    assert (s.hash, s.pending, s.n_invalid) == ("a", None, 1)


def model(ops, kind):
    """The drift rules, written down apart from the operator."""
    s = dict(hash=None, approved_at=None, pending=None, drift_at=None, n_first=0, n_drift=0, n_invalid=0)
    for i, (op, h, at) in enumerate(ops):
        new = dict(s)
        if op == "observe" and i and ops[i - 1][:2] == (op, h):
            continue
        if op == "observe":
            if s["hash"] is None:
                if kind != "command":
                    new.update(hash=h, n_first=s["n_first"] + 1)
            elif s["hash"] == h:
                new.update(pending=None, drift_at=None)
            elif kind == "descriptor" and s["approved_at"] is None:
                new.update(hash=h, pending=None, drift_at=None, n_first=s["n_first"] + 1)
            else:
                new.update(pending=h, n_drift=s["n_drift"] + 1, drift_at=None if kind == "program" else s["drift_at"] or at)
        elif op == "approve" and kind == "descriptor" and s["hash"] and not s["approved_at"]:
            new["approved_at"] = at
        elif op == "approve" and kind != "descriptor" and s["pending"]:
            new.update(hash=s["pending"], pending=None, drift_at=None)
        elif op == "approve_to" and kind == "descriptor" and s["approved_at"] and s["pending"] == h:
            new.update(hash=h, pending=None, drift_at=None, approved_at=at)
        elif op == "register" and kind == "command" and s["hash"] is None:
            new.update(hash=h, n_first=s["n_first"] + 1)
        elif op == "reject" and s["pending"]:
            new.update(pending=None, drift_at=None)
        else:
            new["n_invalid"] += 1
        s = new
    return tuple(s.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the synthetic tables")
@pytest.mark.parametrize(("name", "keys", "kind"), [("d1_descriptor_drift", ("server_id", "tool_name"), "descriptor"), ("d3_command_drift", ("server_id",), "command"), ("d4_program_drift", ("server_id",), "program")])
def test_drift_queries(spark, name, keys, kind):
    sf, by = "/root/testdata/sf0.001", {}
    for r in derived.observations(spark, sf).orderBy("seq").collect():
        op = "register" if kind == "command" and r.seq % 31 == 0 else r.op
        by.setdefault(tuple(r[k] for k in keys), []).append((op, r.hash, r.at))
    got = {tuple(r)[: len(keys)]: tuple(r)[len(keys) :] for r in catalog.QUERIES[name](spark, sf).collect()}
    assert got == {k: model(ops, kind) for k, ops in by.items()} and len(got) > 10


def test_drift_of_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1, "observe", "a", 1), (None, 2, "observe", None, 2), ("k", 1, "observe", "b", 1), ("k", 1, "observe", "b", 1), ("k", 2, "what", None, None)], "key string, seq long, op string, hash string, at long")
    got = {r.key: (r.hash, r.n_first, r.n_invalid) for r in machines.fold(df, ["key"], "program").collect()}
    assert got == {None: ("a", 1, 1), "k": ("b", 1, 1)} and machines.fold(df.limit(0), ["key"], "program").count() == 0


def test_strict_checkpoints(spark, tmp_path):
    good = '{"event_id":1,"event_hash":"h","prev_hash":"","session_id":"s","event_type":"t","created_at":1,"anchored_at":2}\n'
    for i, (text, why) in enumerate([(good * 2, None), ("", None), (good + "\n", "blank"), (good.rstrip(), "does not end"), ("[1]\n", "not an anchor"), ('{"event_id":1}\n', "not an anchor"), ("{\n", "JSON|Expecting"), (good.replace('"s"', "5"), "Arrow|str")]):
        (tmp_path / f"{i}.jsonl").write_text(text)
        read = ledger.read_checkpoints(spark, f"file://{tmp_path}/{i}.jsonl")
        if why is None:
            assert [r.line for r in read.orderBy("line").collect()] == list(range(1, text.count("\n") + 1))
        else:
            with pytest.raises(Exception, match=why):
                read.collect()


def test_exports_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    whole = {f: {r.session_id: r.content for r in f(df).collect()} for f in (lambda e: ledger.export_markdown(e, 9), ledger.export_html)}
    monkeypatch.setattr(ledger, "PAGE_EVENTS", 2)
    for f, pages in whole.items():
        parts = {}
        for r in f(df).orderBy("part").collect():
            parts[r.session_id] = parts.get(r.session_id, "") + r.content
        assert parts == pages and f(df).filter("session_id = 'a'").count() == 2


def test_outbox(spark):
    df = spark.createDataFrame([("a", 1, "submit"), ("a", 2, "approve"), ("a", 3, "cancel"), ("a", 4, "fail"), ("b", 1, "execute")], "outbox_id string, seq long, op string")
    assert {r.outbox_id: (r.status, r.n_invalid) for r in machines.fold_outbox(df).collect()} == {"a": ("Failed", 1), "b": ("Drafted", 1)}


def test_matching_and_scores(spark):
    rows = [(1, "truth", 1, "email", 0, 10), (1, "truth", 2, "email", 20, 30), (1, "pred", 1, "email", 0, 5), (1, "pred", 2, "email", 19, 30), (1, "pred", 3, "phone", 0, 10), (2, "truth", 1, "date", 0, 4), (3, "pred", 1, "url", 0, 4)]
    pairs = evaluation.match_spans(spark.createDataFrame(rows, "sample_id long, role string, pos int, label string, start int, end int")).cache()
    got = {r.label: (r.tp, r.fp, r.fn) for r in evaluation.scores(pairs).collect()}
    assert got == {"email": (2, 0, 0), "phone": (0, 1, 0), "date": (0, 0, 1), "url": (0, 1, 0)}
    assert {r.truth: r["none"] for r in evaluation.confusion(pairs).collect()} == {"email": 0, "date": 1, "none": 0}


def test_ensemble(spark):
    rows = [(1, 1, "m1", "email", 0, 10), (1, 2, "m2", "private_email", 1, 10), (1, 3, "m1", "person", 20, 25), (1, 4, "m2", "person", 21, 26), (1, 5, "m1", "phone", 40, 45)]
    df = spark.createDataFrame(rows, "sample_id long, pos int, engine string, kind string, start int, end int")
    assert [(r.kind, r.start, r.engines) for r in evaluation.ensemble(df, confirm=("phone",)).collect()] == [("email", 0, "m1,m2"), ("person", 21, "m1,m2")]


def test_decoder(spark):
    decode = evaluation.decoder(["O", "B-EMAIL", "I-EMAIL", "B-AGE"], "multilingual")
    df = spark.createDataFrame([([[9.0, 0.0, 0.0, 0.0], [0.0, 9.0, 0.0, 0.0], [0.0, 0.0, 8.0, 0.0], [0.0, 0.0, 0.0, 9.0]], [0, 2, 5, 9], [2, 5, 9, 12])], "z array<array<double>>, s array<int>, e array<int>")
    assert [(x.label, x.start, x.end) for x in df.select(decode("z", "s", "e").alias("f")).first().f] == [("email", 2, 9)]


def test_thresholds(spark):
    df = spark.createDataFrame([("person", "de"), ("person", "fr"), ("email", "xx")], "l string, g string")
    assert [r.t for r in df.select(evaluation.threshold(F.col("l"), F.col("g"), {"person": 0.4}).alias("t")).collect()] == [1.1, 0.4, None]


def test_streams_match_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 10), ("a", 20), ("b", 5)]
    spark.createDataFrame(rows, "session_id string, delta long").repartition(2).write.parquet(src)
    stream = spark.readStream.schema("session_id string, delta long").parquet(src)
    q = streaming.session_risk(stream).writeStream.format("memory").queryName("risk").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select * from risk").collect()} == {("a", 30), ("b", 5)}
    q = streaming.risk_escalations(stream).writeStream.format("memory").queryName("esc").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select * from esc").collect()} == {("a", 30)}


def test_live_risk_bounds():
    assert (ledger.clamp_feed(0), ledger.clamp_sessions(0), ledger.clamp_scans(0), ledger.clamp_scans(9999)) == (1, 100, 50, 500)


def test_samples_are_read_by_folder(spark, tmp_path):
    from lumenfold.sources import schemas

    for bucket, i in (("zh", 1), ("ja", 2)):
        (tmp_path / bucket).mkdir()
        (tmp_path / bucket / f"{i}.json").write_text('{"id": "s%d",\n "text": "x", "expected_findings": [{"label": "email", "start": 0, "end": 1}]}' % i)
    assert sorted((r.id, r.bucket, r.expected_findings[0].end) for r in schemas.read_samples(spark, f"file://{tmp_path}").collect()) == [("s1", "zh", 1), ("s2", "ja", 1)]


def test_ledger_tables_gain_columns(spark, tmp_path):
    from lumenfold.sources import schemas

    spark.createDataFrame([("a", "cli")], "session_id string, source string").write.parquet(f"{tmp_path}/sessions")
    assert schemas.open_table(spark, str(tmp_path), "sessions").first().risk_score is None


def test_session_overview(spark):
    s = spark.createDataFrame([("a", 5, None, 3), ("b", 7, 9, 8), ("c", 7, None, 1)], "session_id string, started_at long, ended_at long, risk_score long")
    f = spark.createDataFrame([("secret",), ("url",)], "label string")
    assert ledger.session_states(s, f).first().asDict() == {"active": 2, "idle": 1, "highest": 8, "findings": 2, "secrets": 1}
    assert [r.session_id for r in ledger.latest_sessions(s).collect()] == ["b", "c"] and ledger.session_states(s.limit(0), f.limit(0)).first().findings == 0


def test_approval_rows(spark):
    df = spark.createDataFrame([("d1", "s", "mail", "send", '{"b":1, "a":2}', 40, "approve"), ("d2", "s", "x", "y", "{}", 0, "deny")], "decision_id string, session_id string, server_id string, tool_name string, args string, risk int, action string")
    df = df.withColumn("effects", decision.effects(F.col("server_id"), F.col("tool_name"), F.col("args")))
    (row,) = policy.approval_rows(df, 100).collect()
    assert (row.approval_id, row.status, row.title, row.summary, row.created_at, row.expires_at) == ("approval-d1", "Pending", "send on mail", "risk 40/100", 100, 400)
    assert row.args_hash == hashlib.sha256(b'{"a":2,"b":1}').hexdigest() and policy.approval_rows(df, 100, 0).first().expires_at == 100
