"""Engines of models: loading, batches, failures and budgets, and scans that use them."""

import glob
import os
import time
import uuid

from pyspark.sql import functions as F

from lumenfold.functions import redaction
from lumenfold.operators import engines
from lumenfold.plans import catalog_engines, policy

SCHEMA = "id long, text string, scan string, lang string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "de" if i % 2 else None) for i, t in enumerate(texts)], SCHEMA)


def by_id(df):
    return {r.id: r.scan for r in df.select("id", "scan").collect()}


def test_token_batches():
    assert engines.token_batches([5, 1, 1, 30, 4], 10) == [[1, 2], [4, 0], [3]]
    for sizes in ([], [1], [7, 7, 7], list(range(1, 40))):
        got = engines.token_batches(sizes, 20)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert all(len(b) == 1 or len(b) * max(sizes[i] for i in b) <= 20 for b in got)


def test_findings_are_merged(spark):
    def load():
        def model(texts, langs):
            return [[(0, 4, "person"), (t.encode().find(b"Zo"), t.encode().find(b"Zo") + 4, lang or "none")] if "Zo" in t else [] for t, lang in zip(texts, langs, strict=True)]

        return model

    texts = ["Anna and Zoë see https://a.example/x", "https://a.example/Zoë is Zo", None, "", "quiet", "Anna and Zoë see https://a.example/x"]
    got = by_id(engines.scan(rows(spark, texts), engines.ModelEngine(load), lang="lang"))
    assert got[0].redacted_text == "[REDACTED person] and [REDACTED none] see [REDACTED url]" == got[5].redacted_text.replace("[REDACTED de]", "[REDACTED none]")
    assert [(f.kind, f.source) for f in got[0].findings] == [("person", "Model"), ("none", "Model"), ("generic_url", "Hard")]
    assert [f.source for f in got[1].findings] == ["Hard"]  # the model's findings lie in the rule's
    assert got[2].status == got[3].status == "empty" and got[2].redacted_text is got[3].findings is None
    assert got[4].status == "ok" and got[4].redacted_text == "quiet" and not got[4].findings


def test_one_text_fails_alone(spark):
    def load():
        def model(texts, langs):
            if any("bad" in t for t in texts):
                raise RuntimeError("quotes " + texts[0])
            return [[(0, 99, "person")] if "far" in t else [(1, 2, "person")] if t == "ë" else [] for t in texts]

        return model

    texts = ["good", "bad https://a.example/x", "far", "ë", "good"]
    got = by_id(engines.scan(rows(spark, texts), engines.ModelEngine(load)))
    assert [got[i].status for i in range(5)] == ["ok", "degraded_error", "degraded_error", "degraded_error", "ok"]
    assert got[1].reason == "RuntimeError" and got[1].redacted_text == "bad [REDACTED url]"
    strict = by_id(engines.scan(rows(spark, texts), engines.ModelEngine(load), strict=True))
    assert strict[1].findings is None and strict[1].redacted_text is None and strict[0].redacted_text == "good"


def test_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda texts, langs: [[] for _ in texts]

    engine = engines.ModelEngine(load)
    df = spark.range(400).select("id", F.col("id").cast("string").alias("text")).repartition(16)
    assert engines.scan(df, engine).filter("scan.status = 'ok'").count() == 400
    assert engines.scan(df, engine).filter("scan.status = 'ok'").count() == 400
    pids = [os.path.basename(p).split("-")[0] for p in glob.glob(folder + "/*")]
    assert pids and len(pids) == len(set(pids))


def test_load_fails(spark):
    def load():
        raise OSError("no model here")

    got = by_id(engines.scan(rows(spark, ["a", "https://a.example/x"]), engines.ModelEngine(load)))
    assert {s.status for s in got.values()} == {"degraded_error"} and got[1].redacted_text == "[REDACTED url]" and got[0].reason == "OSError"


def test_budget(spark):
    def load():
        def model(texts, langs):
            time.sleep(max(1.5 if "slow" in t else 0 for t in texts))
            return [[(0, 1, "person")] for _ in texts]

        return model

    got = by_id(engines.scan(rows(spark, ["slow", "https://a.example/x"]).coalesce(1), engines.ModelEngine(load, budget=1.0, batch_tokens=1)))
    assert got[0].status == "degraded_timeout" and got[0].redacted_text == "slow"
    assert got[1].status in ("ok", "degraded_timeout") and got[1].redacted_text == "[REDACTED url]"


def test_patterns_ensembles_and_empty_tables(spark):
    names = engines.PatternEngine((("person", r"\bAnna\b"),))

    def load():
        raise OSError

    texts = ["Anna https://a.example/x", None, "nobody"]
    scan = engines.scan(rows(spark, texts), names)
    got = by_id(scan)
    assert got[0].redacted_text == "[REDACTED person] [REDACTED url]" and got[1].status == "empty" and got[2].status == "ok"
    assert "ArrowEvalPython" not in scan._jdf.queryExecution().toString()
    both = by_id(engines.scan(rows(spark, texts), engines.Ensemble((names, engines.ModelEngine(load)))))
    assert both[0].status == "degraded_error" and both[0].redacted_text == got[0].redacted_text and both[1].status == "empty"
    nested = by_id(engines.scan(rows(spark, texts), engines.Ensemble((engines.Ensemble((names,)), engines.ModelEngine(load)))))
    assert nested == both
    nothing = engines.scan(rows(spark, texts).limit(0), engines.Ensemble((names, engines.PatternEngine())))
    assert nothing.count() == 0 and engines.preflight(nothing, "id").count() == 0


def test_preflight_and_policy(spark):
    def load():
        return lambda texts, langs: [1 / ("fail" not in t) and [(0, 1, "person")] for t in texts]

    texts = ["x https://a.example/x", "y", "fail", "z", None]
    df = rows(spark, texts).withColumn("call", F.element_at(F.array(*[F.lit(c) for c in "aabcd"]), (F.col("id") + 1).cast("int")))
    calls = engines.preflight(engines.scan(df, engines.ModelEngine(load)), "call")
    rules = [policy.Rule("approve-url", "approve", 1, (), (policy.Condition("pii_contains", "url", 1),)), policy.Rule("allow", "allow")]
    context = policy.Context(roots={}, allowlists={}, effects=F.lit(None), risk=F.col("risk"), descriptor=F.lit("FirstSeen"), scopes=F.lit(None), pii=F.col("pii"))
    got = {r.call: r for r in calls.withColumn("p", engines.fail_closed(policy.decide(rules, context), F.col("status"))).collect()}
    assert [(c, got[c].status, got[c].n_findings, got[c].p.action) for c in "abcd"] == [("a", "ok", 3, "approve"), ("b", "degraded_error", 0, "deny"), ("c", "ok", 1, "allow"), ("d", "empty", 0, "allow")]
    assert got["b"].p.policy_ids == [engines.SCAN_FAILED] and got["a"].pii["url"] == 1


def test_rules_are_searched_once(spark):
    def load():
        return lambda texts, langs: [[(i, i + 1, "person") for i in range(0, len(t), 2)] for t in texts]

    texts = ["a b c d https://a.example/x y z " + "API_KEY=k1 " * 3, "a " * 500]
    scan = engines.scan(rows(spark, texts), engines.ModelEngine(load))
    plan = scan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(redaction.HARD_RULES + redaction.URL_RULES)  # and not again for each of the model's findings
    got = by_id(scan)
    assert [f.source for f in got[0].findings].count("Hard") == 4 and not any(f.source == "Model" and 8 <= f.start < 27 for f in got[0].findings)
    assert len(got[1].findings) == 500 and got[1].redacted_text == "[REDACTED person] " * 500


def test_preflight_searches_once(spark, tmp_path):
    spark.createDataFrame([(i, "alphabetically https://a.example/x" * (i % 3)) for i in range(16)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    calls = catalog_engines.e2_engine_preflight(spark, str(tmp_path))
    assert calls._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == len(redaction.HARD_RULES + redaction.URL_RULES)
    assert [(r.call_id, r.status) for r in calls.orderBy("call_id").collect()] == [(0, "ok"), (1, "ok")]


def test_one_row_group_is_scanned_by_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"alphabetically {i} https://a.example/x") for i in range(400)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    scans = catalog_engines._scans(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in scans.groupBy("task").count().collect()]
    assert sum(sizes) == 400 and len(sizes) > spark.sparkContext.defaultParallelism and max(sizes) < 100
