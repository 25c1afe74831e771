"""Queries that take their tables whole; tests/test_oracle.py compares their rows."""

import hashlib
import os
import re

import pytest

import __spark_entry__ as entry
from lumenfold.functions import redaction
from lumenfold.operators import ledger

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_tools_hash_covers_all_documents(spark):
    got = {r.server for r in entry.queries()["g17_tools_hash"](spark, SF).collect()}
    assert got == {r.doc_id // 40 for r in rows(spark, "documents").select("doc_id").collect()}


def test_metadata_binding_covers_all_events(spark):
    assert entry.queries()["j12_metadata_binding"](spark, SF).count() == rows(spark, "events").count() > 300


def test_decode_tokens_covers_all_events(spark):
    assert entry.queries()["r22_decode_tokens"](spark, SF).count() == rows(spark, "events").count() > 400


def test_checkpoint_order_reports_faults_beyond_event_200(spark):
    assert max(r.event_id for r in entry.queries()["w4_checkpoint_order"](spark, SF).collect()) > 100


def test_checkpoint_faults_carry_over_slices(spark, monkeypatch):
    monkeypatch.setattr(ledger, "SLICE_ROWS", 7)
    ids = [5 * i if i % 6 else 5 * i - 11 for i in range(1, 101)]
    points = spark.createDataFrame([(3 * i, x, "0" * 64, "") for i, x in enumerate(ids)], "line long, event_id long, event_hash string, prev_hash string")
    assert ledger.sliced(points, "line").select("__slice").distinct().count() > 10
    got = sorted((r.line, r.fault) for r in ledger.checkpoint_faults(points).collect())
    assert got == [(3 * i, "non-monotonic event_id") for i in range(1, 100) if ids[i] <= ids[i - 1]] and got
    assert sorted((r.event_id, r.line) for r in ledger.numbered(points.drop("line"), "event_id").collect()) == [(x, i + 1) for i, x in enumerate(sorted(ids))]
    assert ledger.checkpoint_faults(points.limit(0)).count() == 0


def brute_scrub(text):
    if re.search(redaction.PEM, text):
        return "[REDACTED pem_private_key]"
    found = sorted((m.start(), -m.end(), i) for i, (_, p) in enumerate(redaction.ALL_RULES) for m in re.finditer(p, text))
    merged = []
    for start, back, i in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -back)
        else:
            merged.append([start, -back, redaction.ALL_RULES[i][0]])
    for start, end, kind in reversed(merged):
        text = f"{text[:start]}[REDACTED {kind}]{text[end:]}"
    return text


def test_scrub_covers_all_documents(spark):
    docs = rows(spark, "documents").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.clean) for r in entry.queries()["r6_scrub"](spark, SF).collect())
    assert got == sorted((r.doc_id, hashlib.sha256(brute_scrub(r.text).encode()).hexdigest()) for r in docs)
    assert sum("[REDACTED" in brute_scrub(r.text) for r in docs) > 0


def test_preflight_scans_texts_of_any_length(spark, tmp_path):
    docs = [(1, "see http://a.example/x now"), (41, "word " * 40 + "http://b.example/y now"), (2, "nothing"), (3, None), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in entry.queries()["g9_preflight"](spark, str(tmp_path)).collect()] == [(1, 2, 20)]
