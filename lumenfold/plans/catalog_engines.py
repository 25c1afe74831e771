"""Registered queries over engines of models, with a deterministic model in place of one that
would have to be downloaded: it finds long words, and fails at texts of some lengths."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..operators import engines
from ..sources import derived as d
from . import policy
from .catalog import _CLEAN, _RE, query

_WORD = r"\b[a-z]{9,}\b"


def long_words() -> engines.Model:
    """A model that takes words of nine and more small letters for names. It fails at a batch that
    holds a text whose length in bytes is divisible by 7."""
    word = re.compile(_WORD, re.ASCII)

    def model(texts: list[str], langs: list[str | None]) -> list[list[engines.Finding]]:
        if any(len(t.encode()) % 7 == 0 for t in texts):
            raise ArithmeticError("a text was " + repr(texts))
        out = []
        for t in texts:
            found, at, done = [], 0, 0
            for m in word.finditer(t):
                at += len(t[done : m.start()].encode())
                found.append((at, at + m.end() - m.start(), "person"))
                at, done = at + m.end() - m.start(), m.end()
            out.append(found)
        return out

    return model


_HARD = " + ".join(f"len(regexp_extract_all(text, '{_RE[k]}'))" for k in ("env_assignment", "generic_url", "internal_ipv4"))
_SECRET = f"len(regexp_extract_all(text, '{_RE['env_assignment']}'))"
_SCANS = f"""SELECT doc_id, CASE WHEN strlen(text) % 7 = 0 THEN 'degraded_error' ELSE 'ok' END AS status, n_hard, n_secret,
 CASE WHEN strlen(text) % 7 = 0 THEN 0 ELSE len(regexp_extract_all(clean, '{_WORD}')) END AS n_model,
 CASE WHEN strlen(text) % 7 = 0 THEN clean ELSE regexp_replace(clean, '{_WORD}', '[REDACTED person]', 'g') END AS redacted
 FROM (SELECT doc_id, text, {_CLEAN} AS clean, {_HARD} AS n_hard, {_SECRET} AS n_secret FROM documents WHERE length(text) > 0)"""
_RISK = "25 * n_secret + 10 * (n_hard - n_secret) + 5 * n_model"


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.load(spark, sf, "documents").select("doc_id", "text").filter("length(text) > 0")
    return engines.scan(d.dealt(docs, "doc_id"), engines.ModelEngine(long_words))


@query(f"SELECT doc_id, status, CASE WHEN status <> 'ok' THEN 'ArithmeticError' END AS reason, n_hard, n_model, {_RISK} AS risk, sha256(redacted) AS redacted FROM ({_SCANS})")
def e1_engine_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scanned by the rules and a model; where the model fails, by the rules alone."""
    count = lambda source: F.size(F.filter("scan.findings", lambda f: f["source"] == source))
    return _scans(spark, sf).select(
        "doc_id", "scan.status", "scan.reason", count("Hard").alias("n_hard"), count("Model").alias("n_model"), F.col("scan.risk.total_risk_delta").alias("risk"), F.sha2(F.col("scan.redacted_text").cast("binary"), 256).alias("redacted")
    )


_RULES = [
    policy.Rule("deny-many-secrets", "deny", 100, (), (policy.Condition("pii_contains", "secret", 2),)),
    policy.Rule("approve-risk", "approve", 50, (), (policy.Condition("risk_at_least", value=100),)),
    policy.Rule("allow-rest", "allow", 0),
]


@query(f"""SELECT call_id, status, n_findings, risk, CASE WHEN status <> 'ok' OR n_secret >= 2 THEN 'deny' WHEN risk >= 100 THEN 'approve' ELSE 'allow' END AS action
 FROM (SELECT doc_id // 8 AS call_id, CASE WHEN bool_or(status <> 'ok') THEN 'degraded_error' ELSE 'ok' END AS status, sum(n_hard + n_model) AS n_findings, sum({_RISK}) AS risk, sum(n_secret) AS n_secret
 FROM ({_SCANS}) GROUP BY 1)""")  # fmt: skip
def e2_engine_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of eight documents each: their scans together, and the policy's decision, which is a
    denial where a scan isn't whole."""
    calls = engines.preflight(_scans(spark, sf).withColumn("call_id", F.expr("doc_id div 8")))
    context = policy.Context(roots={}, allowlists={}, effects=F.lit(None), risk=F.col("risk"), descriptor=F.lit("ApprovedStable"), scopes=F.lit(None), pii=F.col("pii"))
    decided = engines.fail_closed(policy.decide(_RULES, context), F.col("status"))
    return calls.select("call_id", "status", "n_findings", "risk", decided["action"].alias("action"))
