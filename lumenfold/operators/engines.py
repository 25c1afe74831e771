"""Engines that find personal data in texts, behind one interface, and scans that use them.

An engine gives a Column (status, reason, findings) for a text and its language. Engines of
patterns are Column expressions. Engines of models are vectorised functions: a worker loads
the model once, texts go to it in batches by tokens, and what fails is a status of its text,
not of the task. A batch that fails or takes too long is asked again text by text, so that
one text can't spoil others. Reasons are names of errors only, as messages may quote a text.

A scan joins what an engine finds with the rules' own findings, which are made whether the
engine fails or not. Without an engine's part it is `degraded_error` or `degraded_timeout`,
and callers choose: a strict scan then gives no findings at all (null), and fail_closed denies.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction

OK, ERROR, TIMEOUT, EMPTY = "ok", "degraded_error", "degraded_timeout", "empty"
#: From best to worst.
STATUSES = (EMPTY, OK, TIMEOUT, ERROR)
SCAN_FAILED = "preflight-scan-failed"
_FINDINGS = "array<struct<start:int,end:int,kind:string>>"
_OUTCOME = f"status string, reason string, findings {_FINDINGS}"

Finding = tuple[int, int, str]
#: (texts, languages) -> for each text its findings (start, end, kind), in UTF-8 bytes.
Model = Callable[[list[str], list[str | None]], list[list[Finding]]]


class Engine(Protocol):
    """infer: the outcome (status, reason, findings) for a text that is neither null nor empty."""

    def infer(self, text: Column, lang: Column) -> Column: ...


def _outcome(status: Column, reason: Column, findings: Column) -> Column:
    return F.struct(status.alias("status"), reason.cast("string").alias("reason"), findings.cast(_FINDINGS).alias("findings"))


def _worst(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def _joined(outcomes: Column) -> Column:
    """One outcome of those of several engines."""
    top = F.array_max(F.transform(outcomes, lambda o: _worst(o["status"])))
    first = F.get(F.filter(outcomes, lambda o: _worst(o["status"]) == top), F.lit(0))
    return _outcome(F.coalesce(first["status"], F.lit(OK)), first["reason"], F.flatten(F.transform(outcomes, lambda o: o["findings"])))


@dataclass(frozen=True)
class PatternEngine:
    """Rules (kind, Java regular expression) as Column expressions; without rules it finds nothing."""

    rules: tuple[tuple[str, str], ...] = ()

    def infer(self, text: Column, lang: Column) -> Column:
        found = [F.transform(redaction.spans(text, kind, p, i), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for i, (kind, p) in enumerate(self.rules)]
        return _outcome(F.lit(OK), F.lit(None), F.concat(*found) if found else F.array())


def bytes_over_four(text: str) -> int:
    """Tokens of a text, by a rule of thumb."""
    return len(text.encode()) // 4 + 1


@dataclass(frozen=True)
class ModelEngine:
    """A model in Python workers.

    load makes the model and is called once in each worker process; where it fails, all texts of
    that worker have its error. A batch holds texts of together `batch_tokens`, each counted as
    its longest; a longer text is one by itself. With `budget` seconds for a text, waiting is
    given up after that time for each of a batch; the call itself can't be ended, so no other
    is begun while it lasts, and texts that would wait longer than their budget are timed out.
    """

    load: Callable[[], Model]
    tokens: Callable[[str], int] = bytes_over_four
    batch_tokens: int = 1 << 14
    budget: float | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def infer(self, text: Column, lang: Column) -> Column:
        engine = self

        @F.pandas_udf(_OUTCOME)
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            worker = _Worker(engine)
            for texts, langs in batches:
                yield pd.DataFrame(worker.outcomes(list(texts), list(langs)), columns=["status", "reason", "findings"])

        # so that no plan makes an outcome twice
        return run.asNondeterministic()(text, lang.cast("string"))


@dataclass(frozen=True)
class Ensemble:
    """Several engines: all their findings; the worst status, with the first reason for it."""

    engines: tuple[Engine, ...]

    def infer(self, text: Column, lang: Column) -> Column:
        return redaction.let(F.array(*[e.infer(text, lang) for e in self.engines]), _joined)


def token_batches(sizes: list[int], limit: int) -> list[list[int]]:
    """Places of texts in batches, by ascending size."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        if out and sizes[i] * (len(out[-1]) + 1) <= limit:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def checked(found: list[Finding], text: str) -> list[dict]:
    """Findings as rows; spans that aren't whole characters of the text are an error."""
    raw, rows = text.encode(), []
    edge = lambda i: i == len(raw) or raw[i] & 0xC0 != 0x80
    for start, end, kind in found:
        if not (0 <= start < end <= len(raw) and edge(start) and edge(end) and isinstance(kind, str)):
            raise ValueError
        rows.append({"start": int(start), "end": int(end), "kind": kind})
    return rows


#: Models of this worker process, by the key of their engine, or the error of loading them.
_MODELS: dict[str, Model | Exception] = {}


class _Worker:
    def __init__(self, engine: ModelEngine):
        self.engine, self.running = engine, None
        if engine.key not in _MODELS:
            try:
                _MODELS[engine.key] = engine.load()
            except Exception as e:
                _MODELS[engine.key] = e

    def call(self, texts: list[str], langs: list[str | None]) -> list[list[dict]]:
        model = _MODELS[self.engine.key]
        if isinstance(model, Exception):
            raise model
        found = self.within(lambda: model(texts, langs), len(texts))
        if len(found) != len(texts):
            raise ValueError
        return [checked(f, t) for f, t in zip(found, texts, strict=True)]

    def within(self, work: Callable[[], list], n: int) -> list:
        if self.engine.budget is None:
            return work()
        seconds, box = self.engine.budget * n, []
        if self.running:
            self.running.join(seconds)
            if self.running.is_alive():
                raise TimeoutError

        def run() -> None:
            try:
                box.append((work(), None))
            except Exception as e:
                box.append((None, e))

        self.running = threading.Thread(target=run, daemon=True)
        self.running.start()
        self.running.join(seconds)
        if not box:
            raise TimeoutError
        if box[0][1]:
            raise box[0][1]
        return box[0][0]

    def outcomes(self, texts: list[str | None], langs: list[str | None]) -> list[tuple]:
        out: list[tuple] = [(EMPTY, None, [])] * len(texts)
        given = [i for i, t in enumerate(texts) if t]
        sizes = [self.engine.tokens(texts[i]) for i in given]
        todo = [[given[i] for i in b] for b in token_batches(sizes, self.engine.batch_tokens)]
        while todo:
            batch = todo.pop()
            try:
                for i, found in zip(batch, self.call([texts[i] for i in batch], [langs[i] for i in batch]), strict=True):
                    out[i] = (OK, None, found)
            except Exception as e:
                if len(batch) > 1:
                    todo += [[i] for i in batch]
                else:
                    out[batch[0]] = (TIMEOUT if isinstance(e, TimeoutError) else ERROR, type(e).__name__, [])
        return out


def scan(df: DataFrame, engine: Engine, text: str = "text", lang: str | None = None, strict: bool = False) -> DataFrame:
    """df with a column `scan`: status, reason, findings (start, end, kind, source), redacted_text
    and risk (counts_by_label, total_risk_delta, has_secret).

    A model's finding that overlaps one of the rules is left out. A null or empty text has the
    status empty, and null for the rest. In a strict scan so has a text of which the engine's part
    failed. A column `scan` that df has is replaced.
    """
    body = F.col(text)
    asked = F.when(F.length(body) > 0, body)
    told = engine.infer(asked, F.col(lang) if lang else F.lit(None).cast("string"))
    rows = df.withColumn("scan", told)
    outcome = F.col("scan")
    hard = F.transform(redaction.scan_findings(body), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind")))
    merged = redaction.merge_with_model(hard, outcome["findings"])

    def whole(found: Column) -> Column:
        ranked = F.transform(found, lambda f, i: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["kind"].alias("kind"), i.alias("ord")))
        named = F.transform(redaction.union_merge(ranked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(redaction.label_of(s["kind"]), s["kind"]).alias("label")))
        return F.struct(found.alias("findings"), redaction.replace_spans(body, named, "label").alias("redacted_text"), redaction.risk_signals(found).alias("risk"))

    usable = (F.length(body) > 0) & ((outcome["status"] == OK) if strict else F.lit(True))
    status = F.when(F.length(body) > 0, outcome["status"]).otherwise(EMPTY)
    made = F.when(usable, redaction.let(merged, whole))
    fields = ["findings", "redacted_text", "risk"]
    return rows.withColumn("scan", redaction.let(made, lambda m: F.struct(status.alias("status"), outcome["reason"].alias("reason"), *[m[f].alias(f) for f in fields])))


def preflight(scans: DataFrame, call: str = "call_id") -> DataFrame:
    """For each call, over the scans of its strings: the worst status, the findings, their risk, and
    how many of each label (`pii`, as policy.Context takes it)."""
    counts = {label: F.sum(F.coalesce(F.try_element_at("scan.risk.counts_by_label", F.lit(label)), F.lit(0))).cast("int") for label in redaction.LABELS}
    worst = F.get(F.array(*[F.lit(s) for s in STATUSES]), (F.max(_worst(F.col("scan.status"))) - 1).cast("int"))
    n = F.sum(F.coalesce(F.size("scan.findings"), F.lit(0)))
    risk = F.coalesce(F.sum("scan.risk.total_risk_delta"), F.lit(0)).cast("long")
    pii = F.map_filter(F.create_map(*[c for label, k in counts.items() for c in (F.lit(label), k)]), lambda _, k: k > 0)
    return scans.groupBy(call).agg(worst.alias("status"), n.alias("n_findings"), risk.alias("risk"), pii.alias("pii"))


def fail_closed(decision: Column, status: Column) -> Column:
    """A decision of policy.decide, or a denial where a scan isn't whole."""
    whole = status.isin(EMPTY, OK)
    denied = F.struct(F.lit("deny").alias("action"), F.array(F.lit(SCAN_FAILED)).alias("policy_ids"), F.array(F.concat(F.lit("scan is "), status)).alias("reasons"))
    return F.when(F.coalesce(whole, F.lit(False)), decision).otherwise(denied)
