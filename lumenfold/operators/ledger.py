"""Reads, checks and writes over the event ledger and its projections.

Times are epoch seconds. Every ordered result has a total order. `now` is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, redaction
from ..sources.lines import numbered_lines
from ..sources.scratch import scratch_path

RESERVED_PREFIXES = ("tool_call.", "decision.", "approval.", "lease.")
RAW_SECRET, LEAK, ALIAS = "raw_secret_attempt_detected", "secret.leak_detected", "secret.alias_unresolved"
PROTECTION_TYPES = (RAW_SECRET, LEAK, ALIAS)
SCAN_SOURCES = ("paste", "tool_arg", "tool_output", "export")
ACTIONS = ("redacted", "blocked", "allowed_once")
#: Rows of a slice of an ordered table, and the most slices it is cut into.
SLICE_ROWS, SLICES = 1 << 14, 1000
#: Events that one task chains, about.
CHAIN_ROWS = 1 << 18
#: Slices that one task checks, about.
TASK_SLICES = 8
#: Events of a part of an exported page.
PAGE_EVENTS = 1000


# ---- limits -------------------------------------------------------------------------

def clamp_feed(n: int) -> int:
    return max(1, n)


def clamp_sessions(n: int) -> int:
    return n or 100


def clamp_scans(n: int) -> int:
    return min(n or 50, 500)


# ---- reads --------------------------------------------------------------------------

def event(events: DataFrame, event_id: int) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def head(events: DataFrame) -> DataFrame:
    """The newest event, by a partial aggregate and not a sort."""
    return events.agg(F.max_by(F.struct(*events.columns), "event_id").alias("e")).filter("e is not null").select("e.*")


def recent_events(events: DataFrame, session_id: str | None = None, types: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Newest first; no types means all of them."""
    if session_id is not None:
        events = events.filter(F.col("session_id") == session_id)
    if types:
        events = events.filter(F.col("event_type").isin(types))
    return events.select("event_id", "session_id", "event_type", "redacted_text", "created_at").orderBy(F.desc("event_id")).limit(clamp_feed(limit))


def sessions_list(sessions: DataFrame, source: str | None = None, limit: int = 0) -> DataFrame:
    if source is not None:
        sessions = sessions.filter(F.col("source") == source)
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(clamp_sessions(limit))


def replay(events: DataFrame, session_id: str) -> DataFrame:
    return events.filter(F.col("session_id") == session_id).orderBy("event_id")


def filter_feed(events: DataFrame, types: list[str], decision: str | None, since: int | None, decision_class: Column) -> DataFrame:
    """A type matches itself and everything below it (`type.`)."""
    if types:
        hit = F.lit(False)
        for t in types:
            hit = hit | (F.col("event_type") == t) | F.col("event_type").startswith(t + ".")
        events = events.filter(hit)
    if decision:
        events = events.filter(decision_class == decision)
    return events.filter(F.col("created_at") >= since) if since is not None else events


# ---- chain --------------------------------------------------------------------------

CHAIN = ("prev_hash", "event_hash", "chain_version")


def build_chain(events: DataFrame, previous: str = "", tags: tuple[str, str] = hashing.TAGS) -> DataFrame:
    """Adds prev_hash, event_hash and chain_version 2, and makes payload_json canonical: one
    chain of all events in the order of event_id, after an event with the hash `previous`.

    Each hash needs the one before it. The events are stored in slices of some `CHAIN_ROWS` in
    order; one task after another gets a slice and only tells its last hash, then all slices
    are hashed again in parallel, each from the last hash of the one before. Payloads are made
    canonical before that, in parallel. A payload that isn't JSON fails the call.
    """
    spark, tag, base = events.sparkSession, tags[1], events.drop(*CHAIN)
    body = F.coalesce(hashing.canonical_payload(F.col("payload_json")), F.raise_error(F.concat(F.lit("payload of event "), F.col("event_id").cast("string"), F.lit(" is not JSON"))).cast("string"))
    plain = base.withColumn("payload_json", body)
    kept, order = plain.columns, ["event_id", "__body"]  # so that both passes agree on ties
    ready = plain.withColumn("__body", hashing.event_body(*[F.col(c) for c in ("payload_json", "created_at", "session_id", "event_type", "redacted_text")]))
    schema = ", ".join(f"`{c}` {t}" for c, t in [*plain.dtypes, ("prev_hash", "string"), ("event_hash", "string"), ("chain_version", "int")])
    path = scratch_path(spark, "unchained")
    ready.write.parquet(path)
    stored = spark.read.schema(ready.schema).parquet(path)
    parts = -(-stored.count() // CHAIN_ROWS)
    heads = {0: previous}
    if parts > 1:
        path = scratch_path(spark, "chain-slices")
        stored.repartitionByRange(parts, "event_id").withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*order).write.partitionBy("__part").parquet(path)
        stored = spark.read.schema(f"{ready.schema.toDDL()}, `__part` int").parquet(path)
    else:
        stored = stored.withColumn("__part", F.lit(0))

    def digests(batch: pa.RecordBatch, last: str) -> list[str]:
        start, now, out = tag.encode() + b"\0\0\0\x20", bytes.fromhex(last) if last else bytes(32), []
        for one in batch.column(batch.schema.get_field_index("__body")).to_pylist():
            now = hashlib.sha256(start + now + one).digest()
            out.append(now.hex())
        return out

    def ending(start: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = start
            for batch in batches:
                last = (digests(batch, last) or [last])[-1]
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string())], ["last"])

        return run

    for part in range(parts - 1):
        own = stored.filter(F.col("__part") == part).select(*order).coalesce(1).sortWithinPartitions(*order)
        heads[part + 1] = own.mapInArrow(ending(heads[part]), "last string").first()[0]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, ""
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("__part")).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if int(of[a]) != here:
                    here, last = int(of[a]), heads[int(of[a])]
                piece = batch.slice(a, b - a)
                own = digests(piece, last)
                more = [pa.array([last, *own[:-1]], pa.string()), pa.array(own, pa.string()), pa.array([hashing.CURRENT_VERSION] * len(own), pa.int32())]
                last = own[-1]
                yield pa.RecordBatch.from_arrays([*[piece.column(piece.schema.get_field_index(c)) for c in kept], *more], [*kept, *CHAIN])

    return stored.repartitionByRange(max(1, parts), "__part").sortWithinPartitions("__part", *order).mapInArrow(chain, schema)


def extension(batch: DataFrame, at: int, previous: str, typed: bool = False, tags: tuple[str, str] = hashing.TAGS) -> DataFrame:
    """The rows that a batch (seq, session_id, event_type, payload_json, redacted_text,
    created_at) adds in the order of seq after the event numbered `at`, whose hash is
    `previous`. Any event that may not be appended (see admit()) fails the whole batch.
    typed: for writers of typed events, whose types are reserved to them."""
    named = F.when((F.coalesce("session_id", F.lit("")) == "") | (F.coalesce("event_type", F.lit("")) == ""), "empty session_id or event_type")
    gated = admit(batch).withColumn("rejected_for", F.coalesce(named, F.nullif(F.col("rejected_for"), F.lit("reserved_event_type" if typed else ""))))
    refuse = F.raise_error(F.concat(F.lit("event "), F.col("seq").cast("string"), F.lit(" is rejected: "), F.col("rejected_for")))
    gated = gated.withColumn("redacted_text", F.when(F.col("rejected_for").isNotNull(), refuse.cast("string")).otherwise(F.col("redacted_text")))
    rows = numbered(gated, "seq").select((F.col("line") + at).alias("event_id"), "session_id", "event_type", "payload_json", "redacted_text", F.col("created_at").cast("long").alias("created_at"))
    return build_chain(rows, previous, tags)


def append(ledger: DataFrame, batch: DataFrame, tags: tuple[str, str] = hashing.TAGS) -> DataFrame:
    """The rows to append to a ledger that is a table; see extension(). store.LedgerStore
    commits them."""
    newest = head(ledger).select("event_id", "event_hash").first()
    at, previous = (newest.event_id, newest.event_hash) if newest else (0, "")
    return extension(batch, at, previous, tags=tags)


def chain_checks(events: DataFrame, tags: tuple[str, str] = hashing.TAGS, trusted: DataFrame | None = None) -> DataFrame:
    """Adds ok, for the whole ledger as one chain: the hash recomputes, the previous hash is
    that of the event before (gaps in event_id don't matter), the version is known and never
    falls. tags: those that the ledger was written with. trusted: events (event_id, event_hash,
    chain_version) that count as checked and come before the events that follow them.

    Hashes recompute in parallel. A slice is some `SLICE_ROWS` events by rank; links are looked
    up within it, and the last hash and the greatest version so far are carried to the next.
    Slices get more tasks than the session's partitions where a task would have too many.
    """
    again = hashing.event_hash(F.col("chain_version"), F.col("prev_hash"), F.col("payload_json"), F.col("created_at"), F.col("session_id"), F.col("event_type"), F.col("redacted_text"), tags)
    rows, by = events.withColumns({"__fits": again == F.col("event_hash"), "__trusted": F.lit(False)}), Window.partitionBy("__slice").orderBy("event_id")
    if trusted is not None:
        rows = rows.unionByName(trusted.select("event_id", "event_hash", "chain_version", F.lit(True).alias("__trusted")), allowMissingColumns=True)
    slices = n_slices(events)
    rows = rows.withColumn("__slice", slice_of(events, "event_id", slices))
    ends = rows.groupBy("__slice").agg(F.max_by("event_hash", "event_id").alias("__end"), F.max("chain_version").alias("__most"))
    over = Window.orderBy("__slice")  # one row for each slice
    carried = ends.select("__slice", F.lag("__end", 1, "").over(over).alias("__end"), F.max("__most").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__most"))
    tasks = -(-slices // TASK_SLICES)
    if tasks > int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "__slice")
    here = rows.withColumns({"__n": F.row_number().over(by), "__last": F.lag("event_hash").over(by), "__seen": F.max("chain_version").over(by.rowsBetween(Window.unboundedPreceding, -1))}).join(carried, "__slice")
    linked = F.col("prev_hash") == F.when(F.col("__n") == 1, F.col("__end")).otherwise(F.col("__last"))
    newest = F.greatest(F.lit(1), "__seen", "__most")
    ok = F.col("__fits") & linked & (F.col("chain_version") >= newest)
    return here.filter("not __trusted").withColumn("ok", F.coalesce(ok, F.lit(False))).drop("__fits", "__trusted", "__slice", "__n", "__last", "__seen", "__end", "__most")


def verify(events: DataFrame, tags: tuple[str, str] = hashing.TAGS) -> DataFrame:
    """One row: n_events, broken_at (the first event that breaks the chain, or null), ok."""
    return chain_checks(events, tags).agg(F.count("*").alias("n_events"), F.min(F.when(~F.col("ok"), F.col("event_id"))).alias("broken_at")).withColumn("ok", F.col("broken_at").isNull())


def _if_intact(rows: DataFrame, events: DataFrame, tags: tuple[str, str]) -> DataFrame:
    """rows if the whole ledger verifies, else none."""
    return rows.filter(verify(events, tags).select("ok").scalar())


def verified_replay(events: DataFrame, session_id: str, tags: tuple[str, str] = hashing.TAGS) -> DataFrame:
    """The session's events in order if the whole ledger verifies, else none."""
    return _if_intact(events.filter(F.col("session_id") == session_id), events, tags).orderBy("event_id")


# ---- checkpoints --------------------------------------------------------------------

_POINT = "event_id long, event_hash string, prev_hash string, session_id string, event_type string, created_at long, anchored_at long"


def checkpoint_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of lists of anchors (JSON lines): path, line, the anchor's fields, and fault,
    which is null for an anchor. Files are read by ranges, in parallel."""
    kinds = dict(f.split() for f in _POINT.split(", "))
    schema = pa.schema([("path", pa.string()), ("line", pa.int64()), *[(f, pa.int64() if t == "long" else pa.string()) for f, t in kinds.items()], ("fault", pa.string())])

    def point(value: bytes, ended: bool) -> tuple[dict, str | None]:
        if not ended:
            return {}, "does not end"
        if not value.strip():
            return {}, "is blank"
        try:
            found = json.loads(value)
        except ValueError:
            return {}, "is not JSON"
        if not isinstance(found, dict) or any(f not in found for f in kinds):
            return {}, "is not an anchor"
        own = {f: found[f] for f in kinds}
        if any(not isinstance(own[f], int if t == "long" else str) or isinstance(own[f], bool) for f, t in kinds.items()):
            return {}, "is not an anchor"
        return own, None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, line, value, ended in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, fault = point(value, ended)
                rows.append({"path": name, "line": line, **own, "fault": fault})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return numbered_lines(spark, path).mapInArrow(parse, f"path string, line long, {_POINT}, fault string")


def read_checkpoints(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """Anchors of the chain from JSON lines, with their line number. A blank line, a last line
    that doesn't end, anything that isn't an anchor, and a field that's missing fail the read;
    with quarantine they are left out, and checkpoint_lines() has them."""
    lines = checkpoint_lines(spark, path)
    refuse = F.raise_error(F.concat("path", F.lit(": line "), F.col("line").cast("string"), F.lit(" "), "fault")).cast("boolean")
    kept = F.col("fault").isNull() if quarantine else F.when(F.col("fault").isNull(), True).otherwise(refuse)
    return lines.filter(kept).drop("path", "fault")


def n_slices(rows: DataFrame) -> int:
    return min(SLICES, -(-rows.count() // SLICE_ROWS))


def slice_of(rows: DataFrame, column: str, parts: int | None = None) -> Column:
    """The slice of a value of the column, which ascends with it; nulls come first. Slices hold
    about `SLICE_ROWS` of the rows, at most `SLICES` of them; all equal values share one.
    parts: n_slices(rows), where it's known."""
    parts = n_slices(rows) if parts is None else parts
    cuts = rows.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * SLICES)).first()[0] if parts > 1 else None
    return _cuts_below(F.col(column), sorted(set(cuts or [])), dict(rows.dtypes)[column])


def _cuts_below(value: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending cuts are below a value: first by whole runs of them, then
    within one run, so that a row isn't compared with all."""
    run = max(1, math.isqrt(len(cuts)))
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x < value))
    return redaction.let(below(array(cuts[run - 1 :: run])) * run, lambda at: at + below(F.slice(array(cuts), at + 1, F.lit(run))))


def sliced(rows: DataFrame, column: str) -> DataFrame:
    """Adds __slice; see slice_of()."""
    return rows.withColumn("__slice", slice_of(rows, column))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Adds line: the position of each row by the column, from 1, without one ordered window."""
    rows = sliced(rows, column)
    sizes = rows.groupBy("__slice").agg(F.count("*").alias("__n"))
    # one row for each slice, and there are few
    before = sizes.select("__slice", (F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).alias("__before"))
    line = F.row_number().over(Window.partitionBy("__slice").orderBy(column)) + F.col("__before")
    return rows.join(F.broadcast(before), "__slice").withColumn("line", line).drop("__slice", "__before")


def checkpoint_faults(points: DataFrame) -> DataFrame:
    """Anchors with a bad hash, a bad id or an id not above the one before."""
    hexed = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    points, by_slice = sliced(points, "line"), Window.partitionBy("__slice").orderBy("line", "event_id")
    # the last id of each slice is carried to the next one; there are few slices
    ends = points.groupBy("__slice").agg(F.max(F.struct("line", "event_id"))["event_id"].alias("last"))
    carried = ends.select("__slice", F.lag("last").over(Window.orderBy("__slice")).alias("__carried"))
    points = points.withColumns({"__before": F.lag("event_id").over(by_slice), "__n": F.row_number().over(by_slice)}).join(F.broadcast(carried), "__slice")
    before = F.when(F.col("__n") == 1, F.col("__carried")).otherwise(F.col("__before"))
    fault = F.when(~hexed("event_hash"), "invalid event_hash").when((F.col("prev_hash") != "") & ~hexed("prev_hash"), "invalid prev_hash").when(F.col("event_id") <= 0, "non-positive event_id").when(F.col("event_id") <= before, "non-monotonic event_id")
    return points.withColumn("fault", fault).filter("fault is not null").drop("__slice", "__before", "__n", "__carried")


def new_checkpoint(events: DataFrame, last_id: int | None, anchored_at: int) -> DataFrame:
    """The head as an anchor, if it's newer than the last one; append it as JSON."""
    h = head(events).select("event_id", "event_hash", "prev_hash", "session_id", "event_type", "created_at", F.lit(anchored_at).cast("long").alias("anchored_at"))
    return h if last_id is None else h.filter(F.col("event_id") > last_id)


def anchor_mismatches(points: DataFrame, events: DataFrame) -> DataFrame:
    """Anchors whose event is missing or differs in any of five columns."""
    e = events.select("event_id", *[F.col(c).alias(f"__{c}") for c in ("event_hash", "prev_hash", "session_id", "event_type", "created_at")])
    same = F.lit(True)
    for c in ("event_hash", "prev_hash", "session_id", "event_type", "created_at"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return points.join(e, "event_id", "left").filter(~same).select(*points.columns, F.col("__event_hash").isNull().alias("missing"))


# ---- writes -------------------------------------------------------------------------

def admit(events: DataFrame) -> DataFrame:
    """Adds rejected_for: a reserved type, or the secret that the event would leak; null
    for events that may be appended."""
    reserved = F.lit(False)
    for p in RESERVED_PREFIXES:
        reserved = reserved | F.col("event_type").startswith(p)
    secret = F.coalesce(redaction.hard_secret(F.col("payload_json")), redaction.hard_secret(F.coalesce("redacted_text", F.lit(""))))
    return events.withColumn("rejected_for", F.when(reserved, "reserved_event_type").otherwise(secret))


def admit_scans(scans: DataFrame) -> DataFrame:
    bad = F.when(~F.col("source").isin(*SCAN_SOURCES), "source").when(~hashing.is_fingerprint(F.col("fingerprint")), "fingerprint")
    return scans.withColumn("rejected_for", bad)


def admit_findings(findings: DataFrame) -> DataFrame:
    bad = F.when(~F.col("label").isin(*redaction.LABELS), "label").when(~F.col("action_taken").isin(*ACTIONS), "action_taken").when(~hashing.is_fingerprint(F.col("fingerprint")), "fingerprint")
    return findings.withColumns({"placeholder": redaction.placeholder(F.col("label"), F.col("action_taken")), "rejected_for": bad})


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """INSERT OR IGNORE: of rows with equal keys the first one."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: of rows with equal keys the last one, by an aggregate that combines on the map side."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def typed_events(decisions: DataFrame, approvals: DataFrame, leases: DataFrame) -> DataFrame:
    """Audit events of decisions, approvals and leases, in one shape."""
    shape = lambda df, kind, at, **fields: df.select("session_id", F.lit(kind).alias("event_type"), F.to_json(F.struct(*[F.col(v).alias(k) for k, v in sorted(fields.items())])).alias("payload_json"), F.col(at).alias("created_at"))
    made = shape(approvals, "approval.created", "created_at", approval_id="approval_id")
    resolved = shape(approvals.filter("resolved_at is not null"), "approval.resolved", "resolved_at", approval_id="approval_id", status="status")
    minted = shape(leases, "lease.minted", "created_at", lease_id="lease_id", secret_ref="secret_ref")
    revoked = shape(leases.filter("revoked_at is not null"), "lease.revoked", "revoked_at", lease_id="lease_id")
    return shape(decisions, "decision.recorded", "created_at", decision="decision", decision_id="decision_id").unionByName(made).unionByName(resolved).unionByName(minted).unionByName(revoked)


def span_faults(stages: DataFrame) -> DataFrame:
    """stages (invocation_id, event_id, stage) -> one row for each invocation: its stages
    in order, whether the order holds, and the outcome ('abandoned' with no end)."""
    rank = F.when(F.col("stage") == "opened", 1).when(F.col("stage") == "decided", 2).otherwise(3)
    got = stages.groupBy("invocation_id").agg(F.array_sort(F.collect_list(F.struct("event_id", rank.alias("r"), "stage"))).alias("s"))
    ranks = F.transform("s", lambda x: x["r"])
    ordered = (ranks == F.sequence(F.lit(1), F.least(F.size("s"), F.lit(3)))) & (F.size("s") <= 3)
    end = F.element_at("s", -1)
    return got.select("invocation_id", F.array_join(F.transform("s", lambda x: x["stage"]), ">").alias("stages"), ordered.alias("ordered"), F.when(end["r"] == 3, end["stage"]).otherwise("abandoned").alias("outcome"))


def _pages(events: DataFrame, body: Column, top: Column, end: str, between: str) -> DataFrame:
    """session_id, part, n_events, content: the events of each session in order, `PAGE_EVENTS`
    to a part, so that a long session is many values and not one. Joining the parts in order
    gives the page: the first begins with `top`, the last one ends it."""
    by = Window.partitionBy("session_id").orderBy("event_id")
    rows = events.select("session_id", "event_id", body.alias("b"), (F.row_number().over(by) - 1).alias("n"), F.count("*").over(Window.partitionBy("session_id")).alias("total"))
    part = F.floor(F.col("n") / PAGE_EVENTS).cast("int")
    parts = rows.groupBy("session_id", part.alias("part")).agg(F.count("*").alias("n_events"), F.max("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "b"))), lambda x: x["b"]), between).alias("b"))
    first, last = F.col("part") == 0, F.col("part") == F.floor((F.col("total") - 1) / PAGE_EVENTS)
    return parts.select("session_id", "part", "n_events", F.concat(F.when(first, top).otherwise(F.lit(between)), F.col("b"), F.when(last, F.lit(end)).otherwise(F.lit(""))).alias("content"))


def export_markdown(events: DataFrame, generated_at: int) -> DataFrame:
    """Each session's events as a Markdown page, in parts (see _pages)."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    body = F.concat(
        F.lit("## Event "), F.col("event_id").cast("string"), F.lit(" — "), tick(F.col("event_type")), F.lit("\n\n- **created_at**: "), F.col("created_at").cast("string"),
        F.when(F.coalesce("redacted_text", F.lit("")) != "", F.concat(F.lit("\n\n**Redacted summary**:\n\n```\n"), F.col("redacted_text"), F.lit("\n```"))).otherwise(""),
        F.lit("\n\n```json\n"), F.col("payload_json"), F.lit("\n```\n"),
    )
    top = F.concat(F.lit("# Session Replay\n\n- **session_id**: "), tick(F.col("session_id")), F.lit("\n- **event_count**: "), F.col("total").cast("string"), F.lit(f"\n- **generated_at**: {generated_at}\n\n"))
    return _pages(events, body, top, "", "\n")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def export_html(events: DataFrame) -> DataFrame:
    """Each session's events as an HTML page, escaped, in parts (see _pages)."""
    item = F.concat(F.lit("<section><h2>Event "), F.col("event_id").cast("string"), F.lit(" <code>"), html_escape(F.col("event_type")), F.lit("</code></h2><pre>"), html_escape(F.col("payload_json")), F.lit("</pre></section>"))
    top = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), html_escape(F.col("session_id")), F.lit("</title></head><body>"))
    return _pages(events, item, top, "</body></html>", "")


# ---- aggregates ---------------------------------------------------------------------

def labels_by_session(findings: DataFrame, scans: DataFrame, source: str = "tool_arg") -> DataFrame:
    joined = findings.join(scans.filter(F.col("source") == source).select("scan_id", "session_id"), "scan_id")
    return joined.groupBy("session_id", "label").agg(F.count("*").alias("cnt")).orderBy("session_id", F.desc("cnt"), "label")


def labels_global(findings: DataFrame) -> DataFrame:
    return findings.groupBy("label").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "label")


def recent_scans(scans: DataFrame, findings: DataFrame, limit: int = 0) -> DataFrame:
    """Newest scans with their number of findings, also zero. The limit comes before the join."""
    top = scans.orderBy(F.desc("ts"), F.desc("scan_id")).limit(clamp_scans(limit))
    counts = findings.join(top.select("scan_id"), "scan_id", "left_semi").groupBy("scan_id").agg(F.count("*").alias("n_findings"))
    return top.join(counts, "scan_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0))).orderBy(F.desc("ts"), F.desc("scan_id"))


def protection_summary(events: DataFrame, tags: tuple[str, str] = hashing.TAGS) -> DataFrame:
    """One row: counts of the three protection types, events and sessions, and whether the
    whole chain verifies. Counts are given in either case."""
    n = lambda t, name: F.count_if(F.col("event_type") == t).alias(name)
    intact = F.coalesce(F.bool_and("ok"), F.lit(True)).alias("chain_intact")
    return chain_checks(events, tags).agg(n(RAW_SECRET, "raw_secrets_blocked"), n(LEAK, "tool_result_leaks_detected"), n(ALIAS, "secret_aliases_unresolved"), F.count("*").alias("total_events_audited"), F.countDistinct("session_id").alias("sessions_covered"), intact)


def recent_protection(events: DataFrame, limit: int, tags: tuple[str, str] = hashing.TAGS) -> DataFrame:
    """The newest events of the three protection types; none of them if the chain is broken,
    since their texts can't be trusted then."""
    return _if_intact(recent_events(events, None, list(PROTECTION_TYPES), limit), events, tags).orderBy(F.desc("event_id"))


def session_risk(deltas: DataFrame, sessions: DataFrame) -> DataFrame:
    """Summed risk of every session; sessions that only deltas know have source 'unknown'."""
    sums = deltas.groupBy("session_id").agg(F.sum("delta").alias("d"))
    return sessions.select("session_id", "source", "risk_score").join(sums, "session_id", "full").select("session_id", F.coalesce("source", F.lit("unknown")).alias("source"), (F.coalesce("risk_score", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("risk_score"))


def running_risk(deltas: DataFrame) -> DataFrame:
    by = Window.partitionBy("session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("running", F.sum("delta").over(by))


def worst_status(statuses: DataFrame, key: str) -> DataFrame:
    rank = F.when(F.col("status") == "error", 3).when(F.col("status") == "timeout", 2).when(F.col("status") == "ok", 1).otherwise(0)
    return statuses.groupBy(key).agg(F.max_by("status", F.struct(rank, "status")).alias("status"))


def decision_shares(classes: DataFrame) -> DataFrame:
    """decision, n, percent: shares of the four classes, rounded half up; zero of nothing."""
    keys = classes.sparkSession.createDataFrame([("allow",), ("approve",), ("deny",), ("monitor",)], "decision string")
    n = classes.groupBy("decision").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return keys.join(n, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n")).withColumn("percent", F.when(total == 0, 0).otherwise(F.floor(F.col("n") * 100.0 / total + 0.5)).cast("long"))


def session_text_counts(events: DataFrame) -> DataFrame:
    """Per session, events that mention decisions or secrets; categories may overlap."""
    t = F.lower(F.concat_ws(" ", "event_type", "redacted_text"))
    n = lambda cond, name: F.count_if(cond).alias(name)
    return events.groupBy("session_id").agg(
        F.count("*").alias("total"), n(t.contains("allow"), "allowed"), n(t.contains("deny"), "denied"), n(t.contains("approve") | t.contains("approval"), "approvals"),
        n(t.contains("secret") | t.contains("leak") | t.contains("pii"), "secrets"),
    )


# ---- approvals, servers, bindings ---------------------------------------------------

def pending(approvals: DataFrame, session_id: str | None = None) -> DataFrame:
    got = approvals.filter("status = 'Pending'")
    return (got if session_id is None else got.filter(F.col("session_id") == session_id)).orderBy("created_at", "approval_id")


def expired(approvals: DataFrame, now: int) -> DataFrame:
    return approvals.filter((F.col("status") == "Pending") & (F.col("expires_at") <= now))


def session_grants(calls: DataFrame, approvals: DataFrame, now: int) -> DataFrame:
    """For each call the newest approval for the session that covers it: same session,
    server, tool and arguments, approved with that scope, not expired."""
    keys = ["session_id", "server_id", "tool_name", "args_hash"]
    live = approvals.filter((F.col("status") == "Approved") & (F.col("scope") == "ThisSession") & (F.col("expires_at") > now))
    newest = live.groupBy(*keys).agg(F.max_by("approval_id", F.struct("resolved_at", "approval_id")).alias("granted_by"))
    return calls.join(newest, keys, "left")


def first_resolution(resolutions: DataFrame) -> DataFrame:
    """The first resolver of an approval wins."""
    return resolutions.groupBy("approval_id").agg(F.min_by(F.struct("status", "resolved_by", "resolved_at"), F.struct("resolved_at", "seq")).alias("r")).select("approval_id", "r.*")


def trusted_servers(servers: DataFrame) -> DataFrame:
    return servers.filter(F.col("trust_level").isin("Limited", "Trusted"))


def onboarding(servers: DataFrame) -> DataFrame:
    return servers.filter(F.col("trust_level") == "Untrusted")


def pending_tools(tools: DataFrame) -> DataFrame:
    """Tools that nobody has approved yet."""
    return tools.filter("approved_at is null")


def approved_hash(tools: DataFrame, server_id: str, tool_name: str) -> DataFrame:
    """The descriptor hash that a tool is pinned to, if it was approved."""
    return lookup(tools, server_id=server_id, tool_name=tool_name).filter("approved_at is not null").select("descriptor_hash")


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """The rows with these keys: a server, approval, outbox item, sandbox profile or token."""
    for name, value in keys.items():
        rows = rows.filter(F.col(name) == value)
    return rows


def listed(rows: DataFrame, *order: str, **keys: object) -> DataFrame:
    """All rows, or those with these keys, in an order; ends with a key to be total."""
    return lookup(rows, **keys).orderBy(*order)


def session_states(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: active and idle sessions, the highest risk, findings in all and secrets."""
    found = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("label") == "secret").alias("secrets"))
    states = sessions.agg(F.count_if(F.col("ended_at").isNull()).alias("active"), F.count_if(F.col("ended_at").isNotNull()).alias("idle"), F.max("risk_score").alias("highest"))
    return states.select("*", *[found.select(c).scalar().alias(c) for c in ("findings", "secrets")])


def latest_sessions(sessions: DataFrame, n: int = 2) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(n)


def drifted(rows: DataFrame, pending_column: str) -> DataFrame:
    return rows.filter(F.col(pending_column).isNotNull())


def resolve_bindings(calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bindings of each call: of its tool, or of all tools ('*'). Two equi-joins instead of
    a join with OR."""
    env = bindings.filter(F.col("injection_method") == "ChildEnv")
    exact = calls.join(env.filter("tool_name <> '*'"), ["server_id", "tool_name"])
    wild = calls.join(env.filter("tool_name = '*'").drop("tool_name"), "server_id")
    return exact.unionByName(wild.select(*exact.columns))


def requested_env_keys(servers: DataFrame, bindings: DataFrame) -> DataFrame:
    """Distinct environment keys of each server; null with no bindings at all, empty where
    bindings name none."""
    keys = bindings.groupBy("server_id").agg(F.array_sort(F.collect_set("env_key")).alias("env_keys"))
    return servers.select("server_id").join(keys, "server_id", "left")


def descriptor_status(calls: DataFrame, servers: DataFrame, pins: DataFrame) -> DataFrame:
    """Adds descriptor: ApprovedStable, Drifted or FirstSeen."""
    trust = trusted_servers(servers).select("server_id", F.lit(True).alias("__trusted"))
    approved = pins.filter("approved_at is not null").select("server_id", "tool_name", F.col("descriptor_hash").alias("__pinned"))
    joined = calls.join(trust, "server_id", "left").join(approved, ["server_id", "tool_name"], "left")
    known = F.coalesce(F.col("descriptor_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)) & F.coalesce("__trusted", F.lit(False)) & F.col("__pinned").isNotNull()
    status = F.when(~known, "FirstSeen").when(F.col("__pinned") == F.col("descriptor_hash"), "ApprovedStable").otherwise("Drifted")
    return joined.withColumn("descriptor", status).drop("__trusted", "__pinned")


def metadata_tampering(metadata: DataFrame, events: DataFrame) -> DataFrame:
    """Adds bound: whether each row equals the event that binds it; rows without a binding
    event id are from before bindings and pass."""
    e = events.select(F.col("event_id").alias("bound_event_id"), F.col("payload_json").alias("__p"))
    joined = metadata.join(e, "bound_event_id", "left")
    same = F.lit(True)
    for c in ("token_ref", "issuer", "resource"):
        same = same & F.get_json_object("__p", f"$.{c}").eqNullSafe(F.col(c))
    return joined.withColumn("bound", F.col("bound_event_id").isNull() | (F.col("__p").isNotNull() & same)).drop("__p")
