"""Registered queries over stored structures, the committed ledger and the search index, and over streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import ledger
from ..operators.store import LedgerStore
from ..operators.text_index import TextIndex
from ..sources import derived as d
from ..sources.derived import sql
from ..sources.scratch import scratch_path
from ..streaming import stateful
from .catalog import _FORMS, _FORMS_SQL, query

#: Batches that the ledger is appended in, by event_id.
BATCHES = 4


def _batches(spark: SparkSession, sf: str) -> list[DataFrame]:
    e = d.events(spark, sf).withColumnRenamed("event_id", "seq")
    low, high = e.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return []
    part = F.expr(f"(seq - {low}) * {BATCHES} div ({high} - {low} + 1)")
    return [e.filter(part == b) for b in range(BATCHES)]


def _appended(spark: SparkSession, sf: str) -> LedgerStore:
    store = LedgerStore(spark, scratch_path(spark, "appended"))
    for batch in _batches(spark, sf):
        store.append(batch, expected=store.version(), typed=True)
    return store


_PARTED = "SELECT *, (event_id - min(event_id) OVER ()) * {n} // (max(event_id) OVER () - min(event_id) OVER () + 1) AS part FROM ledger_events".format(n=BATCHES)


@query(sql("""SELECT n AS event_id, session_id, event_type, payload_json, redacted_text, created_at, n - 1 AS previous, true AS hash_fits
 FROM (SELECT * EXCLUDE payload_json, '{"k":' || json_extract_string(payload_json, '$.k') || '}' AS payload_json, row_number() OVER (ORDER BY event_id) AS n FROM ledger_events)""", "ledger_events"))  # fmt: skip
def k1_committed_appends(spark: SparkSession, sf: str) -> DataFrame:
    """All events, appended in batches that each extend the last commit: numbers and links go on
    over the batches."""
    e = _appended(spark, sf).events()
    named = e.select(F.col("event_hash").alias("prev_hash"), F.col("event_id").alias("previous"))
    again = hashing.event_hash(*[F.col(c) for c in ("chain_version", "prev_hash", "payload_json", "created_at", "session_id", "event_type", "redacted_text")])
    linked = e.withColumn("hash_fits", again == F.col("event_hash")).join(named, "prev_hash", "left")
    return linked.select("event_id", "session_id", "event_type", "payload_json", "redacted_text", "created_at", F.coalesce("previous", F.lit(0)).alias("previous"), "hash_fits")


@query(sql(f"""SELECT part + 1 AS step, true AS ok, CAST(sum(n) OVER (ORDER BY part) AS BIGINT) AS n_events, n AS n_read
 FROM (SELECT part, count(*) AS n FROM ({_PARTED}) GROUP BY part) UNION ALL
 SELECT 100, true, count(*), 0 FROM ledger_events UNION ALL SELECT 101, true, count(*), count(*) FROM ledger_events UNION ALL
 SELECT 102, true, count(*), 1 + (SELECT count(*) FROM ({_PARTED}) WHERE part >= {BATCHES} - 2) FROM ledger_events""", "ledger_events"))  # fmt: skip
def c3_verify_increments(spark: SparkSession, sf: str) -> DataFrame:
    """A verification after each append reads the new segment alone; then one with nothing new
    (step 100), a full one (101) and one after an anchor at the half (102)."""
    store, told, anchors = LedgerStore(spark, scratch_path(spark, "appended")), [], []
    for i, batch in enumerate(_batches(spark, sf), 1):
        store.append(batch, expected=store.version(), typed=True)
        anchors.append(store.head())
        told.append((i, store.verify()))
    if anchors:
        told += [(100, store.verify()), (101, store.verify(full=True)), (102, store.verify_after(*anchors[BATCHES // 2 - 1]))]
    return spark.createDataFrame([(i, v.ok, v.n_events, v.n_read) for i, v in told], "step int, ok boolean, n_events long, n_read long")


#: What is wrong with a line of anchors, by event_id.
_FAULTS = {"is blank": ("event_id % 50 = 0", " "), "is not JSON": ("event_id % 70 = 0", "{"), "is not an anchor": ("event_id % 110 = 0", "[1]")}
_FAULT_SQL = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for name, (c, _) in _FAULTS.items()) + " END"


@query(sql(f"SELECT line, CASE WHEN fault IS NULL THEN event_id END AS event_id, fault FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line, {_FAULT_SQL} AS fault FROM ledger_events)", "ledger_events"))
def s5_checkpoint_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A list of anchors in files by event_id, one for each event, with faulty lines, read by ranges."""
    point = F.to_json(F.struct("event_id", "event_hash", "prev_hash", "session_id", "event_type", "created_at", F.col("created_at").alias("anchored_at")))
    for condition, text in reversed(_FAULTS.values()):
        point = F.when(F.expr(condition), text).otherwise(point)
    path = scratch_path(spark, "anchors")
    d.chained(spark, sf).select("event_id", point.alias("value")).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    lines = ledger.checkpoint_lines(spark, path).select("path", "line", "event_id", "fault")
    sizes = lines.groupBy("path").agg(F.count("*").alias("n"))
    # files are named in the order of their ranges; one row for each
    before = sizes.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
    return lines.join(F.broadcast(before), "path").select((F.col("before") + F.col("line")).alias("line"), "event_id", "fault")


# ---- search by an index -------------------------------------------------------------

def _indexed(spark: SparkSession, events: DataFrame, parts: int) -> TextIndex:
    """An index that is opened anew for each of `parts` increments, by event_id."""
    path = scratch_path(spark, "index")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    for i in range(parts if low is not None else 0):
        TextIndex(spark, path, 16).add(events.filter(F.col("event_id") <= low + (high - low) * (i + 1) // parts))
    return TextIndex(spark, path, 16)


@query(sql(f"{_FORMS_SQL} UNION ALL SELECT 'limit', event_id FROM (SELECT event_id FROM ledger_events WHERE redacted_text LIKE 'click %' ORDER BY event_id LIMIT 7)", "ledger_events"))
def a9_index_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The forms of a9_search_forms from an index that grew by five increments and was merged."""
    e = d.events(spark, sf)
    index = _indexed(spark, e, 5)
    found = [index.ids(q).select(F.lit(name).alias("form"), "event_id") for name, (q, _) in _FORMS.items()]
    return reduce(DataFrame.unionByName, found, index.search("click", e, 7).select(F.lit("limit").alias("form"), "event_id"))


#: Queries over conversations, and what they come to on `t`, the tokens between blanks.
_TURN_FORMS = {
    "word": ("the", "t LIKE '% the %'"), "all": ("the de", "t LIKE '% the %' AND t LIKE '% de %'"), "any": ("QUE OR with", "t LIKE '% que %' OR t LIKE '% with %'"),
    "phrase": ('"of the"', "t LIKE '% of the %'"), "phrase and prefix": ('"of th"*', "t LIKE '% of th%'"), "three words": ('"in of the"', "t LIKE '% in of the %'"), "prefix": ("wit*", "t LIKE '% wit%'"),
    "accents": ("CIONES* OR ciones OR é", "t LIKE '% ciones%' OR t LIKE '% e %'"), "without": ("of NOT the NOT event_type:turn.user", "t LIKE '% of %' AND t NOT LIKE '% the %' AND event_type <> 'turn.user'"),
    "grouped": ("(event_type:turn.system OR session_id:s7) AND (the OR la)", "(event_type = 'turn.system' OR session_id = 's7') AND (t LIKE '% the %' OR t LIKE '% la %')"), "none": ("thethethe", "false"),
}
_TURN_TOKENS = "' ' || trim(regexp_replace(strip_accents(lower(coalesce(redacted_text, ''))), '[^\\p{L}\\p{N}\\p{Co}_.\\-]+', ' ', 'g')) || ' '"
_TURN_SQL = " UNION ALL ".join(f"SELECT '{name}' AS form, event_id, redacted_text FROM tokened WHERE {c}" for name, (_, c) in _TURN_FORMS.items())


@query(sql(f"SELECT form, event_id, sha256(redacted_text) AS text_sha256 FROM (WITH tokened AS (SELECT *, {_TURN_TOKENS} AS t FROM turns) {_TURN_SQL})", "turns"))
def a9_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of queries over all turns of all conversations, from an index of three increments."""
    e = d.turns(spark, sf)
    index = _indexed(spark, e, 3)
    found = [index.hits(q, e).select(F.lit(name).alias("form"), "event_id", F.sha2(F.col("redacted_text").cast("binary"), 256).alias("text_sha256")) for name, (q, _) in _TURN_FORMS.items()]
    return reduce(DataFrame.unionByName, found)


# ---- streams ------------------------------------------------------------------------

#: Micro-batches that a stream takes its rows in.
TURNS = 3


def _played(spark: SparkSession, rows: DataFrame, end: dict[str, object], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What make(stream) gives for rows (at, ...) that come in `TURNS` micro-batches by time, and
    then two of rows `end` far in the future, so that the watermark passes all of them. A batch
    is as many files as there are cores; that some may be empty and missing mixes batches only."""
    source, sink = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    low, high = (low, high) if low is not None else (0, 0)
    turn, files = F.expr(f"(at - {low}) * {TURNS} div ({high} - {low} + 1)"), max(1, spark.sparkContext.defaultParallelism)
    for i in range(TURNS):
        rows.filter(turn == i).repartition(files).write.mode("append").parquet(source)
    for i in (1, 2):
        last = spark.range(0, files, 1, files).select(*[F.lit(end.get(c, high + i * 10**6 if c == "at" else None)).cast(t).alias(c) for c, t in rows.dtypes])
        last.write.mode("append").parquet(source)
    before = {k: spark.conf.get(k) for k in stateful.ROCKSDB}
    for k, v in stateful.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source))
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(sink)


@query()
def d1_streamed_drift(spark: SparkSession, sf: str) -> DataFrame:
    """d1_descriptor_drift from a stream: the last state of each key. SQL can't express it; a
    test compares it with d1_descriptor_drift."""
    keys = ["server_id", "tool_name"]
    out = _played(spark, d.observations(spark, sf), {"server_id": "end", "tool_name": "end", "seq": 1 << 40, "op": "observe"}, lambda s: stateful.drift(s, keys, "descriptor"))
    last = out.filter("server_id <> 'end'").groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), "upto").alias("s"))
    return last.select(*keys, "s.*").drop("upto")


@query(sql("SELECT approval_id, expires_at FROM approvals WHERE status = 'Pending'", "approvals"))
def p5_streamed_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Approvals that nobody resolved before their end, by timers on event time."""
    a = d.approvals(spark, sf)
    opened = a.select(F.col("approval_id").alias("item_id"), F.lit("open").alias("op"), F.col("created_at").alias("at"), "expires_at")
    closed = a.filter("resolved_at is not null").select(F.col("approval_id").alias("item_id"), F.lit("close").alias("op"), F.col("resolved_at").alias("at"), F.lit(None).cast("long").alias("expires_at"))
    out = _played(spark, opened.unionByName(closed), {"item_id": -1, "op": "open"}, stateful.expiries)
    return out.select(F.col("item_id").alias("approval_id"), "expires_at")
