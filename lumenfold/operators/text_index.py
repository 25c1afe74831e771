"""A positional inverted index for full-text search, kept in a folder.

A posting is a row: term, event, field, position. Postings lie in immutable segments, dealt to
buckets by their term and sorted by term and event, as pages of differences (Parquet's delta
encodings of both integers and strings). A bucket of a segment, and so a frequent term, is
written in a part for each `BLOCK` events or `PART_ROWS` postings, about: as many files as these
need, whatever the session's partitions and the gaps between numbers of events. Each segment
has a dictionary of its terms, sorted by term.

A search opens the buckets of its terms and in these the pages that hold them; prefixes look
their buckets up in the dictionary first. Phrases are found by positions. All terms of a query
meet in one shuffle by event, whatever its form.

add() indexes the events after the last one that it has seen and commits a new segment.
`FAN_IN` segments of a level are merged into one of the next, so an event is written again
once for each level. Texts and queries go through the steps of search.py, and hits are the same
as of its scan.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog, Conflict
from . import search as scan

POSTING = "term string, event_id long, field int, pos int, bucket int"
TERM = "term string, bucket int, n long"
SHOWN = ["event_id", "session_id", "event_type", "redacted_text", "created_at"]
BUCKETS, FAN_IN, BLOCK, PART_ROWS = 64, 4, 1 << 20, 1 << 18
#: Numbers of events that follow each other in a part.
RUN = 16
#: Characters of a posting, about, to tell their number before they are made.
POSTING_CHARS = 4
#: Characters of the events that one task makes postings of, about.
TASK_CHARS = 1 << 20
#: Sorted columns as differences: version 2 pages, without dictionaries.
DELTA = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def postings(events: DataFrame, buckets: int) -> DataFrame:
    """(term, event_id, field, pos, bucket) of the fields of events."""
    def of(number: int) -> Column:
        return F.transform(scan.tokens(F.col(scan.FIELDS[number])), lambda t, i: F.struct(t.alias("term"), F.lit(number).alias("field"), i.cast("int").alias("pos")))

    each = F.flatten(F.array(*map(of, range(len(scan.FIELDS)))))
    rows = events.select(F.col("event_id").cast("long").alias("event_id"), F.explode(each).alias("p"))
    return rows.select("p.term", "event_id", "p.field", "p.pos", _bucket(F.col("p.term"), buckets).alias("bucket"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class _Leaves(scan._Parser):
    """The parser of search.py over postings: its terms become Columns over `hits`, an array of
    (field, term, pos) of one event, and are listed."""

    def __init__(self, query: str):
        super().__init__(query)
        self.exact: set[str] = set()
        self.prefixes: set[str] = set()

    def term(self, text: str, fields: tuple[str, ...]) -> Column:
        prefix = text.endswith("*")
        words = [w for w in scan.tokens_of(text.rstrip("*").strip('"')) if w]
        if not words:
            raise ValueError(f"no token in {text!r}")
        self.exact.update(words[:-1] if prefix else words)
        self.prefixes.update(words[-1:] if prefix else ())
        fits = lambda h, k: h["term"].startswith(words[k]) if prefix and k == len(words) - 1 else h["term"] == words[k]
        numbers = [scan.FIELDS.index(f) for f in fields]
        if len(words) == 1:
            return F.exists("hits", lambda h: h["field"].isin(numbers) & fits(h, 0))

        def starts(number: int, k: int) -> Column:
            """Where a phrase would begin, by its word k."""
            own = F.filter("hits", lambda h: (h["field"] == number) & fits(h, k))
            return F.transform(own, lambda h: h["pos"] - k)

        phrase = lambda n: F.size(reduce(F.array_intersect, [starts(n, k) for k in range(len(words))])) > 0
        return reduce(lambda a, b: a | b, [phrase(n) for n in numbers])


class TextIndex:
    """An index at a path. buckets: of a new index; an existing one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")
        _, last = self.log.last()
        self.buckets = last["buckets"] if last else buckets

    def _state(self) -> tuple[int, dict]:
        version, last = self.log.last()
        return version, last or {"buckets": self.buckets, "mark": None, "segments": []}

    def _rows(self, segments: list[dict], kind: str, schema: str) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/{kind}"
        rows = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/segment={s['name']}" for s in segments])
        return rows.select(*[c.split()[0] for c in schema.split(", ")])

    # ---- writes ---------------------------------------------------------------------

    def add(self, events: DataFrame) -> int:
        """Indexes the events (event_id, session_id, event_type, redacted_text) with numbers
        above all that were indexed before, and returns the version. Conflict if another
        writer has added some meanwhile; nothing is indexed then."""
        version, state = self._state()
        new = events if state["mark"] is None else events.filter(F.col("event_id") > state["mark"])
        chars = reduce(lambda a, b: a + b, [F.coalesce(F.length(f), F.lit(0)) for f in scan.FIELDS])
        ends = new.agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.sum(chars).alias("chars")).first()
        if not ends.n:
            return version
        rows = new.filter(F.col("event_id") <= ends.last).select("event_id", *scan.FIELDS)
        # a file may be one row group, and events of an increment lie in few of them
        tasks = -(-ends.chars // TASK_CHARS)
        dealt = rows.repartition(tasks, "event_id") if tasks > 1 else rows
        segment = self._write(postings(dealt, self.buckets), 0, ends.n, ends.chars // POSTING_CHARS)
        version = self.log.commit(version, state | {"mark": ends.last, "segments": [*state["segments"], segment]})
        return self._merge(version)

    def _write(self, rows: DataFrame, level: int, events: int, n: int) -> dict:
        """A segment of so many events and about n postings, and its dictionary."""
        name = uuid.uuid4().hex
        parts = max(1, -(-events // BLOCK), -(-n // (self.buckets * PART_ROWS)))
        dealt = rows.repartition(self.buckets * parts, "bucket", F.pmod(F.xxhash64(F.expr(f"event_id div {RUN}")), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "term", "event_id", "field", "pos").write.options(**DELTA).partitionBy("bucket").parquet(f"{self.path}/postings/segment={name}")
        written = self._rows([{"name": name}], "postings", POSTING)
        terms = written.groupBy("bucket", "term").agg(F.count("*").alias("n")).select("term", "bucket", "n")
        terms.repartitionByRange("term").sortWithinPartitions("term").write.options(**DELTA).parquet(f"{self.path}/terms/segment={name}")
        return {"name": name, "level": level, "events": events}

    def _merge(self, version: int) -> int:
        """Merges levels that are full. Another writer's commit meanwhile is left to go first."""
        while True:
            _, state = self._state()
            levels: dict[int, list[dict]] = {}
            for s in state["segments"]:
                levels.setdefault(s["level"], []).append(s)
            full = [k for k, group in levels.items() if len(group) >= FAN_IN]
            if not full:
                return version
            group = levels[min(full)]
            rows = self._rows(group, "postings", POSTING)
            one = self._write(rows, min(full) + 1, sum(s.get("events", 0) for s in group), rows.count())
            names = {s["name"] for s in group}
            try:
                version = self.log.commit(version, state | {"segments": [s for s in state["segments"] if s["name"] not in names] + [one]})
            except Conflict:
                return self.log.version()

    def vacuum(self) -> int:
        """Deletes the folders of segments that the last version doesn't name; readers and
        writers of earlier ones must have ended. Returns how many."""
        held = {s["name"] for s in self._state()[1]["segments"]}
        gone = set()
        for kind in ("postings", "terms"):
            at = self.log._path(f"{self.path}/{kind}")
            for s in self.log._fs.listStatus(at) if self.log._fs.exists(at) else []:
                name = s.getPath().getName().removeprefix("segment=")
                if name not in held:
                    gone.add(name)
                    self.log._fs.delete(s.getPath(), True)
        return len(gone)

    # ---- reads ----------------------------------------------------------------------

    def terms(self, prefix: str = "") -> DataFrame:
        """The dictionary: term, bucket, n postings."""
        rows = self._rows(self._state()[1]["segments"], "terms", TERM)
        return rows.filter(F.col("term").startswith(prefix)).groupBy("term", "bucket").agg(F.sum("n").alias("n"))

    def matching(self, exact: set[str], prefixes: set[str] = frozenset()) -> DataFrame:
        """The postings of some terms, from their buckets alone."""
        segments = self._state()[1]["segments"]
        wanted = F.col("term").isin(sorted(exact)) if exact else F.lit(False)
        for p in sorted(prefixes):
            wanted = wanted | F.col("term").startswith(p)
        buckets = [_bucket(F.lit(t), self.buckets) for t in sorted(exact)]
        own = set(self.spark.range(1).select(F.array(*buckets).cast("array<int>").alias("b")).first().b)
        if prefixes and segments:
            starts = reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in sorted(prefixes)])
            own |= {r.bucket for r in self._rows(segments, "terms", TERM).filter(starts).select("bucket").distinct().collect()}  # bounded: buckets
        return self._rows(segments, "postings", POSTING).filter(F.col("bucket").isin(sorted(own)) & wanted)

    def ids(self, query: str) -> DataFrame:
        """event_id of the events that match; see search.search() for the forms of queries."""
        parser = _Leaves(query)
        hit = parser.either()
        if parser.peek() is not None:
            raise ValueError("unbalanced parenthesis")
        found = self.matching(parser.exact, parser.prefixes)
        return found.groupBy("event_id").agg(F.collect_list(F.struct("field", "term", "pos")).alias("hits")).filter(hit).select("event_id")

    def hits(self, query: str, events: DataFrame) -> DataFrame:
        """search() without an order, for callers that need none."""
        return events.join(self.ids(query), "event_id", "left_semi").select(*SHOWN)

    def search(self, query: str, events: DataFrame, limit: int | None = None) -> DataFrame:
        """search.search() by the index: the same rows, where all of events are indexed."""
        if not limit:
            return self.hits(query, events).orderBy("event_id")
        first = [r.event_id for r in self.ids(query).orderBy("event_id").limit(limit).collect()]  # bounded: limit
        return events.filter(F.col("event_id").isin(first)).select(*SHOWN).orderBy("event_id")
