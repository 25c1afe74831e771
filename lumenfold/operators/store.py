"""The ledger as a committed table: immutable segments, and a log that says which there are.

An append reads the head from the last commit, chains its batch to it, writes a segment of its
own and commits that with the version it has read. Of two writers on one head the second gets
a Conflict and may try again; a segment that no commit names is not part of the ledger. A
stream writes each of its batches once, also after a restart (see sink()).

Verification keeps what it has checked: for each segment its rows, its last hash and how its
files looked. The next one reads the segments that are new or whose files have changed since,
and the one after each such; links into them start from the last hash of the segment before.
Its cost follows what is new. A change that keeps length and time of a file is seen by a full
verification only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..sources.commits import CommitLog, Conflict
from ..sources.schemas import SCHEMAS
from . import ledger

__all__ = ["Conflict", "LedgerStore", "Verified"]


@dataclass(frozen=True)
class Verified:
    """ok; the first event at which the ledger isn't what it was, or null; its events by the
    log; and how many rows were read to say so."""

    ok: bool
    broken_at: int | None
    n_events: int
    n_read: int


class LedgerStore:
    """A ledger at a path. tags: see hashing.TAGS."""

    def __init__(self, spark: SparkSession, path: str, tags: tuple[str, str] = hashing.TAGS):
        self.spark, self.path, self.tags = spark, path.rstrip("/"), tags
        self.log, self.checked = CommitLog(spark, f"{self.path}/commits"), CommitLog(spark, f"{self.path}/verified")

    def _folder(self, segment: dict) -> str:
        return f"{self.path}/segments/{segment['segment']}"

    def version(self) -> int:
        return self.log.version()

    def head(self) -> tuple[int, str]:
        """Number and hash of the newest event; (0, '') of an empty ledger."""
        _, last = self.log.last()
        return (last["last_id"], last["head_hash"]) if last else (0, "")

    def _read(self, segments: list[dict]) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS["events"])
        return reader.parquet(*map(self._folder, segments)) if segments else self.spark.createDataFrame([], SCHEMAS["events"])

    def events(self, version: int | None = None) -> DataFrame:
        """The events as of a version, or now."""
        return self._read(self.log.entries(version))

    def since(self, event_id: int) -> DataFrame:
        """Events after one; segments that end before aren't opened."""
        return self._read([s for s in self.log.entries() if s["last_id"] > event_id]).filter(F.col("event_id") > event_id)

    # ---- writes ---------------------------------------------------------------------

    def append(self, batch: DataFrame, expected: int | None = None, typed: bool = False, writer: str | None = None, number: int | None = None) -> int:
        """Commits a batch (see ledger.extension()) and returns the new version.

        expected: the version that the batch is meant to follow; Conflict where the ledger has
        moved on, before or while the batch is written. writer, number: a batch with a number
        that this writer has committed already isn't committed again. An empty batch commits
        nothing.
        """
        version, last = self.log.last()
        if expected is not None and expected != version:
            raise Conflict(f"version {expected} was expected, {version} is there")
        writers = dict(last["writers"]) if last else {}
        if writer is not None and writers.get(writer, -1) >= number:
            return version
        at, previous = (last["last_id"], last["head_hash"]) if last else (0, "")
        return self._commit(version, ledger.extension(batch, at, previous, typed, self.tags), writers | ({writer: number} if writer is not None else {}))

    def adopt(self, events: DataFrame) -> int:
        """Commits numbered events as the first segment: an import, whose gaps stay."""
        if self.version():
            raise Conflict("the ledger isn't empty")
        return self._commit(0, ledger.build_chain(events, "", self.tags), {})

    def _commit(self, version: int, rows: DataFrame, writers: dict[str, int]) -> int:
        segment = {"segment": uuid.uuid4().hex}
        columns = [f.split()[0] for f in SCHEMAS["events"].split(", ")]
        rows.select(*columns).write.parquet(self._folder(segment))
        ends = self._read([segment]).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.min_by("prev_hash", "event_id").alias("follows"), F.max_by("event_hash", "event_id").alias("head_hash")).first()
        if not ends.n:
            return version
        return self.log.commit(version, segment | ends.asDict() | {"writers": writers})

    def sink(self, writer: str, tries: int = 5) -> Callable[[DataFrame, int], None]:
        """For DataStreamWriter.foreachBatch: each batch is appended once, in its order, and
        chained anew where another writer was faster."""

        def write(batch: DataFrame, number: int) -> None:
            for left in range(tries - 1, -1, -1):
                try:
                    self.append(batch, writer=writer, number=number)
                    return
                except Conflict:
                    if not left:
                        raise

        return write

    # ---- verification ---------------------------------------------------------------

    def _looks(self, segment: dict) -> list:
        return [list(x) for x in self.log.listing(self._folder(segment))]

    def verify(self, full: bool = False) -> Verified:
        """Verifies what isn't known to be right; full: all of it. What holds is kept for the
        next time; after a break nothing is."""
        segments = self.log.entries()
        at, last = self.checked.last()
        known = last["segments"] if last else {}
        state = {s["segment"]: [s["first_id"], s["last_id"], s["n"], s["follows"], s["head_hash"], self._looks(s)] for s in segments}
        changed = [full or known.get(s["segment"]) != state[s["segment"]] for s in segments]
        wanted = [i for i in range(len(segments)) if changed[i] or (i and changed[i - 1])]
        ends = [segments[i - 1] for i in wanted if i and i - 1 not in wanted]
        found = self._check([segments[i] for i in wanted], [(s["last_id"], s["head_hash"], hashing.CURRENT_VERSION) for s in ends])
        faults = [v[0] for k, v in known.items() if k not in state] + ([] if found.ok else [found.broken_at])
        if not faults and known != state:
            self.checked.commit(at, {"segments": state})
        return Verified(not faults, min(faults, default=None), sum(s["n"] for s in segments), found.n_read)

    def verify_after(self, event_id: int, event_hash: str) -> Verified:
        """Verifies the events after an anchor from elsewhere, and that the anchor's event is
        here with that hash. Segments before it aren't opened, but for its own."""
        segments = self.log.entries()
        total = sum(s["n"] for s in segments)
        own = self._read([s for s in segments if s["first_id"] <= event_id <= s["last_id"]]).filter(F.col("event_id") == event_id)
        own = [tuple(r) for r in own.select("event_id", "event_hash", "chain_version").collect()]
        if [r[1] for r in own] != [event_hash]:
            return Verified(False, event_id, total, len(own))
        found = self._check([s for s in segments if s["last_id"] > event_id], own, event_id)
        return Verified(found.ok, found.broken_at, total, found.n_read + 1)

    def _check(self, segments: list[dict], trusted: list[tuple], after: int | None = None) -> Verified:
        """Of segments: their chains from trusted events on, and that each is as committed."""
        there = [s for s in segments if self._looks(s)]
        rows = self._read(there).withColumn("__segment", F.regexp_extract("_metadata.file_path", "/segments/([0-9a-f]+)/", 1)) if there else None
        each = {}
        if rows is not None:
            rows = rows if after is None else rows.filter(F.col("event_id") > after)
            known = self.spark.createDataFrame(trusted, "event_id long, event_hash string, chain_version int") if trusted else None
            checks = ledger.chain_checks(rows, self.tags, known).groupBy("__segment")
            broken = F.min(F.when(~F.col("ok"), F.col("event_id"))).alias("broken_at")
            each = {r["__segment"]: r for r in checks.agg(F.count("*").alias("n"), broken, F.max_by("event_hash", "event_id").alias("end")).collect()}  # bounded: segments read
        faults = [r.broken_at for r in each.values() if r.broken_at is not None]
        for s in segments:
            r = each.get(s["segment"])
            if r is None or r.end != s["head_hash"] or (after is None and r.n != s["n"]):
                faults.append(s["last_id"])
        return Verified(not faults, min(faults, default=None), 0, sum(r.n for r in each.values()))
