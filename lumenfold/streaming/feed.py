"""The committed ledger as a stream: new events in order, from an event id on.

The stream follows the log of commits, whose files appear whole and in order, so it sees a
commit's events all or not, and its checkpoint says which commits were delivered. A batch that
was under way when the query ended is delivered again with its number; store.sink() and
TextIndex.add() take it once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import LedgerStore
from ..operators.text_index import TextIndex


def feed(store: LedgerStore, deliver: Callable[[DataFrame, int], None], progress: str, after: int = 0, commits: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that calls deliver(events, number) for the events after `after`, and goes on
    where the one before with the same `progress` folder ended.

    commits: how many are taken at once at most. trigger: see DataStreamWriter.trigger; by
    default what is there is delivered and the query ends.
    """
    store.log._fs.mkdirs(store.log._at)
    reader = store.spark.readStream.schema("value string").option("wholetext", True)
    if commits:
        reader = reader.option("maxFilesPerTrigger", commits)

    def batch(rows: DataFrame, number: int) -> None:
        entries = sorted((json.loads(r.value) for r in rows.collect()), key=lambda e: e["version"])  # bounded: `commits`
        entries = [e for e in entries if e["last_id"] > after]
        if entries:
            deliver(store._read(entries).filter(F.col("event_id") > after).orderBy("event_id"), number)

    stream = reader.format("text").load(f"{store.path}/commits").writeStream.foreachBatch(batch)
    return stream.option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()


def follow(store: LedgerStore, index: TextIndex, progress: str, commits: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Keeps an index up to date with the ledger."""
    return feed(store, lambda events, _: index.add(events), progress, commits=commits, trigger=trigger)
