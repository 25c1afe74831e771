"""Structured Streaming forms of the stateful reads: running session risk and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_risk(deltas: DataFrame) -> DataFrame:
    """A stream of (session_id, delta) -> session_id, risk_score; update or complete mode.

    State is one sum for each session; partial sums are made before the shuffle.
    """
    return deltas.groupBy("session_id").agg(F.sum("delta").alias("risk_score"))


def risk_escalations(deltas: DataFrame, threshold: int = 24) -> DataFrame:
    """A row for each session the first time that its summed risk reaches the threshold."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, told = state.get if state.exists else (0, False)
        total += int(sum(p["delta"].sum() for p in parts))
        if total >= threshold and not told:
            told = True
            yield pd.DataFrame([(key[0], total)], columns=["session_id", "risk_score"])
        state.update((total, told))

    return deltas.groupBy("session_id").applyInPandasWithState(run, "session_id string, risk_score long", "total long, told boolean", "append", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of events (ts, event_type) -> counts by window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def expired_approvals(approvals: DataFrame, now: int) -> DataFrame:
    """A stream of pending approvals -> those already past their time, marked Expired."""
    return approvals.filter((F.col("status") == "Pending") & (F.col("expires_at") <= now)).withColumn("status", F.lit("Expired"))
