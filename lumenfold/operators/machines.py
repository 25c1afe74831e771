"""State machines folded over ordered events, one key at a time.

Drift machines stream: the events of a key come to one task in order and are taken one by
one, so a key's history is never held. The other ones are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Pin:
    """What is known of a key: the pinned hash, when it was approved, the hash that waits for
    approval and since when, and counts of first pins, drifts and ops that didn't fit."""

    hash: str | None = None
    approved_at: int | None = None
    pending: str | None = None
    drift_at: int | None = None
    n_first: int = 0
    n_drift: int = 0
    n_invalid: int = 0

    def settle(self, hash: str | None) -> None:
        self.hash, self.pending, self.drift_at = hash, None, None

    def observe(self, hash: str, at: int, kind: str) -> None:
        if self.hash is None and kind == "command":
            return
        if hash == self.hash:
            self.settle(hash)
        elif self.hash is None or (kind == "descriptor" and self.approved_at is None):
            self.settle(hash)
            self.n_first += 1
        else:
            self.pending, self.n_drift = hash, self.n_drift + 1
            if kind != "program" and self.drift_at is None:
                self.drift_at = at

    def decide(self, op: str, hash: str | None, at: int, kind: str) -> bool:
        """Ops of people; false for one that the state doesn't allow."""
        waiting, descriptor = self.pending is not None, kind == "descriptor"
        if op == "register" and kind == "command" and self.hash is None and hash is not None:
            self.settle(hash)
            self.n_first += 1
        elif op == "reject" and waiting:
            self.settle(self.hash)
        elif op == "approve" and descriptor and self.hash is not None and self.approved_at is None:
            self.approved_at = at
        elif op == "approve" and not descriptor and waiting:
            self.settle(self.pending)
        elif op == "approve_to" and descriptor and self.approved_at is not None and waiting and hash == self.pending:
            self.settle(self.pending)
            self.approved_at = at
        else:
            return False
        return True

    def take(self, op: str, hash: str | None, at: int, kind: str, last: tuple | None) -> None:
        """One event of the key; last: op and hash of the one before it."""
        if op == "observe" and last == (op, hash):
            return
        if op == "observe" and hash is not None:
            self.observe(hash, at, kind)
        elif op == "observe" or not self.decide(op, hash, at, kind):
            self.n_invalid += 1


STATE = "hash string, approved_at long, pending string, drift_at long, n_first int, n_drift int, n_invalid int"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def fold(events: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """events (keys, seq, op, hash, at) -> keys and the state after the last one.

    kind 'descriptor': a first hash is pinned, overwritten until it's approved, then
    drifts. 'command': pinned by op 'register' only. 'program': the first one seen is
    pinned. Ops: observe, register, approve, approve_to, reject; an op that doesn't fit
    the state counts as invalid. An observation that repeats the one before changes nothing.
    Keys may be null. Ties in seq go by op, hash and time.
    """
    kinds = dict(events.dtypes)
    ordered = events.select(*keys, "seq", "op", "hash", F.col("at").cast("long").alias("at")).repartition(*keys).sortWithinPartitions(*keys, "seq", "op", "hash", "at")
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys]) + ", " + STATE
    names = [f.name for f in fields(Pin)]
    types = [_TYPES[part.split()[1]] for part in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pin, kept, last = None, Pin(), None, None

        def out(rows: list) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in rows], t) for i, t in enumerate(kept)] + [pa.array([s[i] for _, s in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, [*keys, *names])

        for batch in batches:
            kept, done = [batch.schema.field(i).type for i in range(len(keys))], []
            *ids, _, ops, hashes, ats = (c.to_pylist() for c in batch.columns)
            for *own, op, hash, at in zip(*ids, ops, hashes, ats, strict=True):
                if own != key:
                    if key is not None:
                        done.append((key, astuple(pin)))
                    key, pin, last = own, Pin(), None
                pin.take(op, hash, at, kind, last)
                last = op, hash
            if done:
                yield out(done)
        if key is not None:
            yield out([(key, astuple(pin))])

    return ordered.mapInArrow(run, schema)


#: Which states of an outbox item an op leaves, and for which.
OUTBOX = {
    "submit": (("Drafted",), "PendingApproval"), "approve": (("PendingApproval",), "Approved"), "deny": (("PendingApproval",), "Denied"), "expire": (("PendingApproval",), "Expired"),
    "execute": (("Approved",), "Executed"), "fail": (("Approved",), "Failed"), "cancel": (("Drafted", "PendingApproval"), "Cancelled"),
}


def fold_outbox(ops: DataFrame) -> DataFrame:
    """ops (outbox_id, seq, op) -> outbox_id, status, n_invalid; every item starts as Drafted."""
    lists = ops.groupBy("outbox_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("es"))
    zero = F.struct(F.lit("Drafted").alias("status"), F.lit(0).alias("n_invalid"))

    def step(s: Column, e: Column) -> Column:
        to = F.lit(None).cast("string")
        for op, (states, new) in OUTBOX.items():
            to = F.when((e["op"] == op) & s["status"].isin(*states), new).otherwise(to)
        return F.struct(F.coalesce(to, s["status"]).alias("status"), (s["n_invalid"] + F.when(to.isNull(), 1).otherwise(0)).alias("n_invalid"))

    return lists.select("outbox_id", F.aggregate("es", zero, step).alias("s")).select("outbox_id", "s.*")


def lease_states(leases: DataFrame, revocations: DataFrame, now: int) -> DataFrame:
    """Each lease with its state at `now`: revoked (the first revocation counts), expired or live."""
    first = revocations.groupBy("lease_id").agg(F.min("revoked_at").alias("revoked_at"))
    return leases.join(first, "lease_id", "left").withColumn("state", F.when(F.col("revoked_at") <= now, "revoked").when(F.col("expires_at") <= now, "expired").otherwise("live"))


def latest_registration(registrations: DataFrame) -> DataFrame:
    """The last registration of each server, with the trust level last approved for it."""
    last = registrations.groupBy("server_id").agg(F.max_by("command", "seq").alias("command"), F.max_by("trust_level", F.when(F.col("trust_level").isNotNull(), F.col("seq"))).alias("trust_level"))
    return last.withColumn("trust_level", F.coalesce("trust_level", F.lit("Untrusted")))
