"""Line dedup over a sharded minimal perfect hash (operator 1).

Every distinct line key of the corpus gets a slot of a minimal perfect hash; the
slots index two compact arrays, a 16-bit fingerprint and a saturating 16-bit count
of documents. The hash is sharded by key, so that a shard holds about
`SHARD_KEYS` keys whatever the corpus size, and documents probe the arrays of a
shard with packed hashes; the text of a line never enters a join.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z
lower-cased, hashed to 128 bits. A null or empty text is one empty line. Empty keys
are never dropped. Each row counts as one document, so repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .words import mix

SHARD_KEYS = 1 << 16
#: Probes that one task takes for one shard; more are dealt to copies of the shard.
TASK_PROBES = 1 << 21
#: Hot shards whose list is broadcast, 16 MB.
MOST_HOT = 1 << 20
GAMMA = 2
MAX_LEVELS = 40


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line of a whole text."""
    return [line.strip().lower() for line in (text or b"").split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two int64."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype=">i8").astype(np.int64).reshape(-1, 2)


class PerfectHash:
    """Levelled minimal perfect hash: a level keeps the keys that are alone on their bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(x.sum()) for x in levels]
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        odd = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix(hi * np.uint64(0xBF58476D1CE4E5B9) + lo * odd + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(hi):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys of a shard are not distinct")
            size = max(64, GAMMA * len(hi))
            at = cls._place(hi, lo, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(levels)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some of those that were not built in."""
        out, left = np.full(len(hi), -1, dtype=np.int64), np.arange(len(hi))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(hi[left], lo[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], dtype="<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(blob, "<u4", n, 4), 4 + 4 * n, []
        for size in map(int, sizes):
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at))[:size].astype(bool))
            at += width
        return cls(levels)


SHARD_SCHEMA = "shard int, n_keys int, mph binary, prints binary, counts binary"


def _build_shard(group: pa.Table) -> pa.Table:
    """One shard: the perfect hash with its fingerprint and count arrays."""
    hi, lo = (group.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    n = group.column("n").to_numpy()
    index = PerfectHash.build(hi, lo)
    slots = index.slots(hi, lo)
    prints, counts = np.zeros(len(hi), "<u2"), np.zeros(len(hi), "<u2")
    prints[slots] = (lo & np.uint64(0xFFFF)).astype("<u2")
    counts[slots] = np.minimum(n, 0xFFFF).astype("<u2")
    return pa.table({
        "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "n_keys": pa.array([len(hi)], pa.int32()),
        "mph": pa.array([index.dump()], pa.binary()), "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
    })


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, hi, lo) for each distinct non-empty line key of each row."""
    for batch in batches:
        rows, parts = [], []
        for row, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), strict=True):
            keys = [k for k in dict.fromkeys(line_keys(text)) if k]
            if keys:
                parts.append(_hashes(keys))
                rows.append(np.full(len(keys), row, dtype=np.int64))
        if parts:
            pair = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["row", "hi", "lo"])


class LineIndex:
    """The sharded index of a corpus: build() once, probe() with any documents."""

    def __init__(self, shards: DataFrame, n_shards: int, copies: DataFrame):
        self.shards, self.n_shards, self.copies = shards, n_shards, copies

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        """docs: a column `text`. Any number of keys; a shard is a bounded group."""
        spark = docs.sparkSession
        ship(spark)
        keys = line_rows(docs).groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
        counts = written(keys, "line-counts")
        n_shards = max(1, -(-counts.count() // SHARD_KEYS))
        sharded = counts.withColumn("shard", F.pmod(F.col("hi"), F.lit(n_shards)).cast("int"))
        shards = written(sharded.groupBy("shard").applyInArrow(_build_shard, SHARD_SCHEMA), "line-shards")
        # a shard is listed only if it gets more than TASK_PROBES probes
        hot = sharded.groupBy("shard").agg(F.sum("n").alias("p")).filter(F.col("p") > TASK_PROBES)
        copies = written(hot.select("shard", F.ceil(F.col("p") / TASK_PROBES).cast("int").alias("copies")), "line-hot-shards")
        return cls(shards, n_shards, copies)

    def probe(self, keys: DataFrame, min_docs: int) -> DataFrame:
        """keys: (row, hi, lo). Those whose line is in min_docs documents at least."""
        if min_docs > 0xFFFF:
            raise ValueError("counts saturate at 65535")
        # two integers for each TASK_PROBES lines of the corpus at most; broadcast if they are few
        copies = F.broadcast(self.copies) if self.copies.count() <= MOST_HOT else self.copies
        dealt = lambda df: df.join(copies, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
        probes = dealt(keys.withColumn("shard", F.pmod(F.col("hi"), F.lit(self.n_shards)).cast("int"))).withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int"))
        shards = dealt(self.shards).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        probes = probes.drop("copies")

        def look_up(index: pa.Table, asked: pa.Table) -> pa.Table:
            asked = asked.select(["row", "hi", "lo"])
            if not index.num_rows or not asked.num_rows:
                return asked.slice(0, 0)
            hi, lo = (asked.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
            get = lambda name: index.column(name)[0].as_py()
            slots = PerfectHash.load(get("mph")).slots(hi, lo)
            prints, counts = np.frombuffer(get("prints"), "<u2"), np.frombuffer(get("counts"), "<u2")
            known = (slots >= 0) & (prints[slots] == (lo & np.uint64(0xFFFF)))
            return asked.filter(pa.array(known & (counts[slots] >= min_docs)))

        return shards.groupBy("shard", "copy").cogroup(probes.groupBy("shard", "copy")).applyInArrow(look_up, "row long, hi long, lo long")


def line_rows(docs: DataFrame) -> DataFrame:
    """(row, hi, lo) of docs; row is a hash of doc_id and text. Rows with equal hashes
    share their probes, which is harmless: a probe only says that a key is frequent."""
    named = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    return named.mapInArrow(_emit_keys, "row long, hi long, lo long")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, kept_text, n_lines, n_dropped.

    Lines whose non-empty key is in min_docs rows at least go everywhere; the others
    stay as they are, joined by newlines. One row out for each row in.
    """
    return _cut(docs.select("doc_id", "text"), ["doc_id"], min_docs).withColumnRenamed("c0", "doc_id")


def without_frequent_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs with texts, and n_chars where there is such a column, as drop_frequent_lines()
    leaves them; the columns and the number of rows stay."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = _cut(docs, others, min_docs)
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return kept.select(*(now.get(c, F.col(f"c{others.index(c)}") if c in others else None).alias(c) for c in docs.columns))


def _cut(docs: DataFrame, others: list[str], min_docs: int) -> DataFrame:
    """c0, c1, ... (the columns `others`), kept_text, n_lines, n_dropped."""
    ship(docs.sparkSession)
    base = docs.select("doc_id", "text")
    index = LineIndex.build(base)
    hits = index.probe(line_rows(base), min_docs)
    per_row = hits.groupBy("row").agg(F.collect_set(F.struct("hi", "lo")).alias("hits"))
    width = len(others)
    keyed = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)), F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("row")).join(per_row, "row", "left")
    flat = keyed.select(*(f"c{i}" for i in range(width)), "text", F.col("hits.hi").alias("hi"), F.col("hits.lo").alias("lo"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, hi, lo in zip(*(batch.column(width + i).to_pylist() for i in range(3)), strict=True):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if hi:
                    bad = set(zip(hi, lo, strict=True))
                    keys = [x.strip().lower() for x in lines]
                    lines = [x for x, k, h in zip(lines, keys, map(tuple, _hashes(keys).tolist()), strict=True) if not k or h not in bad]
                kept.append(b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], [f"c{i}" for i in range(width)] + ["kept_text", "n_lines", "n_dropped"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(others)] + ["kept_text string, n_lines long, n_dropped long"])
    return flat.mapInArrow(cut, schema)


def digest(kept: DataFrame) -> DataFrame:
    """The columns of query op1."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


