"""Near copies by Jaccard similarity of word shingles (beside operator 3; not a stage of the pipeline).

Two texts are linked when their sets of shingles of `width` words (A-Z lower-cased, cut at
blanks; a shorter text is one shingle) have a Jaccard similarity of `similarity` or more.
MinHash bands only find which texts may be linked: 36 bands of 6 values miss a pair of
similarity 0.8 with probability 2e-5, and more similar ones less often. Texts joined by
shared bands, directly or over others, form a cluster; within clusters every pair that
isn't connected yet is compared on the sets themselves, so all links are exact.

Texts with equal sets are handled once, by a 64-bit hash of the set. Null and empty texts
have the empty set. Clusters share tasks; one beyond `TILE` sets is dealt in pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, written
from .components import components

SEED = 42
BANDS, ROWS = 36, 6
TILE = 1 << 11
GROUP_ROWS = 1 << 10
STEP = 1 << 12
_RNG = np.random.default_rng(SEED)
_MULTIPLY, _ADD = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(b) for b in (1, 0))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - width + 1)
    return np.unique(np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts[:n], ends[min(width, len(words)) - 1 :], strict=True)], dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, (hashes[at : at + STEP] * _MULTIPLY + _ADD).min(axis=1))
    raw, size = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[t * size : (t + 1) * size], t) for t in range(BANDS)], np.uint64).view(np.int64)


def link(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs that connect exactly those sets which a chain of similar pairs connects.

    Two similar sets share one of the rarest elements of each (as many as a similar set
    may lack, and one), so only sets that share one of those are compared.
    """
    n, size = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    if not size.sum():
        return []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(ids.max() + 1, np.int64)
    rank[np.argsort(np.bincount(ids), kind="stable")] = np.arange(len(rank))
    elements = [np.sort(x) for x in np.split(rank[ids], np.cumsum(size)[:-1])]
    rare = [x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1] for x in elements]
    owner = np.repeat(np.arange(n), [len(x) for x in rare])
    order = np.argsort(np.concatenate(rare), kind="stable")
    of, start = owner[order], np.searchsorted(np.concatenate(rare)[order], np.arange(len(rank) + 1))
    free, mark, out = size > 0, np.zeros(len(rank), bool), []
    for first in range(n):
        if not free[first]:
            continue
        free[first], todo = False, [first]
        while todo:
            i = todo.pop()
            others = np.unique(np.concatenate([of[start[x] : start[x + 1]] for x in rare[i].tolist()]))
            others = others[free[others]]
            others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9]
            mark[elements[i]] = True
            for j in others.tolist():
                shared = int(np.count_nonzero(mark[elements[j]]))
                if shared >= similarity * (size[i] + size[j] - shared) - 1e-9:
                    out.append((i, j))
                    free[j] = False
                    todo.append(j)
            mark[elements[i]] = False
    return out


def keyed_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs (id, row, text) -> id, row, sid (hash of the set), bands; row for row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(2)]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sid), bands], ["id", "row", "sid", "bands"])

    return docs.select("id", "row", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, row long, sid long, bands array<long>")


def links(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """texts (sid, cluster, text) -> u, v: sids of similar texts of a cluster."""
    ship(texts.sparkSession)
    sizes = written(texts.groupBy("cluster").agg(F.count("*").alias("n")), "cluster-sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.filter(F.col("n") > TILE).select("cluster", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    chunks, chunk = F.coalesce("chunks", F.lit(1)), F.col("chunk")
    dealt = texts.join(large, "cluster", "left").withColumn("chunk", F.pmod(F.xxhash64("sid"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    # each pair of chunks is a tile of its own; whole small clusters share a tile
    shards = max(1, -(-n // GROUP_ROWS))
    small = F.struct(F.pmod(F.xxhash64("cluster"), F.lit(shards)).alias("a"), F.lit(-1).alias("b"), F.lit(0).cast("long").alias("c"))
    pair = F.struct(F.least(chunk, "other").cast("long").alias("a"), F.greatest(chunk, "other").alias("b"), F.col("cluster").alias("c"))
    dealt = dealt.withColumn("tile", F.when(F.col("chunks").isNull(), small).otherwise(pair))

    def run(group: pa.Table) -> pa.Table:
        sid = group.column("sid").to_numpy()
        found = np.array(link([shingles(t.as_py(), width) for t in group.column("text")], similarity), np.int64).reshape(-1, 2)
        return pa.table({"u": sid[found[:, 0]], "v": sid[found[:, 1]]})

    return dealt.select("tile", "sid", "text").groupBy("tile").applyInArrow(run, "u long, v long")


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with the row of the smallest doc_id of each component of similar texts only. Of
    rows with that doc_id the one with the least hash stays; rows with a null doc_id stay
    only in components that have nothing else. The columns stay as they are."""
    row = free_name(docs, "__row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    rows = keyed_sets(keyed.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(row).alias("row"), "text"), width)
    sets = written(rows.groupBy("sid").agg(F.min(F.struct("id", "row")).alias("least"), F.first("bands").alias("bands")), "shingle-sets")
    banded = sets.select("sid", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("sid").alias("head"), F.count("*").alias("n")).filter("n > 1").select("band", "head")
    clusters = components(banded.join(heads, "band").select(F.col("sid").alias("u"), F.col("head").alias("v")))
    placed = written(sets.join(clusters.withColumnRenamed("node", "sid"), "sid").select("sid", F.col("least.row").alias(row), F.col("component").alias("cluster")), "clusters")
    # rows that are equal in doc_id and text share a row key; one of them is enough
    texts = written(keyed.select(row, F.col("text").cast("binary").alias("text")).join(placed, row).dropDuplicates(["sid"]).select("sid", "cluster", "text"), "clustered-texts")
    similar = components(links(texts, width, similarity))
    least = sets.join(similar.withColumnRenamed("node", "sid"), "sid", "left").groupBy(F.coalesce("component", "sid").alias("component")).agg(F.min("least").alias("least"))
    return keyed.join(least.select(F.col("least.row").alias(row)).distinct(), row, "left_semi").dropDuplicates([row]).select(*docs.columns)
