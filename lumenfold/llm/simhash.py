"""SimHash near-dedup with a Gray-order hierarchical index (operator 3).

Fingerprints of 64 bits are made from word shingles. Distinct fingerprints are sorted
by Gray rank, so that neighbours differ in few bits; nodes over runs of that order keep
the bits that all their leaves share (a masked pattern). Two nodes whose shared bits
already differ too often are pruned as whole groups, two nodes that can't differ too
often are linked as whole groups, and only the rest is opened down to the leaves.

Distribution: by the pigeonhole principle two fingerprints within d bits agree in at
least k - d of k blocks, so each fingerprint is dealt once for every choice of k - d
blocks, by their bits. k grows with the number of fingerprints, which keeps groups
small; a group beyond `TILE` is dealt in pairs of chunks. All choices find the same links.

Empty texts have fingerprint zero and link like any other. Null texts count as empty.
Equal fingerprints are handled once. Rows with a null doc_id get the component of their
fingerprint; component_id is the least doc_id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ship, written
from .components import components

SEED = 42
TILE = 1 << 15
GROUP_ROWS = 1 << 15
PAIRS = 1 << 21
STEP_BITS = 9


def fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:stop], ends[at + width - 1 : stop + width - 1], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fp (the 64 bits as a signed long); row for row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    base = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def gray_rank(g: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        g = g ^ (g >> np.uint64(shift))
    return g


def blocks(k: int) -> list[int]:
    """Masks of k blocks that make up 64 bits."""
    cuts = [round(i * 64 / k) for i in range(k + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def n_blocks(n: int, distance: int) -> int:
    """Blocks for n fingerprints: as few as keep the mean group under about a thousand."""
    k = distance + 1
    while (64 * (k - distance)) // k < 40 and n >> ((64 * (k - distance)) // k) > 1000:
        k += 1
    return k


def _bring_up(fp: np.ndarray, mask: int) -> tuple[np.ndarray, int]:
    """Move the bits of the mask to the top, in runs; the number of those bits."""
    out, top = np.zeros_like(fp), 64
    for wanted in (1, 0):
        bit = 63
        while bit >= 0:
            if (mask >> bit & 1) == wanted:
                low = bit
                while low > 0 and (mask >> (low - 1) & 1) == wanted:
                    low -= 1
                size = bit - low + 1
                top -= size
                out |= ((fp >> np.uint64(low)) & np.uint64((1 << size) - 1)) << np.uint64(top)
                bit = low - 1
            else:
                bit -= 1
    return out, mask.bit_count()


class GrayIndex:
    """Links within a set of distinct fingerprints that agree in the bits of a mask."""

    def __init__(self, fp: np.ndarray, mask: int, distance: int):
        moved, exact = _bring_up(fp, mask)
        order = np.argsort(gray_rank(moved), kind="stable")
        self.leaf, self.order, self.distance = moved[order], order, distance
        self.label = np.arange(len(fp))
        n, self.levels = len(fp), []
        for bits in [*range(exact, 64, STEP_BITS), 64]:
            head = self.leaf >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
            start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if n else np.zeros(0, np.int64)
            every, some = np.bitwise_and.reduceat(self.leaf, start), np.bitwise_or.reduceat(self.leaf, start)
            self.levels.append((start, np.append(start[1:], n), every, every ^ some))

    def _join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Union of leaf pairs in self.label (each leaf's least linked leaf)."""
        label = self.label
        while True:
            a, b = label[u], label[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != (up := label[label])).any():
                label[:] = up

    def _whole(self, level: int, nodes: np.ndarray) -> None:
        """Link all leaves of each node."""
        start, stop = self.levels[level][:2]
        size = stop[nodes] - start[nodes]
        head = np.repeat(start[nodes], size)
        self._join(head, head + _within(size))

    def search(self) -> np.ndarray:
        """For each fingerprint given, the position of one linked to it; its own if none."""
        n = len(self.leaf)
        if n > 1:
            near = np.flatnonzero(np.bitwise_count(self.leaf[1:] ^ self.leaf[:-1]) <= self.distance)
            exact = self.levels[0][0]
            near = near[~np.isin(near + 1, exact)]
            self._join(near, near + 1)
            roots = np.flatnonzero(self.levels[0][1] - exact > 1)
            self._open(0, roots, roots)
        out = np.empty(n, dtype=np.int64)
        out[self.order] = self.order[self.label]
        return out

    def _open(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Compare the children of node pairs; prune, link, or go down."""
        start, stop = self.levels[level][:2]
        child, child_stop, every, spread = self.levels[level + 1]
        low, high = np.searchsorted(child, start), np.searchsorted(child, stop)
        at = 0
        while at < len(a):
            # pairs of nodes whose leaves are all linked already need no look
            least, most = np.minimum.reduceat(self.label, start), np.maximum.reduceat(self.label, start)
            width = (high - low)[a[at:]] * (high - low)[b[at:]]
            stop_at = at + max(1, int(np.searchsorted(np.cumsum(width), PAIRS)))
            x, y = a[at:stop_at], b[at:stop_at]
            at = stop_at
            open_ = (np.maximum(most[x], most[y]) != np.minimum(least[x], least[y]))
            x, y = x[open_], y[open_]
            for p, q in self._children(low, high, x, y):
                p, q = p[keep := p <= q], q[keep]
                mask = ~(spread[p] | spread[q])
                under = np.bitwise_count((every[p] ^ every[q]) & mask)
                fits = under <= self.distance
                p, q, under, mask = p[fits], q[fits], under[fits], mask[fits]
                sure = under + np.bitwise_count(~mask) <= self.distance
                s, t = p[sure], q[sure]
                self._join(child[s], child[t])
                wide = np.unique(np.concatenate([s, t]))
                self._whole(level + 1, wide[child_stop[wide] - child[wide] > 1])
                p, q = p[~sure], q[~sure]
                if len(p) and level + 2 < len(self.levels):
                    self._open(level + 1, p, q)

    @staticmethod
    def _children(low, high, x, y) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of children of each pair of nodes, about PAIRS at a time."""
        wide = (high - low)[x] * (high - low)[y] > 2 * PAIRS
        for i, j in zip(x[wide].tolist(), y[wide].tolist(), strict=True):
            right = np.arange(low[j], high[j])
            rows = max(1, PAIRS // len(right))
            for k in range(int(low[i]), int(high[i]), rows):
                left = np.arange(k, min(k + rows, int(high[i])))
                yield np.repeat(left, len(right)), np.tile(right, len(left))
        x, y = x[~wide], y[~wide]
        if len(x):
            right = (high - low)[y]
            size = (high - low)[x] * right
            inner = _within(size)
            per = np.repeat(right, size)
            yield np.repeat(low[x], size) + inner // per, np.repeat(low[y], size) + inner % per


def _within(size: np.ndarray) -> np.ndarray:
    """0..s-1 for each s, one after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """distinct (fp long, each once) -> u, v: links that connect exactly those
    fingerprints that a chain of pairs within `distance` bits connects."""
    ship(distinct.sparkSession)
    n = distinct.count()
    k = n_blocks(n, distance)
    masks = [sum(c) for c in combinations(blocks(k), k - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    large = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    chunks, chunk = F.coalesce("chunks", F.lit(1)), F.col("chunk")
    tiled = dealt.join(large, ["t", "key"], "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    # each pair of chunks is a tile of its own; whole small groups share a tile
    shards = max(1, -(-n // GROUP_ROWS))
    tiled = tiled.withColumn("tile", F.when(F.col("chunks").isNull(), F.struct(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("a"), F.lit(-1).alias("b"), F.lit(0).cast("long").alias("c"))).otherwise(F.struct(F.least(chunk, "other").cast("long").alias("a"), F.greatest(chunk, "other").alias("b"), F.col("key").alias("c"))))

    def run(group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy().view(np.uint64))
        found = GrayIndex(fp, masks[group.column("t")[0].as_py()], distance).search()
        linked = found != np.arange(len(fp))
        return pa.table({"u": fp[linked].view(np.int64), "v": fp[found[linked]].view(np.int64)})

    return tiled.select("t", "tile", "fp").groupBy("t", "tile").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fp, component_id; row for row."""
    fps = written(fingerprints(docs, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    parts = components(links(distinct.select("fp"), distance))
    placed = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(ids, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """docs with the row of the smallest doc_id of each component only. Of rows with that
    doc_id the one with the least hash stays; rows with a null doc_id stay only in
    components that have nothing else. The columns stay as they are."""
    row = free_name(docs, "__row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    # ids of rows stand in for doc_id, so that only small columns go through the stages
    found = near_duplicates(keyed.select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(row).alias("row")).alias("doc_id"), "text"), width, distance)
    first = found.filter("doc_id = component_id").select(F.col("doc_id.row").alias(row)).distinct()
    return keyed.join(first, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
