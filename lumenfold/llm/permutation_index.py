"""Approximate nearest neighbours by a permutation index (operator 8).

A vector is represented by its `NEAREST` nearest pivots in order. Vectors lie in cells, by
their nearest pivot; cells that are neighbours share a shard of about `SHARD_ROWS` vectors,
and a cell with more is cut into shards of its own. A shard posts its vectors in inverted
files, one for each pivot, with the pivot's place in the vector's order. A query meets the
shards of its nearest cells only, reads the files of its own pivots there, and sums the
footrule distance of places (a pivot that the vector lacks counts as one past the end).
The nearest by footrule are reranked by the exact inner product: `RERANK` * sqrt(n) of them
over all shards of a layer together.

Neighbours are those of largest inner product, so long vectors are neighbours of many. Vectors
are therefore layered by length: a layer holds those from its greatest length down to 1 /
`RATIO` of it, the last of `LAYERS` all that are shorter. Each layer is an index of its own.
In it vectors are divided by its greatest length and get one more component that makes them
unit vectors (a query's is 0), so that the nearest direction is the largest inner product.
Vectors of one length are one layer, and the component is 0.

With n vectors in a layer there are `PIVOTS` * sqrt(n) pivots, so that the files a query reads hold
some sqrt(n) postings in all, and a query meets the cells of the nearest `CELLS` *
pivots ** 0.7 pivots. Both numbers, and the reranked rows, grow slower than n. On data
without any structure (directions spread evenly) less would lose neighbours; the README
gives the recall measured at several sizes.

Pivots are distinct vectors of least hash, a bounded sample (`OFFERED` * `MOST_PIVOTS`), of
which those in one crowd come last; every vector is indexed. A shard meets queries in blocks of about `QUERY_ROWS`, so that a task's memory
doesn't grow with the data.

Vectors that are null, all zero, or hold null or non-finite components take no part, and
nor do vectors of another length than the most common one (the smaller of equals). Rows
with the same vec_id are separate candidates of other queries; queries with the same
vec_id and different vectors are answered each. Ties in score go to the smaller vec_id.
With no vectors or no queries the result is empty. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written

PIVOTS, NEAREST, CELLS, RERANK = 4, 64, 6, 14
FEWEST_PIVOTS, MOST_PIVOTS = 64, 1 << 14
#: Vectors offered for each pivot, and the cosine that pivots may have with each other.
OFFERED, APART = 4, 0.6
SHARD_ROWS, QUERY_ROWS = 1 << 14, 1 << 16
#: Lengths in a layer differ by this factor at most, but for the last of the layers.
RATIO, LAYERS = 2**0.5, 16


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def length(v: Column) -> Column:
    """Euclidean length; components are divided by the largest, so that squares stay finite."""
    def of(big: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x / big) * (x / big))
        return F.least(big * F.sqrt(squares), F.lit(1e308))

    # as a lambda's argument the largest component is looked for once a row, not for each component
    return F.get(F.transform(F.array(F.array_max(F.transform(v, F.abs))), of), F.lit(0))


def as_units(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors of a layer divided by its greatest length, with the component that makes them unit
    vectors: their inner products with a query keep their order."""
    v = vectors / top
    return np.column_stack([v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))])


def as_queries(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack([vectors / np.abs(vectors).max(axis=1, keepdims=True), np.zeros(len(vectors))])


@dataclass
class Layer:
    """An index of vectors of similar length: their number and greatest length, the pivots, the
    places that are kept, the cells that a query meets, and where its shards begin."""

    n: int
    top: float
    pivots: np.ndarray
    k: int
    n_cells: int
    first: np.ndarray | None = None
    parts: np.ndarray | None = None
    shards: int = 0


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k pivots of largest inner product with each vector, in order."""
    near = -(vectors @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :k].astype(np.int16)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = pa.chunked_array(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class InvertedFiles:
    """The postings of one shard: for each pivot, who has it and at which place."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.n, self.k = order.shape
        flat = order.ravel().astype(np.int64)
        at = np.argsort(flat, kind="stable")
        self.who, self.place = (at // self.k).astype(np.int32), (at % self.k).astype(np.float32)
        self.first = np.searchsorted(flat[at], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of each vector of the shard from a query's order."""
        # k - |i - j| is what a shared pivot saves against one that is missing
        who = [self.who[self.first[p] : self.first[p + 1]] for p in order]
        save = [self.k - np.abs(self.place[self.first[p] : self.first[p + 1]] - i) for i, p in enumerate(order)]
        total = np.bincount(np.concatenate(who), weights=np.concatenate(save), minlength=self.n)
        return (len(order) * self.k - total).astype(np.int16)


def search_shard(ids: np.ndarray, vectors: np.ndarray, files: InvertedFiles, query: int, v: np.ndarray, own: np.ndarray, top: int, n_keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shard, which is sorted by id, and scores of what is nearest to a query (id,
    vector, order)."""
    near = np.argsort(files.footrule(own), kind="stable")[:n_keep]  # of equals, smaller ids first
    near = near[ids[near] != query]
    # row by row in one order of sums, so that equal vectors have equal scores wherever they stand
    score = (vectors[near] * v).sum(axis=1)
    best = np.lexsort((ids[near], -score))[:top]
    return near[best], score[best]


def n_pivots(n: int) -> int:
    return min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(PIVOTS * n**0.5)))


def spread(sample: np.ndarray, wanted: int) -> np.ndarray:
    """`wanted` vectors of the sample: in their order those that have a cosine of `APART` at
    most with all before them, then the others. Pivots in one crowd would order all vectors
    outside of it alike."""
    unit = sample / np.abs(sample).max(axis=1, keepdims=True)  # so that no square is lost
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    taken, rest, held = [], [], np.empty((wanted, sample.shape[1]))
    for i, v in enumerate(unit):
        if len(taken) == wanted:
            break
        if (held[: len(taken)] @ v > APART).any():
            rest.append(i)
        else:
            held[len(taken)] = v
            taken.append(i)
    return sample[[*taken, *rest][:wanted]]


def pivots_of(data: DataFrame, n: int, top: float) -> np.ndarray:
    """Distinct vectors of the sample, spread, as unit vectors, and neighbours next to each
    other: by the nearest of the first sqrt of them, and by closeness to it."""
    wanted = n_pivots(n)
    # bounded by OFFERED * MOST_PIVOTS
    rows = data.groupBy("v").agg(F.xxhash64("v").alias("h")).orderBy("h", "v").limit(OFFERED * wanted).collect()
    found = as_units(spread(np.array([r.v for r in rows], dtype=np.float64), min(wanted, len(rows))), top)
    close = found @ found[: max(1, int(len(found) ** 0.5))].T
    return found[np.lexsort((-close.max(axis=1), close.argmax(axis=1)))]


def layers_of(data: DataFrame, longest: float) -> dict[int, Layer]:
    """The layers that hold vectors (data: layer, v, ...), with their pivots."""
    out = {}
    for row in sorted(data.groupBy("layer").count().collect()):  # LAYERS rows at most
        top = longest / RATIO**row.layer
        pivots = pivots_of(data.filter(F.col("layer") == row.layer), row["count"], top)
        k = min(NEAREST, len(pivots))
        out[row.layer] = Layer(row["count"], top, pivots, k, max(k, min(len(pivots), int(np.ceil(CELLS * len(pivots) ** 0.7)))))
    return out


def shards_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the rows of each cell: its first shard, how many it is cut into, and the number of
    shards. Small cells in a row share one."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    shard = held = 0
    for cell, size in enumerate(sizes.tolist()):
        if held and held + size > SHARD_ROWS:
            shard, held = shard + 1, 0
        first[cell], parts[cell] = shard, max(1, -(-size // SHARD_ROWS))
        shard, held = shard + parts[cell] - 1, held + size if parts[cell] == 1 else SHARD_ROWS
    return first, parts, int(shard) + 1


def kept_rows(n: int, top: int, met: int) -> int:
    """Rows that each of the shards met reranks; where chance gives one of them more of the
    nearest than its share, three deviations are allowed for."""
    share = RERANK * n**0.5 / max(1, met)
    return max(2 * top, int(np.ceil(share + 3 * share**0.5)))


def first_copies(data: DataFrame, top: int) -> DataFrame:
    """Of rows with the same vector, those that can be among anyone's `top`: as ties go to the
    smaller vec_id, the first top + 1 of them (one may be the query itself). Repeated rows are
    one row with a count. So no vector, however often it occurs, fills a cell."""
    once = data.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(top)).cast("int").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return once.withColumn("nth", nth).filter(F.col("nth") <= top + 1).drop("nth")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """vectors, queries (vec_id long, embedding array<float or double>) ->
    query_id, rank, vec_id, score: the `top` nearest found, best first."""
    spark = vectors.sparkSession
    ship(spark)
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null").filter(usable(F.col("v")))
    data, asked = take(vectors), take(queries)
    sizes = data.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    dim = sizes.dim
    data, asked = data.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    data = first_copies(data, top).withColumn("length", length(F.col("v")))
    data = written(data, "vectors")
    longest = data.agg(F.max("length").alias("most")).first().most
    step = F.floor((F.lit(float(np.log(longest))) - F.log("length")) / float(np.log(RATIO)) + 1e-9)
    data = data.withColumn("layer", F.greatest(F.lit(0), F.least(F.lit(LAYERS - 1), step)).cast("int"))
    layers = layers_of(data, longest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, layer in layers.items():
                some = batch.filter(pc.equal(batch.column(3), name))
                if some.num_rows:
                    order = nearest_pivots(as_units(_matrix(some.column(1), dim), layer.top), layer.pivots, layer.k)
                    listed = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), layer.k).cast(pa.list_(pa.int16()))
                    yield pa.RecordBatch.from_arrays([*some.columns, listed], ["vec_id", "v", "copies", "layer", "places"])

    index = written(data.select("vec_id", "v", "copies", "layer").mapInArrow(place, "vec_id long, v array<double>, copies int, layer int, places array<short>"), "permutations")
    sizes = {name: np.zeros(len(layer.pivots), np.int64) for name, layer in layers.items()}
    for name, cell, size in index.groupBy("layer", F.col("places")[0]).count().collect():  # a number for each pivot
        sizes[name][cell] = size
    placed, before = [], 0
    for name, layer in layers.items():
        first, layer.parts, layer.shards = shards_of(sizes[name])
        layer.first, before = before + first, before + layer.shards
        placed += [(name, cell, at) for cell, at in enumerate(zip(layer.first.tolist(), layer.parts.tolist(), strict=True))]
    cells = spark.createDataFrame(placed, "layer int, cell short, at struct<first:int,parts:int>")
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.col("at.parts")).cast("int")
    index = index.withColumn("cell", F.col("places")[0]).join(F.broadcast(cells), ["layer", "cell"])  # bounded by LAYERS * MOST_PIVOTS
    index = index.select("vec_id", "v", "copies", "layer", "places", (F.col("at.first") + spread).alias("shard"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = as_queries(_matrix(batch.column(1), dim))
            for layer in layers.values():
                start = int(layer.first[0])
                for i, near in enumerate(nearest_pivots(v, layer.pivots, layer.n_cells)):
                    met = np.zeros(layer.shards + 1, np.int64)  # a cell's shards are a range
                    np.add.at(met, layer.first[near] - start, 1)
                    np.add.at(met, layer.first[near] - start + layer.parts[near], -1)
                    shard = start + np.flatnonzero(np.cumsum(met[:-1]) > 0)
                    for at in range(0, len(shard), 1 << 10):
                        some = shard[at : at + (1 << 10)]
                        row = batch.slice(i, 1).select([0, 1]).to_pydict()
                        places = near[: layer.k].tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(row["vec_id"] * len(some), pa.int64()), pa.array(row["v"] * len(some), pa.list_(pa.float64())), pa.array([places] * len(some), pa.list_(pa.int16())),
                                pa.array(some.astype(np.int32)), pa.array(np.full(len(some), len(shard), np.int32)),
                            ],
                            ["vec_id", "v", "places", "shard", "met"],
                        )

    routed = asked.dropDuplicates(["vec_id", "v"]).mapInArrow(route, "vec_id long, v array<double>, places array<short>, shard int, met int")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("query", F.xxhash64("v"))
    with_blocks = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = {c: [np.empty(0, t)] for c, t in (("query_id", np.int64), ("query", np.int64), ("vec_id", np.int64), ("score", np.float64))}
        if shard.num_rows and block.num_rows:
            shard = shard.sort_by("vec_id")
            ids, v, copies = shard.column("vec_id").to_numpy(), _matrix(shard.column("v"), dim), shard.column("copies").to_numpy()
            layer = layers[shard.column("layer")[0].as_py()]  # of one shard all are in one
            files = InvertedFiles(_matrix(shard.column("places"), layer.k), len(layer.pivots))
            own, places = _matrix(block.column("v"), dim), _matrix(block.column("places"), layer.k)
            names, met = block.column("query").to_numpy(), block.column("met").to_numpy()
            for i, query in enumerate(block.column("vec_id").to_pylist()):
                near, score = search_shard(ids, v, files, query, own[i], places[i], top, kept_rows(layer.n, top, int(met[i])))
                each = np.repeat(np.arange(len(near)), copies[near])[:top]
                for c, x in (("query_id", np.full(len(each), query)), ("query", np.full(len(each), names[i])), ("vec_id", ids[near][each]), ("score", score[each])):
                    out[c].append(x)
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    near = with_blocks.groupBy("shard", "block").cogroup(routed.groupBy("shard", "block")).applyInArrow(run, "query_id long, query long, vec_id long, score double")
    # the rank filter is applied before the exchange as well as after it
    by = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by).cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
