"""Benchmark decontamination by size-partitioned MinHash containment search (operator 10).

Texts become sets of five-word shingles (A-Z lower-cased, words between blanks). An item
is in a document if at least `THRESHOLD` of the item's shingles are. Items are short and
documents long, so both sides are partitioned by size:

* A document of up to u shingles (u a power of two) has a signature of one permutation: the
  least hash of each of u * 2**level bins. How fine it is goes by the item's size: items of
  few shingles need fine signatures to be seen, `LEVELS` - 1 at most, long ones coarse ones.
* An item is signed in the same bins as the document that it meets. From its size follow how
  many bins agree at least where it is contained, but for a probability of `MISS`
  (see agreeing()), and its level: the coarsest at which `SHARE` of its shingles agree.
* Items under `SURE` shingles are too small for any signature; their shingles are looked up
  among all of a document, and as many must be there as containment asks for.

A hash that is least in some number of bins is so in any greater number, so each side says
of a hash from which number on it counts. Documents are hashed once, where they are read;
only hashes that pass a filter of a fixed size leave the scan.

Where a bins must agree, one of any n - a + 1 of the n does. An item is first met by its
rarest n - a + 1 hashes alone, so phrases that are common on both sides bring no pairs
together; then the agreeing bins of such a pair are counted; what has enough is verified by
exact shingle containment, on the words themselves. All of that are joins by document and
shingle, so no list grows with the items of a document.

An item of fewer than five words is one shingle of its own length; an item without words
is in no document. Null texts have no words, and an empty table on either side gives no
rows. Repeated items are each reported; a repeated row of documents gives its pairs again.
Other columns of documents and items aren't looked at. A text is hashed in pieces, and only
its shingles that items have are ever made into strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BitSet, bit_filter, filter_pages, flag, free_name, ship, written
from .words import BASE_WORD, Rolling, Words, mix, slices

SHINGLE, THRESHOLD = 5, 0.8
#: Items from this size on are found by signatures of documents, unless with this probability.
SURE, MISS = 7, 1e-6
#: Levels of signatures, bins a shingle of the smallest class, and what must agree of an item.
LEVELS, SMALLEST, SHARE = 4, 6, 0.4
#: The level of items that are looked up among all shingles, and a number of bins that no
#: signature has (both as powers of two).
ALL, NEVER = 100, 99


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every k-word shingle inside one text."""
    owner = words.owner()
    if len(words) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = owner[k - 1 :] == owner[: len(owner) - k + 1]
    return owner[: len(owner) - k + 1][inside], mix(Rolling(words.hash, BASE_WORD).grams(k)[inside] + np.uint64(k))


def shingle_set(text: bytes, k: int) -> set[bytes]:
    w = text.lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def size_class(n: int) -> int:
    """Class c holds texts of up to 2 ** (SMALLEST + c) shingles."""
    return max(0, (max(n, 1) - 1).bit_length() - SMALLEST)


def needed(n: int, threshold: float) -> int:
    """Shingles of n that a containing document has."""
    return max(1, math.ceil(threshold * n - 1e-9))


def agreeing(n: int, level: int, threshold: float) -> int:
    """Bins that agree at least, but for `MISS`, between an item of n shingles and a document
    that contains it.

    A shared shingle agrees if it is the least of its bin on both sides. A document that
    contains the item has as many shingles as are needed of it, so both sides together have at
    most u / threshold, and that many fall into u * 2**level bins.
    """
    load = 1 / threshold / 2**level
    seen, m = (1 - math.exp(-load)) / load, needed(n, threshold)
    below = 0.0
    for a in range(m + 1):
        below += math.exp(math.lgamma(m + 1) - math.lgamma(a + 1) - math.lgamma(m - a + 1) + a * math.log(seen) + (m - a) * math.log(1 - seen))
        if below >= MISS:
            return a
    return m


def partition(n: int, threshold: float) -> tuple[int, int]:
    """Level of an item of n shingles, and how many of its hashes must agree."""
    if n >= SURE:
        for level in range(LEVELS):
            agree = agreeing(n, level, threshold)
            if agree >= (SHARE * n if level < LEVELS - 1 else 1):
                return level, agree
    return ALL, needed(n, threshold)


def counts_from(hashes: np.ndarray, chosen: np.ndarray, bits: list[int]) -> np.ndarray:
    """For each chosen hash of a set the first of `bits` (ascending) at which it's the least of
    its bin, of 2**bits bins by its lowest bits; `NEVER` where it never is."""
    found = np.full(len(chosen), NEVER)
    for b in reversed(bits):
        low = np.uint64((1 << b) - 1)
        own = np.unique(chosen & low)
        at = np.searchsorted(own, hashes & low)
        inside = own[np.minimum(at, len(own) - 1)] == hashes & low
        least = np.full(len(own), np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, at[inside], hashes[inside])
        found[least[np.searchsorted(own, chosen & low)] == chosen] = b
    return found


def sign(hashes: np.ndarray, threshold: float) -> tuple[np.ndarray, int, int]:
    """Of an item's sorted distinct hashes: from how many bins (a power of two) on each counts,
    the item's level, and how many must agree."""
    level, agree = partition(len(hashes), threshold)
    if level == ALL:
        return np.zeros(len(hashes), np.int64), level, agree
    # classes of documents that could hold the item; from the last one on, all of it counts
    smallest = SMALLEST + level + size_class(needed(len(hashes), threshold))
    return counts_from(hashes, hashes, list(range(smallest, max(smallest, 40) + 1))), level, agree


def document_hits(hashes: np.ndarray, short: BitSet, long: BitSet) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a document's shingles: those that items may have and that count for some, from how
    many bins on they do (a power of two), and the document's class."""
    c, near, far = size_class(len(hashes)), short.has(hashes), long.has(hashes)
    chosen = np.unique(hashes[near | far])
    bits = counts_from(hashes, chosen, [SMALLEST + c + level for level in range(LEVELS)]) if far.any() else np.full(len(chosen), NEVER)
    kept = (bits < NEVER) | np.isin(chosen, hashes[near])
    return chosen[kept], bits[kept], c


POSTED = "item long, k int, h long, bits int, level int, agree int, n int"
HIT = "id long, h_text long, k int, h long, bits int, class int"


def _items(items: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("text is not null").withColumn("item", F.xxhash64("item_id", "text"))


def signatures(items: DataFrame, threshold: float) -> DataFrame:
    """Items posted by their hashes. Copies of an item are posted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in POSTED.split(", ")]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words([text.lower()])
                k = min(len(words), SHINGLE)
                if k:
                    h = np.unique(shingle_hashes(words, k)[1])
                    bits, level, agree = sign(h, threshold)
                    for got, x in zip(out, (item, k, h.view(np.int64), bits, level, agree, len(h)), strict=True):
                        got.append(np.broadcast_to(x, len(h)))
            if out[0]:
                names, types = zip(*(f.split() for f in POSTED.split(", ")), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64() if t == "long" else pa.int32()) for x, t in zip(out, types, strict=True)], names)

    return _items(items).select("item", "text").dropDuplicates(["item"]).mapInArrow(run, POSTED)


def hits(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """docs (id, h_text, text) -> the hashes of each document that may count for an item."""
    spark = docs.sparkSession
    lengths = [r.k for r in posted.select("k").distinct().orderBy("k").collect()]  # at most SHINGLE
    # bounded: a filter has FILTER_BITS bits at any number of items
    sent = spark.sparkContext.broadcast([filter_pages(bit_filter(posted.filter(c), F.col("h"))) for c in (f"level = {ALL}", f"level < {ALL}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = (BitSet(pages) for pages in sent.value)
        for batch in batches:
            ids, h_text, at = batch.column(0), batch.column(1), 0
            for held in slices((t.as_py() or b"",) for t in batch.column(2)):
                words, rows, found = Words([t.lower() for (t,) in held]), [], []
                for k in lengths:
                    owner, hashes = shingle_hashes(words, k)
                    first = np.searchsorted(owner, np.arange(len(held) + 1))
                    for i in np.unique(owner[short.has(hashes) | long.has(hashes)]).tolist():
                        h, bits, c = document_hits(hashes[first[i] : first[i + 1]], short, long)
                        rows.append(np.full(len(h), at + i))
                        found.append((np.full(len(h), k, np.int32), h.view(np.int64), bits.astype(np.int32), np.full(len(h), c, np.int32)))
                if rows:
                    row, columns = np.concatenate(rows), [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), h_text.take(pa.array(row)), *columns], ["id", "h_text", "k", "h", "bits", "class"])
                at += len(held)

    return docs.mapInArrow(run, HIT)


def candidates(found: DataFrame, posted: DataFrame) -> DataFrame:
    """hits() and signatures() -> id, h_text, item: pairs of which enough bins agree."""
    fits = F.greatest(F.col("d.bits"), F.col("p.bits")) <= F.col("d.class") + F.col("p.level") + SMALLEST
    same = [F.col(f"d.{c}") == F.col(f"p.{c}") for c in ("k", "h")]
    # the pairs that each hash would make; of those of an item the agree - 1 dearest are left out
    cost = found.groupBy("k", "h").agg(F.count("*").alias("in_docs")).join(posted.groupBy("k", "h").agg(F.count("*").alias("in_items")), ["k", "h"])
    dearest = Window.partitionBy("item").orderBy(F.desc(F.col("in_docs") * F.col("in_items")), "h")  # the hashes of one item
    rare = posted.join(cost, ["k", "h"]).withColumn("nth", F.row_number().over(dearest)).filter("nth >= agree")
    met = found.alias("d").join(rare.alias("p"), [*same, fits]).select("d.id", "d.h_text", "p.item").distinct()

    asked = met.join(posted, "item").alias("p")
    own = [F.col(f"d.{c}") == F.col(f"p.{c}") for c in ("id", "h_text")]
    # rows of equal id and text share a key; each hash of theirs counts once
    agreed = found.alias("d").join(asked, [*own, *same, fits]).groupBy("p.id", "p.h_text", "p.item").agg(F.countDistinct("p.h").alias("agreed"), F.max("p.agree").alias("agree"))
    return agreed.filter("agreed >= agree").select("id", "h_text", "item")


def _item_shingles(items: DataFrame) -> DataFrame:
    """item, n, k, s: the shingles of items (item, text), as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = min(len(text.split()), SHINGLE)
                own = sorted(shingle_set(text, k))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array([len(own)] * len(own), pa.int64()), pa.array([k] * len(own), pa.int32()), pa.array(own, pa.binary())], ["item", "n", "k", "s"])

    return items.mapInArrow(run, "item long, n long, k int, s binary")


def _document_shingles(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """docs (id, h_text, text) -> id, h_text, k, s: their shingles that items may have, as words."""
    lengths = [r.k for r in posted.select("k").distinct().orderBy("k").collect()]  # at most SHINGLE
    sent = docs.sparkSession.sparkContext.broadcast(filter_pages(bit_filter(posted, F.col("h"))))  # bounded: FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = BitSet(sent.value)
        for batch in batches:
            at = 0
            for held in slices((t.as_py() or b"",) for t in batch.column(2)):
                words = Words([t.lower() for (t,) in held])
                owner = words.owner()
                for k in lengths:
                    inside = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1]) if len(words) >= k else np.empty(0, np.int64)
                    first = inside[asked.has(shingle_hashes(words, k)[1])]
                    told = [b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[i : i + k], words.end[i : i + k], strict=True)) for i in first.tolist()]
                    row = pa.array(owner[first] + at, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array([k] * len(told), pa.int32()), pa.array(told, pa.binary())], ["id", "h_text", "k", "s"])
                at += len(held)

    return docs.mapInArrow(run, "id long, h_text long, k int, s binary")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...) ->
    doc_id, item_id, n_shared, n_shingles, containment: every item in every document."""
    ship(docs.sparkSession)
    text = F.col("text").cast("binary")
    base = docs.select(F.col("doc_id"), F.xxhash64("doc_id").alias("id"), F.xxhash64("text").alias("h_text"), text.alias("text"))
    asked = _items(items)
    posted = written(signatures(items, threshold), "item-signatures")
    found = written(hits(base.select("id", "h_text", "text"), posted), "benchmark-hits")
    pairs = written(candidates(found, posted), "benchmark-candidates")

    key, whole = F.xxhash64("id", "h_text"), ["id", "h_text", "k", "s"]
    flagged = lambda rows: flag(base, key, bit_filter(rows, key), "maybe").filter("maybe")
    wanted = pairs.join(_item_shingles(asked.select("item", "text").dropDuplicates(["item"])), "item")
    there = _document_shingles(flagged(pairs).select("id", "h_text", "text"), posted.join(pairs.select("item").distinct(), "item", "left_semi"))
    shared = wanted.join(there, whole, "left_semi").groupBy("id", "h_text", "item").agg(F.count("*").alias("n_shared"), F.max("n").alias("n_shingles"))
    enough = F.greatest(F.lit(1), F.ceil(threshold * F.col("n_shingles") - 1e-9))
    holds = written(shared.filter(F.col("n_shared") >= enough), "benchmark-found")
    rows = flagged(holds).select("doc_id", "id", "h_text").join(holds, ["id", "h_text"]).join(asked.select("item", "item_id"), "item")
    return rows.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that hold an item; the columns stay."""
    # rows are told apart by doc_id and text, so that a repeated doc_id goes only with its own text
    row = free_name(docs, "__row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    bad = contained_items(keyed.select(F.col(row).alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(bad, row, "left_anti").select(*docs.columns)
