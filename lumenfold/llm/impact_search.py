"""Ranked lexical search over impact-ordered postings, score at a time (operator 13).

The index is a table of segments, each of some hundred thousand postings of consecutive
documents. In a segment the postings of a term are grouped by exact impact, that is
(10^9 tf) div (1000 tf + 12 m), highest first, and each document also has its own list of
terms and impacts. A segment is made in one task, by its input's order, without a shuffle.

A search takes the items in blocks of `BLOCK_TERMS` weighted terms. A task goes over its
segments; for each item it processes groups of all terms in descending order of their
contribution, weight times impact, in rounds that each halve the level, and adds them to
accumulators. It stops only when the sum of what each term may still contribute is below
the lowest of the best scores so far, which are lower bounds for as many documents: then no
document that isn't in the accumulators can come in. Of those that are, the ones that may
still reach that score get the rest of theirs from their own lists of terms. The best of
each task are ranked by a window at last.

Ranks are exact: equal scores go by ascending doc_id, null doc_ids last, equal doc_ids in
any order. Null and empty texts, and texts without a term, aren't counted and never found;
an item without a term finds nothing. Repeated rows of documents are documents of their
own. Items that share an item_id but differ in text are items of their own; exact repeats
of an item are one. Texts of any length are taken whole: a document isn't cut, so a
segment is as large as its longest document at least. An empty table gives no rows.
Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, scratch_path, settings, ship, written

#: What a term is made of: all but these.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings and documents of a segment, where no single document has more.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1 << 19, 1 << 15
#: Weighted terms of a block of items (some 10 MB in a worker), unless one item has more.
BLOCK_TERMS = 1 << 17
TOP = 20
SEGMENT = (
    "ids array<long>, terms array<string>, df array<int>, term_groups binary, impacts binary, group_ends binary, places binary, "
    "doc_ends binary, doc_terms binary, doc_impacts binary"
)
_TYPES = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())] + [pa.binary()] * 7
_NAMES = [part.split()[0] for part in SEGMENT.split(", ")]
#: Large rows: their sizes are looked at one by one, and dictionaries are of no use.
_WRITE = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(1 << 24), "parquet.enable.dictionary": "false", "compression": "zstd"}
#: Bytes to bytes: letters lower-cased, what is in no term to a blank.
_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def n_terms(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("long")


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all terms with repeats."""
    row = docs.select(n_terms(F.col("text")).alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return row[0], row[1] or 0


def _ints(a: np.ndarray) -> bytes:
    return a.astype("<i4").tobytes()


def _read(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4")


class _Builder:
    """Documents of a segment to be."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[int] = []
        self.tfs: list[int] = []
        self.sizes: list[int] = []
        self.ms: list[int] = []

    def add(self, doc_id: int | None, words: list[bytes], m: int) -> None:
        number = self.vocabulary
        counted = Counter(words)
        self.ids.append(doc_id)
        self.ms.append(m)
        self.sizes.append(len(counted))
        self.terms.extend([number.setdefault(t, len(number)) for t in counted])
        self.tfs.extend(counted.values())

    def row(self) -> tuple:
        sizes, term, tf = np.array(self.sizes), np.array(self.terms, dtype=np.int64), np.array(self.tfs, dtype=np.int64)
        place = np.repeat(np.arange(len(sizes)), sizes)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.array(self.ms, dtype=np.int64)[place])
        own = np.lexsort((term, place))
        order = np.lexsort((place, -impact, term))
        t, v = term[order], impact[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])]))
        ends = np.append(first[1:], len(t))
        groups = np.searchsorted(t[first], np.arange(len(self.vocabulary) + 1))
        packed = (groups, v[first], ends, place[order], np.cumsum(sizes), term[own], impact[own])
        return (self.ids, [w.decode() for w in self.vocabulary], np.bincount(term, minlength=len(self.vocabulary)), *map(_ints, packed))


def build(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """The index of docs (doc_id, text, ...), written at `path` or else to the scratch folder,
    and N."""
    spark = docs.sparkSession
    ship(spark)
    count, length = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(b: _Builder) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(b.row(), _TYPES, strict=True)], _NAMES)

        segment = _Builder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms_of(text.as_py() or b"")
                if not words:
                    continue
                segment.add(doc_id.as_py(), words, 100 - 25 + 25 * len(words) * count // length)
                if len(segment.terms) >= SEGMENT_POSTINGS or len(segment.ids) >= SEGMENT_DOCS:
                    yield full(segment)
                    segment = _Builder()
        if segment.ids:
            yield full(segment)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SEGMENT)
    path = path or scratch_path(spark, "segments")
    made.write.mode("overwrite").options(**_WRITE).parquet(path)
    return spark.read.schema(SEGMENT).parquet(path), count


def weighted_terms(items: DataFrame, segments: DataFrame, count: int) -> DataFrame:
    """(item_id, __text, term, weight): the items' terms that are in the index; a weight is
    that of the term times its occurrences in the item. __text tells items of one id apart."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))
    asked = items.select("item_id", F.xxhash64("text").alias("__text"), "text").distinct().select("item_id", "__text", F.explode(words).alias("term")).groupBy("item_id", "__text", "term").agg(F.count("*").alias("times"))
    held = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    held = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1)))
    return asked.join(held, "term").select("item_id", "__text", "term", (weight * F.col("times")).cast("long").alias("weight")).filter("weight > 0")


class _Best:
    """The best documents of an item so far, in order."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids, self.null = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        """What a document must reach; 1 while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def take(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.null, null)
        order = np.lexsort((i, n, -s))[: self.top]
        self.scores, self.ids, self.null = s[order], i[order], n[order]


class Segment:
    """One row of the index in a worker."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        ids, terms = batch.column(0)[i].values, batch.column(1)[i].values
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.number = {t: k for k, t in enumerate(terms.to_pylist())}
        read = lambda k: np.frombuffer(batch.column(k)[i].as_buffer(), "<i4")
        self.term_groups, self.impacts, self.group_ends, self.places, self.doc_ends, self.doc_terms, self.doc_impacts = map(read, range(3, 10))

    def search(self, terms: list[str], weights: list[int], best: _Best) -> int:
        """Brings what the segment has into the best of an item; returns the postings processed."""
        known = sorted((self.number[t], w) for t, w in zip(terms, weights, strict=True) if t in self.number)
        if not known:
            return 0
        number, weight = (np.array(x, dtype=np.int64) for x in zip(*known, strict=True))
        at, end = self.term_groups[number].astype(np.int64), self.term_groups[number + 1].astype(np.int64)
        total, least, processed = np.zeros(len(self.ids), np.int64), best.least(), 0
        while True:
            ahead = np.where(at < end, weight * self.impacts[np.minimum(at, len(self.impacts) - 1)], 0)
            rest = int(ahead.sum())  # no document can get more than this from here on
            if rest == 0 or rest < least:
                break
            level = int(ahead.max()) // 2 + 1
            for k in np.flatnonzero(ahead >= level):
                lowest = -(-level // int(weight[k]))
                stop = at[k] + int(np.searchsorted(-self.impacts[at[k] : end[k]], -lowest, "right"))
                low, high = self.group_ends[at[k] - 1] if at[k] else 0, self.group_ends[stop - 1]
                sizes = np.diff(self.group_ends[at[k] : stop], prepend=low)
                total[self.places[low:high]] += weight[k] * np.repeat(self.impacts[at[k] : stop], sizes)  # a document is in one group of a term
                at[k], processed = stop, processed + int(high - low)
            if len(total) >= best.top:
                least = max(least, int(np.partition(total, len(total) - best.top)[-best.top]))
        found = np.flatnonzero((total > 0) & (total + rest >= least))
        if rest:
            total[found] = [self.score(d, number, weight) for d in found]
        found = found[(total[found] > 0) & (total[found] >= least)]
        best.take(total[found], self.ids[found], self.null[found])
        return processed

    def score(self, doc: int, number: np.ndarray, weight: np.ndarray) -> int:
        """A document's whole score, from its own terms; `number` ascends."""
        low, high = self.doc_ends[doc - 1] if doc else 0, self.doc_ends[doc]
        own = self.doc_terms[low:high]
        place = np.minimum(np.searchsorted(own, number), len(own) - 1)
        return int((weight * self.doc_impacts[low:high][place])[own[place] == number].sum())


def _search_block(segments: DataFrame, items: list, item_type: str, top: int) -> DataFrame:
    """The best of each task for the items of one block."""
    sent = segments.sparkSession.sparkContext.broadcast(items)  # bounded: BLOCK_TERMS
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_type)
    if kind is None:
        raise TypeError(f"item_id of type {item_type}; long, int and string are supported")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = [_Best(top) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch, i)
                for (_, _, terms, weights), b in zip(asked, best, strict=True):
                    segment.search(terms, weights, b)
        for begin in range(0, len(asked), 500):
            part = list(zip(asked, best, strict=True))[begin : begin + 500]
            ids = pa.array([item[0] for item, b in part for _ in b.ids], kind)
            texts = pa.array([item[1] for item, b in part for _ in b.ids], pa.int64())
            docs = pa.array(np.concatenate([b.ids for _, b in part]), pa.int64(), mask=np.concatenate([b.null for _, b in part]))
            scores = pa.array(np.concatenate([b.scores for _, b in part]), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, texts, docs, scores], ["item_id", "__text", "doc_id", "score"])

    return segments.mapInArrow(run, f"item_id {item_type}, __text long, doc_id long, score long")


def search(segments: DataFrame, count: int, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index and N, items (item_id, text, ...) -> item_id, rank, doc_id, score."""
    spark = segments.sparkSession
    ship(spark)
    weighted = written(weighted_terms(items, segments, count), "weights")
    blocks = max(1, -(-weighted.count() // BLOCK_TERMS))
    item_type, found = dict(items.dtypes)["item_id"], []
    for b in range(blocks):
        own = weighted.filter(F.pmod(F.xxhash64("item_id", "__text"), F.lit(blocks)) == b)
        rows = own.groupBy("item_id", "__text").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("ts")).collect()  # one block
        asked = [(r.item_id, r["__text"], [t.term for t in r.ts], [t.weight for t in r.ts]) for r in rows]
        with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 25)}):
            found.append(written(_search_block(segments, asked, item_type, top), "best"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id", "__text").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """search() over an index of docs that is made for it."""
    segments, count = build(docs)
    return search(segments, count, items, top)
