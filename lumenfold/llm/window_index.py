"""Substring dedup over a log-structured fingerprint index (operator 7).

A window is `width` consecutive words of one document. Windows are indexed by groups:
the anchor of a window is its least word gram (by hash, leftmost of equals), windows that
follow each other and share their anchor form a group, and a group is named by two 64-bit
hashes, one of the anchor and one of all its words. Equal windows have equal anchors at
equal places, so nothing is lost, and there are about twenty times fewer groups than
windows.

The index is a folder: a manifest, and immutable runs that are cut into buckets by anchor
and sorted within them. A run names the first document of each group that was new then.
add() brings the groups of a new batch into the same buckets and merge-joins them with the
runs bucket by bucket; the runs themselves are neither shuffled nor sorted again. A group
that is known already is repeated as a whole. Where only the anchor is known, the windows
of the groups in question are hashed one by one from the texts, by a second hash of the
words' bytes that shares nothing with the first one, and compared with each other; so a
repeat needs 64 equal bits of the anchor and 64 independent ones of exactly its words.
Where there are more than `FAN_IN` runs, they are compacted into one and deleted.

An index is opened again by its path. Runs have names of their own, and a line of the
manifest is written only after its run: a batch that broke off leaves the index as it was.

Within a batch, earlier means a smaller doc_id; across batches, an earlier batch. Equal
doc_ids are not earlier than one another. doc_id is an integer; rows with a null one
neither remove nor are removed from. Null, empty and blank texts, and texts of fewer words
than a window, have no windows; an empty table gives an empty result. Repeated rows each
get their result. Columns other than doc_id and text aren't looked at. A long text is taken
in blocks of `BLOCK` windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, discard, flag, scratch_path, settings, ship, written
from .words import BASE_CHECK, BASE_WORD, Rolling, Words, mix, slices

WIDTH, GRAM, FAN_IN, BATCHES = 50, 14, 2, 3
BLOCK = 1 << 18
#: Documents of a bucket, and the most buckets of an index.
BUCKET_DOCS, BUCKETS = 1 << 14, 1 << 16
GROUP = "id long, h long, a long, g long, lo int, n int, at int"
RUN = "a long, g long, id long, h long, lo int, n int, at int, last long, old boolean"
MANIFEST = "version int, width int, gram int, buckets int, runs array<string>"
#: Buckets by the anchor serve joins by anchor and group; sorted files need no sort.
MERGE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


class Windows:
    """Anchors and hashes of the windows of some texts."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.words = Words(texts)
        self.width, self.gram = width, gram
        self.checks = Rolling(self.words.second_hash(), BASE_CHECK)

    def groups(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(text number, first window, windows, place of the anchor in the first window, anchor hash, group hash)."""
        owner, total = self.words.owner(), len(self.words) - self.width + 1
        for begin in range(0, total, BLOCK):
            got = self._block(owner, begin, min(begin + BLOCK, total))
            if got is not None:
                yield got

    def _block(self, owner: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, ...] | None:
        """Groups of the windows from `begin` to before `end`; one that goes on is cut there."""
        reach = end + self.width - 1
        value = mix(Rolling(self.words.hash[begin:reach], BASE_WORD).grams(self.gram))
        grams, place, span = value, np.arange(len(value)), 1
        wide = self.width - self.gram + 1
        while span < wide:  # least gram of `span` in a row, doubling; leftmost of equals
            step = min(span, wide - span)
            left, right = value[:-step], value[step:]
            later = right < left
            value, place = np.where(later, right, left), np.where(later, place[step:], place[:-step])
            span += step
        start = np.flatnonzero(owner[begin:end] == owner[begin + self.width - 1 : reach])
        if not len(start):
            return None
        anchor, text = place[start], owner[begin + start]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(start)))
        lo, anchor, text = start[first], anchor[first], text[first]
        at, lo_all = anchor - lo, lo + begin
        g = mix(self.checks.of(lo_all, lo_all + n - 1 + self.width) + at.astype(np.uint64) * BASE_WORD + n.astype(np.uint64))
        return text, lo_all - self.words.first[text], n, at, grams[anchor], g

    def hashes(self, text: int, lo: int, n: int) -> np.ndarray:
        """Of n windows of a text, from word lo on."""
        start = self.words.first[text] + np.arange(lo, lo + n)
        return mix(self.checks.of(start, start + self.width))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))


def _row() -> Column:
    return F.xxhash64("id", "h")


class WindowIndex:
    """add() finds what a batch repeats of itself and of all batches before it."""

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, gram: int = GRAM, buckets: int = 64, fan_in: int = FAN_IN):
        """Opens the index at `path`, or begins one there. Width, gram and buckets of an
        index that exists are its own; another width or gram is an error."""
        ship(spark)
        self.spark, self.fan_in = spark, fan_in
        self.path = path or scratch_path(spark, "window-index")
        self.width, self.gram, self.buckets = width, min(gram, width), buckets
        self.version, self.runs = 0, []
        newest = self._manifest()
        if newest is not None:
            if (newest.width, newest.gram) != (self.width, self.gram):
                raise ValueError(f"the index at {self.path} has windows of {newest.width} words and grams of {newest.gram}")
            self.buckets, self.version, self.runs = newest.buckets, newest.version, list(newest.runs)
        self.tables: dict[str, str] = {}

    def _manifest(self):
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _commit(self, runs: list[str]) -> None:
        self.version, self.runs = self.version + 1, runs
        line = (self.version, self.width, self.gram, self.buckets, runs)
        self.spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _write(self, rows: DataFrame, name: str, sort: list[str]) -> DataFrame:
        """Rows in the buckets of the index, as a table of its own."""
        table = f"lumenfold_{uuid.uuid4().hex}"
        placed = rows.repartition(self.buckets, "a").sortWithinPartitions(*sort)
        placed.write.bucketBy(self.buckets, "a").sortBy(*sort).option("path", f"{self.path}/{name}").option("compression", "uncompressed").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def run(self, name: str) -> DataFrame:
        """A run with its buckets, which a new session learns from the manifest."""
        if name not in self.tables:
            table = f"lumenfold_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} ({RUN}) USING parquet CLUSTERED BY (a) SORTED BY (a, g) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def brought(self) -> list[DataFrame]:
        """The groups that each run brought; no two runs have one in common."""
        return [self.run(r).filter("not old").drop("old") for r in self.runs]

    def known(self) -> DataFrame:
        """All groups of all runs."""
        return reduce(DataFrame.unionByName, self.brought(), self.spark.createDataFrame([], RUN).drop("old"))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        discard(self.spark, f"{self.path}/{name}")

    def remove(self) -> None:
        """Delete the whole index; what add() returned stays readable."""
        for name in list(self.tables):
            self._drop(name)
        discard(self.spark, self.path)

    def compact(self) -> None:
        """Merge all runs into one, then delete them."""
        if not self.runs:
            return
        old, name = list(self.runs), f"run-{uuid.uuid4().hex}"
        every = reduce(DataFrame.unionByName, self.brought())
        self._write(every.withColumn("old", F.lit(False)).select(*[c.split()[0] for c in RUN.split(", ")]), name, ["a", "g"])
        self._commit([name])
        for r in old:
            self._drop(r)

    def groups(self, docs: DataFrame) -> DataFrame:
        width, gram = self.width, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, h = (batch.column(i).to_numpy() for i in (0, 1))
                at = 0
                for held in slices((t.as_py() or b"",) for t in batch.column(2)):
                    for text, lo, n, place, a, g in Windows([t for (t,) in held], width, gram).groups():
                        text = text + at
                        cols = [ids[text], h[text], a.view(np.int64), g.view(np.int64), lo.astype(np.int32), n.astype(np.int32), place.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "h", "a", "g", "lo", "n", "at"])
                    at += len(held)

        return _keyed(docs).filter("id is not null").mapInArrow(run, GROUP)

    def _windows(self, store: DataFrame, asked: DataFrame) -> DataFrame:
        """asked (a, g, id, h, lo, n, at, fresh) -> a, g, id, fresh, o, w: their windows, hashed."""
        width, gram = self.width, self.gram
        lists = written(asked.groupBy("id", "h").agg(F.collect_list(F.struct("a", "g", "lo", "n", "at", "fresh")).alias("asked")), "window-asked", codec="uncompressed")
        texts = flag(_keyed(store), _row(), bit_filter(lists, _row()), "maybe").filter("maybe").drop("maybe").join(lists, ["id", "h"])
        flat = texts.select("id", "text", *[F.col(f"asked.{c}").alias(c) for c in ("a", "g", "lo", "n", "at", "fresh")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ident, text, a, g, lo, n, at, fresh in ([c[i].as_py() for c in batch.columns] for i in range(batch.num_rows)):
                    windows, size = Windows([text or b""], width, gram), sum(n)
                    w = np.concatenate([windows.hashes(0, x, k) for x, k in zip(lo, n, strict=True)])
                    o = np.concatenate([p - np.arange(k) for p, k in zip(at, n, strict=True)])
                    each = lambda x, n=n: np.repeat(np.array(x), n)
                    yield pa.RecordBatch.from_arrays([pa.array(each(a)), pa.array(each(g)), pa.array(np.full(size, ident)), pa.array(each(fresh)), pa.array(o.astype(np.int32)), pa.array(w.view(np.int64))], ["a", "g", "id", "fresh", "o", "w"])

        return flat.mapInArrow(run, "a long, g long, id long, fresh boolean, o int, w long")

    def merged(self, own: DataFrame) -> DataFrame:
        """The groups of a batch, each with its first document, merge-joined with the runs."""
        firsts = own.groupBy("a", "g").agg(F.min(F.struct("id", "h", "lo", "n", "at")).alias("f"), F.max("id").alias("last"))
        rows, old = firsts.select("a", "g", "f.*", "last").repartition(self.buckets, "a"), F.lit(False)
        for i, run in enumerate(self.brought()):
            rows = rows.join(run.select("a", "g", F.lit(True).alias(f"seen{i}")).hint("merge"), ["a", "g"], "left")
            old = old | F.coalesce(f"seen{i}", F.lit(False))
        return rows.select("a", "g", "id", "h", "lo", "n", "at", "last", old.alias("old"))

    def add(self, batch: DataFrame, store: DataFrame) -> DataFrame:
        """batch: documents to index. store: all documents indexed so far, with the batch.

        Returns id, h, spans: for each row of the batch (doc_id and hash of text) the
        word ranges [lo, hi) that repeat an earlier document.
        """
        own = written(self.groups(batch), "window-groups", codec="uncompressed")
        name, shared_name = f"run-{uuid.uuid4().hex}", f"shared-{uuid.uuid4().hex}"
        with settings(self.spark, MERGE):
            merged = self._write(self.merged(own), name, ["a", "g"])
            fresh = merged.filter("not old").drop("old")
            # anchors of several groups, of which one at least is new
            count, total = fresh.groupBy("a").agg(F.count("*").alias("c")), F.col("c")
            for i, run in enumerate(self.brought()):
                count = count.join(run.groupBy("a").agg(F.count("*").alias(f"c{i}")), "a", "left")
                total = total + F.coalesce(f"c{i}", F.lit(0))
            shared = self._write(count.filter(total > 1).select("a"), shared_name, ["a"])
            pick = lambda rows, new: rows.join(shared, "a", "left_semi").select("a", "g", "id", "h", "lo", "n", "at", F.lit(new).alias("fresh"))
            asked = reduce(DataFrame.unionByName, [pick(r, False) for r in self.brought()], pick(fresh, True))
            windows = written(self._windows(store, asked), "windows", codec="uncompressed")
        earliest = windows.groupBy("a", "o", "w").agg(F.min(F.struct("fresh", "id")).alias("first"), F.count("*").alias("c")).filter("c > 1")
        repeated = windows.filter("fresh").join(earliest, ["a", "o", "w"]).filter("not first.fresh or first.id < id")
        places = repeated.groupBy("a", "g").agg(F.collect_set("o").alias("os"))
        told = merged.join(places, ["a", "g"], "left").filter("old or last > id or os is not null").select("a", "g", "old", F.col("id").alias("first_id"), "os")
        # a table of its own: the join below then stands on two exchanges, so that a passage
        # that many documents share can be split
        told = written(told, "window-told", codec="uncompressed")
        hits = own.join(told, ["a", "g"])
        whole = F.array(F.struct(F.col("lo").alias("lo"), (F.col("lo") + F.col("n") - 1 + self.width).cast("int").alias("hi")))
        single = lambda o: F.struct((F.col("lo") + F.col("at") - o).cast("int").alias("lo"), (F.col("lo") + F.col("at") - o + self.width).cast("int").alias("hi"))
        spans = F.when(F.col("old") | (F.col("id") > F.col("first_id")), whole).otherwise(F.transform(F.coalesce("os", F.array().cast("array<int>")), single))
        found = hits.select("id", "h", spans.alias("s")).groupBy("id", "h").agg(F.flatten(F.collect_list("s")).alias("spans")).filter(F.size("spans") > 0)
        self._drop(shared_name)
        self._commit([*self.runs, name])
        if len(self.runs) > self.fan_in:
            self.compact()
        return found


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), spans of WindowIndex.add() ->
    doc_id, kept_text (kept words joined by a space), n_words, n_removed; row for row.

    Texts that the filter rules out are cut where they are read; the others, nearly all of
    which lose words, are shuffled to their spans.
    """
    spans = written(spans, "window-spans")
    texts = flag(_keyed(docs), _row(), bit_filter(spans, _row()), "maybe")
    lists = F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi")
    whole = texts.filter("not maybe").select("id", "text", *[F.lit(None).cast("array<int>").alias(c) for c in ("lo", "hi")])
    flat = texts.filter("maybe").join(spans, ["id", "h"], "left").select("id", "text", *lists).unionByName(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, lo, hi in ([batch.column(c)[i].as_py() for c in (1, 2, 3)] for i in range(batch.num_rows)):
                words = (text or b"").split()
                n_words.append(len(words))
                if lo:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, lo, 1)
                    np.subtract.at(depth, hi, 1)
                    keep = np.cumsum(depth[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept.append(b" ".join(words))
                n_removed.append(n_words[-1] - len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "kept_text", "n_words", "n_removed"])

    return flat.mapInArrow(run, "doc_id long, kept_text string, n_words long, n_removed long")


def _between(after: int | None, upto: int | None) -> Column:
    """Rows with after < doc_id <= upto; an end that is None is open."""
    c = F.lit(True)
    if after is not None:
        c = c & (F.col("doc_id") > after)
    return c & (F.col("doc_id") <= upto) if upto is not None else c


def drop_repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Take docs in batches of ascending doc_id through a new index and cut every batch.

    Batches are cut at quantiles of doc_id, so that they hold about as many rows each.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    about = base.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 10_000).alias("q")).first()
    ends = [None, *(sorted(set(about.q or [])) if batches > 1 else []), None]
    buckets = min(BUCKETS, max(8, -(-about.n // BUCKET_DOCS)))
    index = WindowIndex(docs.sparkSession, width=width, gram=gram, buckets=buckets)
    found = [index.add(base.filter(_between(a, b)), base.filter(_between(None, b))) for a, b in zip(ends, ends[1:], strict=False)]
    index.remove()
    return cut_spans(base, reduce(DataFrame.unionByName, found))


def digest(kept: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
