"""The inverted index against the scan of search.py, and what it reads and writes."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import search, text_index
from lumenfold.operators.text_index import TextIndex
from lumenfold.sources.commits import CommitLog, Conflict

EVENTS = "event_id long, session_id string, event_type string, redacted_text string, created_at long"
RNG = random.Random(4)
VOCAB = ["alpha", "beta", "alphabet", "Être", "etre", "việt", ".env", "-rf", "a.b", "мой", "gamma", "ΣΟΦΟΣ"]
ROWS = [(i * 3, f"s{i % 4}", RNG.choice(["note.added", "tool_call.opened"]), " ".join(RNG.choices(VOCAB, k=RNG.randrange(1, 9))), i) for i in range(120)]
ROWS += [(400, "s1", "note.added", None, 1), (401, "s1", "note.added", "", 1), (402, None, None, "... --- , !", 1), (403, "s1", "x", "alpha " * 500 + "beta", 1)]
QUERIES = [
    "alpha", "ALPHA beta", "alpha OR beta", "alpha NOT beta", '"alpha beta"', '"alpha beta"*', '"beta alpha beta"', "alph*", "etre", "ÊTRE viet", ".env", "-rf OR a.b", "session_id:s1", "session_id:s* мой", "event_type:tool_call*",
    "(alpha OR beta) AND (gamma NOT session_id:s2)", 'redacted_text:"alpha beta" OR event_type:x', "σοφος", "nowhere", "note.added", "alpha alpha", "s1 alpha", "... OR alpha",
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, EVENTS).repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, events, tmp_path_factory):
    """Five increments, four of which were merged; opened anew for each."""
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    for last in (60, 120, 200, 330, 500):
        TextIndex(spark, path, 8).add(events.filter(F.col("event_id") <= last))
    return TextIndex(spark, path)


def files_read(df):
    """Files that the scans of a plan open."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numFiles")
        found += metric.get().value() if metric.isDefined() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("query", QUERIES)
def test_the_index_finds_what_the_scan_finds(index, events, query):
    assert index.search(query, events).collect() == search.search(events, query).collect()


def test_limits_and_faulty_queries(index, events):
    assert index.search("alpha", events, 5).collect() == search.search(events, "alpha", 5).collect()
    for bad in ("", "alpha OR", "(alpha", "alpha)", "NOT alpha", '"!"'):
        with pytest.raises(ValueError):
            index.ids(bad)


def test_an_index_is_made_of_levels(index, events):
    levels = sorted(s["level"] for s in index._state()[1]["segments"])
    assert levels == [0, 1] and index.buckets == 8 and index.log.version() == 6
    assert index.add(events) == 6  # nothing is new
    rows = index._rows(index._state()[1]["segments"], "postings", text_index.POSTING)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, text_index.postings(events, 8).collect()))
    held = {r.term: r.n for r in index.terms().collect()}
    assert held == {r.term: r.n for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert {r.term for r in index.terms("alph").collect()} == {"alpha", "alphabet"}


def test_a_search_opens_the_buckets_of_its_terms(spark, index):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        segments = index._state()[1]["segments"]
        every = files_read(index._rows(segments, "postings", text_index.POSTING))
        in_bucket = lambda terms: sum(len(glob.glob(f"{index.path.removeprefix('file://')}/postings/segment={s['name']}/bucket={b}/*.parquet")) for s in segments for b in {r.bucket for r in index.terms().filter(F.col("term").isin(terms)).collect()})
        assert files_read(index.matching({"alpha"})) == in_bucket(["alpha"]) < every / 3
        assert files_read(index.matching({"beta"}, {"alph"})) == in_bucket(["alpha", "alphabet", "beta"]) < every
        assert files_read(index.matching({"alpha"})) > 0 and index.matching(set(), {"zz"}).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_postings_are_sorted_differences(index):
    files = glob.glob(f"{index.path.removeprefix('file://')}/postings/*/bucket=*/*.parquet")
    for f in files:
        columns = pq.ParquetFile(f).metadata.row_group(0)
        kinds = {columns.column(i).path_in_schema: columns.column(i).encodings for i in range(4)}
        assert "DELTA_BYTE_ARRAY" in kinds["term"] and "DELTA_BINARY_PACKED" in kinds["event_id"] and "DELTA_BINARY_PACKED" in kinds["pos"]
        rows = pq.ParquetFile(f).read().to_pylist()
        assert [(r["term"].encode(), r["event_id"], r["field"], r["pos"]) for r in rows] == sorted((r["term"].encode(), r["event_id"], r["field"], r["pos"]) for r in rows)


def test_a_frequent_term_is_written_in_parts(spark, events, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 40)
    monkeypatch.setattr(text_index, "BUCKETS", 2)
    one = TextIndex(spark, f"file://{tmp_path}/i", 2)
    one.add(events)
    name = one._state()[1]["segments"][0]["name"]
    assert min(len(glob.glob(f"{tmp_path}/i/postings/segment={name}/bucket={b}/*.parquet")) for b in range(2)) > 1
    assert one.search("alpha", events).collect() == search.search(events, "alpha").collect()


def test_of_two_writers_one_fails_and_broken_writes_leave_nothing(spark, events, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    one, other, plain = TextIndex(spark, path, 4), TextIndex(spark, path, 4), CommitLog.commit

    def late(self, expected, entry):
        monkeypatch.setattr(CommitLog, "commit", plain)
        other.add(events.filter("event_id < 90"))
        return plain(self, expected, entry)

    monkeypatch.setattr(CommitLog, "commit", late)
    with pytest.raises(Conflict):
        one.add(events.filter("event_id < 200"))
    wanted = search.search(events.filter("event_id < 90"), "alpha").collect()
    assert one.search("alpha", events).collect() == wanted and one.log.version() == 1
    assert one.vacuum() == 1 and one.search("alpha", events).collect() == wanted
    one.add(events)
    assert one.search("alpha", events).collect() == search.search(events, "alpha").collect()


def test_an_empty_index(spark, events, tmp_path):
    none = TextIndex(spark, f"file://{tmp_path}/i", 4)
    assert none.add(events.limit(0)) == 0 and none.search("alpha OR be*", events).collect() == [] and none.vacuum() == 0
    none.add(events.filter("event_id = 401 or event_id = 402").withColumns({"session_id": F.lit(None).cast("string"), "event_type": F.lit("!")}))
    assert none.search("alpha", events).collect() == [] and [r.event_id for r in none.search("...", events).collect()] == [402]


def test_files_are_as_many_as_postings_need(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sparse = spark.range(300).select((F.col("id") * 100_003).alias("event_id"), F.lit("s1").alias("session_id"), F.lit("note.added").alias("event_type"), F.lit("alpha beta").alias("redacted_text"), F.lit(1).cast("long").alias("created_at"))
        one = TextIndex(spark, f"file://{tmp_path}/i", 2)
        one.add(sparse)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 1 <= len(glob.glob(f"{tmp_path}/i/postings/segment=*/bucket=*/*.parquet")) <= 2  # one for each bucket
    assert one.search("alpha", sparse).count() == 300 == one.hits("s1 beta", sparse).count()


def test_events_of_one_partition_are_indexed_by_many_tasks(spark, tmp_path, monkeypatch):
    told, made = [], text_index.postings

    def seen(rows, buckets):
        told.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return made(rows, buckets)

    monkeypatch.setattr(text_index, "postings", seen)
    monkeypatch.setattr(text_index, "TASK_CHARS", 512, raising=False)
    one = spark.createDataFrame(ROWS, EVENTS).coalesce(1)
    index = TextIndex(spark, f"file://{tmp_path}/i", 8)
    index.add(one.filter(F.col("event_id") <= 300))
    index.add(one)
    assert all(len(sizes) > 3 and max(sizes) <= sum(sizes) / 2 for sizes in told[:1]) and [sum(sizes) for sizes in told] == [101, len(ROWS) - 101]
    assert index.search("alpha", one).collect() == search.search(one, "alpha").collect()
