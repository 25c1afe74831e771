"""Shared pieces of the training-data operators: the shared scratch folder, written
intermediate tables, filters of a fixed size, and how Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six characters of [\x20\x09-\x0D]; bytes.split() and bytes.strip() take the same ones.
BLANKS = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])


#: Folders of local sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session in one process (tests, a laptop) gets a folder of its own;
    a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        found = _OWN[app]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table of this application; see clear_scratch()."""
    return f"{shared_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    jvm = spark.sparkContext._jvm  # the public API has no way to delete files
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results that weren't saved
    elsewhere can't be read after that, as they are read from such tables."""
    discard(spark, f"{shared_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that are made and run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Tables of hashes don't shrink; without a codec their writers need no buffers off the heap.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> tuple[Column, Column]:
    """Two columns that name a row of documents, also where doc_id repeats or is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("__h")


#: Bits of a filter: 16 MB at any number of keys. More keys let more rows through that the
#: join after it then drops.
FILTER_BITS = 1 << 27
_PAGE = 1 << 15


def bit_filter(keys: DataFrame, key: Column) -> DataFrame:
    """A set of 64-bit keys as pages of bits, __page and __bits: 4,096 rows of 4 kB at most."""
    at = keys.select((F.pmod(key, F.lit(FILTER_BITS)) + 1).alias("at"))
    # keys are shuffled, at some bytes each, and not the pages of every task
    paged = at.withColumn("__page", F.bitmap_bucket_number("at")).repartition("__page")
    return paged.groupBy("__page").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))


def flag(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """Adds a boolean: whether the row's key may be in the filter. False is sure."""
    at = F.pmod(key, F.lit(FILTER_BITS))
    held = rows.withColumn("__at", at).join(F.broadcast(bits), F.expr(f"__at div {_PAGE} + 1") == F.col("__page"), "left")  # bounded: FILTER_BITS
    place = F.col("__at") % _PAGE
    byte = F.conv(F.hex(F.substring("__bits", F.expr(f"int((__at % {_PAGE}) div 8 + 1)"), F.lit(1))), 16, 10).cast("int")
    return held.withColumn(name, F.coalesce(F.bit_get(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("__at", "__page", "__bits")


def filter_pages(bits: DataFrame) -> list[tuple[int, bytes]]:
    """The pages on the driver, for Python workers; bounded as bit_filter() is."""
    return [(r["__page"], bytes(r["__bits"])) for r in bits.collect()]


class BitSet:
    """filter_pages() in a worker."""

    def __init__(self, pages: list[tuple[int, bytes]]):
        self.bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for page, data in pages:
            at = (page - 1) * _PAGE // 8
            self.bits[at : at + len(data)] = np.frombuffer(data, dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(FILTER_BITS - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
