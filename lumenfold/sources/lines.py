"""Lines of text files with their numbers, read by byte ranges.

Spark cuts files into ranges and finds the lines that start in each; here they are counted
range by range, and the counts before a range give its first number. No file is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value (bytes, without the line feed), ended (false for a last line
    without one)."""
    meta = [F.col(f"_metadata.{n}").alias(a) for n, a in (("file_path", "path"), ("file_block_start", "range"), ("file_size", "size"))]
    raw = spark.read.option("lineSep", "\n").text(path).select(*meta, F.col("value").cast("binary").alias("value"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at = np.empty(len(keys), np.int64)
            for i, key in enumerate(keys):
                n = n + 1 if key == last else 1
                last, at[i] = key, n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "n"])

    lines = raw.mapInArrow(count, "path string, range long, size long, value binary, n long")
    ranges = lines.groupBy("path", "range").agg(F.max("n").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.first("size").alias("size"))
    own = Window.partitionBy("path")  # the ranges of a file
    before = F.sum("n").over(own.orderBy("range")) - F.col("n")
    ranges = ranges.select("path", "range", before.alias("before"), F.sum("n").over(own).alias("total"), (F.sum("bytes").over(own) == F.col("size")).alias("whole"))
    line = (F.col("before") + F.col("n")).alias("line")
    return lines.join(ranges, ["path", "range"]).select("path", line, "value", (F.col("whole") | (F.col("before") + F.col("n") < F.col("total"))).alias("ended"))
