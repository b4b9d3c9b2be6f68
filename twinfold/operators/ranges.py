"""Large files by ranges: a row for each range, read in any task, and an ordered fold of the ranges' digests to one of the file.

The fold is a tree of ``FAN`` digests a node, so no task gathers more than those, whatever a file's size. Files of equal size have equal ranges, and their folds are equal exactly where
their contents are, as with digests of the whole (and as surely: a node is a digest of digests). A fold is not the digest of the file's bytes, which can only be made in order; the cache and
the hash command keep to that one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.extents import hole_map, read_range
from twinfold.functions.hashing import check_alg, digest
from twinfold.plans.staging import stage

#: Bytes of a range, ranges that one node of a fold covers, bytes that a task reads.
RANGE, FAN, TASK_BYTES = 64 << 20, 1024, 512 << 20


def ranges(files: DataFrame, span: int = RANGE) -> DataFrame:
    """``path, size, range, start, length``: the ranges of each file; an empty file has one."""
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / span) - 1)
    rows = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("range"))
    return rows.select("path", "size", "range", (F.col("range") * span).alias("start"), F.least(F.lit(span), F.col("size") - F.col("range") * span).cast("long").alias("length"))


def dealt(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Ranges dealt evenly to as many tasks as their bytes ask for."""
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    return rows.repartition(max(1, -(-total // task_bytes)))


def range_digests(rows: DataFrame, alg: str) -> DataFrame:
    """Ranges with ``hash`` (null: unreadable or shorter than it was) and ``read``, the bytes that were really read; holes are not."""
    check_alg(alg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part = b.slice(k, 1)
                path, start, length = (part.column(c)[0].as_py() for c in ("path", "start", "length"))
                made, covered, read = read_range(path, alg, start, length)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([made if covered == length else None], pa.binary()), pa.array([read], pa.int64())], [*part.schema.names, "hash", "read"])

    return rows.mapInArrow(run, "path string, size long, range long, start long, length long, hash binary, read long")


def folded(rows: DataFrame, alg: str, most: int, fan: int = FAN) -> DataFrame:
    """``path, hash`` from ``path, range, hash`` rows of at most ``most`` ranges a file: levels of digests over digests, in order. Null if one is missing."""
    now, count = rows.select("path", "range", "hash"), most
    while True:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("range", F.hex("hash").alias("h")))), lambda x: x["h"])
        now = now.groupBy("path", F.floor(F.col("range") / fan).alias("node")).agg(F.when(F.bool_and(F.col("hash").isNotNull()), digest(alg, F.unhex(F.array_join(kids, "")))).alias("hash"))
        count = -(-count // fan)
        if count <= 1:
            return now.select("path", "hash")
        now = now.withColumnRenamed("node", "range")


def tree_digests(files: DataFrame, alg: str, span: int = RANGE, fan: int = FAN, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` (narrow rows of files on disk) with ``hash``, the fold of their ranges' digests. Ranges are read once and staged."""
    largest = files.agg(F.max("size").alias("n")).first()["n"]
    if largest is None:
        return files.withColumn("hash", F.lit(None).cast("binary"))
    read = stage(range_digests(dealt(ranges(files, span), task_bytes), alg), "ranges")
    return files.join(folded(read, alg, -(-largest // span), fan), "path")


def holes(files: DataFrame) -> DataFrame:
    """``path, start, length, data``: the hole map of each file on disk, data and holes in turn; no row for files that cannot be read or are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                found = hole_map(path) or []
                for k in range(0, len(found), 10_000):
                    start, length, data = zip(*found[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(start)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data)], ["path", "start", "length", "data"])

    return files.select("path").mapInArrow(run, "path string, start long, length long, data boolean")


def column_ranges(path: Column, content: Column, df: DataFrame, alg: str, span: int) -> DataFrame:
    """``path, range, hash`` of content in a column, for contents that a row holds; ``folded`` makes their trees' digests."""
    cut = df.select(path.alias("path"), content.alias("c"), F.octet_length(content).alias("n"))
    rows = cut.select("path", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("n") / span) - 1).cast("long"))).alias("range"))
    return rows.select("path", "range", digest(alg, F.substring("c", (F.col("range") * span + 1).cast("int"), F.lit(span))).alias("hash"))
