"""An extension: digests of files as they arrive, kept by Structured Streaming, so that a later scan only groups them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from twinfold.functions.hashing import digest
from twinfold.model import Options


def arriving(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Stateless: ``path, size, ctime, alg, hash`` of a stream of FILES rows with content; the rows are those of a hash cache."""
    return files.filter(F.col("size") >= options.min_size).select("path", "size", "ctime", F.lit(options.alg).alias("alg"), digest(options.alg, F.col("content")).alias("hash")).filter(F.col("hash").isNotNull())


def append_to(files: DataFrame, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Append the digests of all new rows to a Parquet table, exactly once."""
    return arriving(files, options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
