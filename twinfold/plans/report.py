"""Reports over stored sets: text, CSV and JSON, one row for each set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.paths import csv_quoted, cut

FORMATS = ("text", "csv", "json")


def totals(sets: DataFrame, min_total: int = 0) -> DataFrame:
    """``total, each_size, count, paths`` of the sets that use at least ``min_total`` bytes in all."""
    t = sets.withColumn("total", F.col("count").cast("long") * F.col("each_size"))
    return t.filter(F.col("total") >= min_total).select("total", "each_size", "count", "paths")


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy("total", "each_size", F.element_at("paths", 1))


def worst(sets: DataFrame, n: int = 10) -> DataFrame:
    """The n sets that use most space."""
    return totals(sets).orderBy(F.desc("total"), F.desc("each_size"), F.element_at("paths", 1)).limit(n)


def body(fmt: str, prefix: str | None = None) -> Column:
    """The text of one set's entry."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    shown = F.transform("paths", lambda p: cut(p, prefix))
    total, each = F.col("total").cast("string"), F.col("each_size").cast("string")
    if fmt == "text":
        return F.concat(total, F.lit(" total bytes used by duplicates of size "), each, F.lit(":\n"), F.array_join(F.transform(shown, lambda p: F.concat(F.lit("  "), p)), "\n"), F.lit("\n\n"))
    if fmt == "csv":
        return F.concat_ws(",", total, each, F.array_join(F.transform(shown, csv_quoted), ","))
    return F.concat(F.lit("[ "), total, F.lit(", "), each, F.lit(", "), F.array_join(F.transform(shown, lambda p: F.regexp_extract(F.to_json(F.array(p)), r"(?s)^\[(.*)\]$", 1)), ", "), F.lit(" ]"))


def rendered(sets: DataFrame, fmt: str = "text", min_total: int = 0, prefix: str | None = None) -> DataFrame:
    """``total, each_size, entry``, in report order."""
    return ordered(totals(sets, min_total)).select("total", "each_size", body(fmt, prefix).alias("entry"))


def grand_total(sets: DataFrame, min_total: int = 0) -> DataFrame:
    """``bytes, kib, mib, gib``: each unit truncates the one before."""
    b = F.coalesce(F.sum("total"), F.lit(0)).cast("long")
    out = totals(sets, min_total).agg(b.alias("bytes"))
    return out.selectExpr("bytes", "bytes div 1024 AS kib", "bytes div 1024 div 1024 AS mib", "bytes div 1024 div 1024 div 1024 AS gib")


def footer(total: DataFrame) -> DataFrame:
    return total.select(F.format_string("Total used: %d bytes (%d KiB, %d MiB, %d GiB)", "bytes", "kib", "mib", "gib").alias("line"))


def report_rows(sets: DataFrame, fmt: str = "text", min_total: int = 0, prefix: str | None = None) -> DataFrame:
    """``part, total, each_size, first, value``: the whole report, a row for an entry, ordered by the first four; ``part`` is 0 for the head, 1 for entries and 2 for the foot.

    JSON entries but the first have a line with a comma before them. Which is first is a minimum, so no row is numbered.
    """
    rows = totals(sets, min_total)
    first = F.element_at("paths", 1)
    out = rows.select(F.lit(1).alias("part"), "total", "each_size", first.alias("first"), body(fmt, prefix).alias("value"))
    spark, schema = sets.sparkSession, "part int, total long, each_size long, first string, value string"
    if fmt == "csv":
        return out
    if fmt == "text":
        end = footer(grand_total(sets, min_total)).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("each_size"), F.lit("").alias("first"), F.col("line").alias("value"))
        return spark.createDataFrame([(0, 0, 0, "", "")], schema).unionByName(out).unionByName(end)
    least = rows.agg(F.min(F.struct("total", "each_size", first.alias("first"))).alias("least"))  # one row
    comma = F.when(F.struct("total", "each_size", "first") == F.col("least"), "").otherwise(",\n")
    out = out.join(F.broadcast(least)).withColumn("value", F.concat(comma, "value")).drop("least")
    return spark.createDataFrame([(0, 0, 0, "", "["), (2, 0, 0, "", "]")], schema).unionByName(out)


def write_report(sets: DataFrame, out: str, fmt: str = "text", min_total: int = 0, prefix: str | None = None) -> None:
    """The whole report as text files in ``out``, in order."""
    report_rows(sets, fmt, min_total, prefix).orderBy("part", "total", "each_size", "first").select("value").write.mode("overwrite").text(out)
