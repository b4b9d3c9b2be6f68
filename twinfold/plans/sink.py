"""Reports as a Spark data sink: pieces of text in order, a file for each task, head and foot written when the job commits.

Rows are members, not sets: the row of a set's first path carries the entry's beginning, that of its last path its end, so a set may lie in several tasks and none holds it. Each task writes a
file of its own; a commit keeps those of the successful attempts and puts head and foot around them, an abort leaves nothing. The folder must be seen by all executors, as the files reported on are.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from twinfold.functions.paths import csv_quoted, cut
from twinfold.operators.scan import members, set_counts
from twinfold.plans.report import FORMATS
from twinfold.plans.staging import settled

#: Bytes that a task holds before it writes them.
BUFFER = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str


class ReportWriter(DataSourceWriter):
    """Writes the column ``value`` of rows, without anything between them."""

    def __init__(self, options, overwrite: bool):
        self.path, self.head, self.foot, self.overwrite = options["path"], options.get("head", ""), options.get("foot", ""), overwrite
        self.job = f".{uuid.uuid4().hex}"  # tasks write here until the job commits

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        at = TaskContext.get()
        folder, name = os.path.join(self.path, self.job), f"{at.partitionId():05d}-{at.taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        held, size = [], 0
        with open(os.path.join(folder, name), "w", encoding="utf-8", errors="surrogateescape", newline="") as f:
            for row in iterator:
                held.append(row["value"])
                size += len(held[-1])
                if size > BUFFER:
                    f.write("".join(held))
                    held, size = [], 0
            f.write("".join(held))
        return Written(at.partitionId(), name)

    def commit(self, messages: list[Written | None]) -> None:
        folder = os.path.join(self.path, self.job)
        os.makedirs(folder, exist_ok=True)
        if self.overwrite:
            for old in os.listdir(self.path):
                if old.startswith("report-"):
                    os.remove(os.path.join(self.path, old))
        for name, text in (("report-head.txt", self.head), ("report-z-foot.txt", self.foot)):  # in the order of names: head, parts, foot
            with open(os.path.join(self.path, name), "w", encoding="utf-8", newline="") as f:
                f.write(text)
        for m in messages:
            if m is not None:
                os.replace(os.path.join(folder, m.name), os.path.join(self.path, f"report-part-{m.partition:05d}.txt"))
        shutil.rmtree(folder, ignore_errors=True)  # files of attempts that did not count

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(os.path.join(self.path, self.job), ignore_errors=True)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dupreport"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options, overwrite)


def pieces(sets: DataFrame, fmt: str = "text", min_total: int = 0, prefix: str | None = None) -> DataFrame:
    """``total, each_size, first, id, path, value``: the report's text in pieces, one for each member, ordered by the five columns before."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    m = settled(members(sets), "members")
    counts = m.groupBy("id", "each_size").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).filter("n > 1")
    counts = counts.withColumn("total", F.col("n") * F.col("each_size")).filter(F.col("total") >= min_total)
    if fmt == "json":  # the first entry has no comma before it; one row
        least = counts.agg(F.min(F.struct("total", "each_size", "first", "id")).alias("least"))
        counts = counts.join(F.broadcast(least)).withColumn("comma", F.when(F.struct("total", "each_size", "first", "id") == F.col("least"), "").otherwise(",\n")).drop("least")
    rows = m.join(counts.drop("each_size"), "id")
    total, each, shown, lit = F.col("total").cast("string"), F.col("each_size").cast("string"), cut(F.col("path"), prefix), F.lit
    begins, ends = F.col("path") == F.col("first"), F.col("path") == F.col("last")
    if fmt == "text":
        opening, own, closing = F.concat(total, lit(" total bytes used by duplicates of size "), each, lit(":\n")), F.concat(lit("  "), shown, lit("\n")), lit("\n\n")
    elif fmt == "csv":
        opening, own, closing = F.concat(total, lit(","), each), F.concat(lit(","), csv_quoted(shown)), lit("\n")
    else:
        opening, own, closing = F.concat("comma", lit("[ "), total, lit(", "), each), F.concat(lit(", "), F.regexp_extract(F.to_json(F.array(shown)), r"(?s)^\[(.*)\]$", 1)), lit(" ]\n")
    value = F.concat(F.when(begins, opening).otherwise(""), own, F.when(ends, closing).otherwise(""))
    return rows.select("total", "each_size", "first", "id", "path", value.alias("value"))


def write_report(sets: DataFrame, out: str, fmt: str = "text", min_total: int = 0, prefix: str | None = None) -> None:
    """The whole report in the folder ``out``: its files in the order of their names are the report. Members are sorted, sets are never held."""
    spark = sets.sparkSession
    m = settled(members(sets), "members")
    head, foot = {"text": ("\n", ""), "csv": ("", ""), "json": ("[\n", "]\n")}[fmt] if fmt in FORMATS else ("", "")
    rows = pieces(m, fmt, min_total, prefix)
    if fmt == "text":
        used = set_counts(m).select((F.col("count").cast("long") * F.col("each_size")).alias("total")).filter(F.col("total") >= min_total).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
        foot = f"Total used: {used} bytes ({used // 1024} KiB, {used // 1024**2} MiB, {used // 1024**3} GiB)\n"
    spark.dataSource.register(ReportSink)
    ordered = rows.orderBy("total", "each_size", "first", "id", "path").select("value")
    ordered.write.format("dupreport").option("path", out).option("head", head).option("foot", foot).mode("overwrite").save()
