"""A tree walked level by level on the executors: names of a level's directories first, dealt out evenly, then ``lstat`` of each.

A flat directory is listed by one task, since its names come in one stream, but its entries are looked at by many; the next level's directories come from what was found, so the driver sees
a number for each level and no names. Each level is staged: a lost executor costs a re-read. For trees of a few directories ``tree`` is quicker.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.paths import raw_of, text_of
from twinfold.model import FILES, SEPARATOR, Options
from twinfold.plans.staging import stage
from twinfold.sources.tree import checked_roots

#: Names of a batch, and names that a task looks at.
BATCH, NAMES = 10_000, 20_000
_FIELDS = [f.split() for f in FILES.split(", ")]
_SCHEMA = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in _FIELDS])


def names(dirs: DataFrame, hidden: bool) -> DataFrame:
    """``root, dev, dir, name`` of the entries of directories (root, dev, path); a directory that cannot be listed gives a row without a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, dev, top in zip(*(b.column(c).to_pylist() for c in ("root", "dev", "path")), strict=True):
                try:
                    with os.scandir(raw_of(top)) as it:
                        while some := [text_of(e.name) for e in islice(it, BATCH)]:
                            kept = [n for n in some if hidden or not n.startswith(".")]
                            yield pa.RecordBatch.from_arrays([pa.array([root] * len(kept), pa.string()), pa.array([dev] * len(kept), pa.int64()), pa.array([top] * len(kept), pa.string()), pa.array(kept, pa.string())], ["root", "dev", "dir", "name"])
                except OSError:
                    yield pa.RecordBatch.from_arrays([pa.array([root]), pa.array([dev], pa.int64()), pa.array([top]), pa.array([None], pa.string())], ["root", "dev", "dir", "name"])

    return dirs.select("root", "dev", "path").mapInArrow(run, "root string, dev long, dir string, name string")


def looked_at(entries: DataFrame, one_device: bool) -> DataFrame:
    """FILES rows of entries, with kind ``dir`` for directories that are to be walked."""

    def row(root: str, dev: int | None, top: str, name: str | None) -> tuple | None:
        if name is None:
            up, own = os.path.split(raw_of(top))
            return (root, top, text_of(up), text_of(own), "error", None, None, None, None)
        path = top.rstrip("/") + "/" + name
        try:
            s = os.lstat(raw_of(path))
        except OSError:
            return (root, path, top, name, "error", None, None, None, None)
        if stat.S_ISDIR(s.st_mode):
            if one_device and s.st_dev != dev:
                return None
            kind = "dir"
        else:
            kind = "file" if stat.S_ISREG(s.st_mode) else "other"
        return (root, path, top, name, kind, s.st_size, s.st_ino, s.st_dev, int(s.st_ctime))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in map(row, *(b.column(c).to_pylist() for c in ("root", "dev", "dir", "name"))) if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SCHEMA.types)], _SCHEMA.names)

    return entries.mapInArrow(run, FILES)


def walk(spark: SparkSession, roots: list[str] | None = None, options: Options = Options(), names_per_task: int = NAMES) -> DataFrame:
    """All entries but directories, as ``tree`` gives them; every executor must see the roots."""
    tops = [(r, os.stat(r).st_dev, r) for r in map(lambda r: text_of(os.fsencode(r)), checked_roots(roots))]
    dirs, levels = spark.createDataFrame(tops, "root string, dev long, path string"), []
    dealt = lambda df, n, each: df.repartition(max(1, -(-n // each)))
    n = len(tops)
    while n:
        found = stage(names(dealt(dirs, n, 256), options.hidden), "names")
        level = stage(looked_at(dealt(found, found.count(), names_per_task), options.one_file_system), "level")
        levels.append(level.filter("kind <> 'dir'"))
        below = level.filter("kind = 'dir'")
        dirs = below.join(F.broadcast(spark.createDataFrame([(r, d) for r, d, _ in tops], "root string, top long")), "root").select("root", F.col("top").alias("dev"), "path")  # a row for each root
        n = below.count()
    out = reduce(DataFrame.unionByName, levels)
    return out if not options.skip_separator else out.withColumn("kind", F.when(F.col("name").contains(SEPARATOR), "badsep").otherwise(F.col("kind")))


def files_at(paths: DataFrame) -> DataFrame:
    """FILES rows of single paths (``path``) as they are now; what is gone is an error. For re-verification without a walk."""
    split = paths.select(F.lit("/").alias("root"), F.lit(None).cast("long").alias("dev"), F.when(F.regexp_extract("path", "^(.*)/[^/]*$", 1) == "", "/").otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return looked_at(split, False)
