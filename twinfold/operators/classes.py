"""Classes of files with equal bytes, by partition refinement.

Files of a group (of equal size, or of equal size and digest) are dealt to chunks by a hash of their paths. A chunk is refined on its own: files on disk are read block by block in lockstep, and
each block splits the classes that it tells apart; contents in a column are looked up among those that the chunk has seen. Each class of a chunk goes on with one file. Rounds repeat until a
group fits into a chunk; where a round no longer halves the files, as when many contents share a digest, they are dealt by a second digest of their content, so equal ones meet. So a group of
any size is no hot key, every class is found, not only that of the first file, and no content is joined with another: it moves to its chunk, once a round.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.paths import raw_of
from twinfold.model import Options
from twinfold.operators.membership import MOST_KEYS, kept
from twinfold.operators.scan import accepted, computed, in_columns
from twinfold.plans.staging import stage

#: Files that are compared in one task at once, and bytes of a block.
CHUNK, BLOCK = 256, 1 << 16
_PAIRS = pa.schema([("path", pa.string()), ("rep", pa.string())])


def refined(paths: list[str], block: int = BLOCK) -> list[list[str]]:
    """Classes of files on disk with equal bytes; each round reads one block of every file that still has a companion. Unreadable files are left out."""
    open_: dict[str, int] = {}
    for p in paths:
        try:
            open_[p] = os.open(raw_of(p), os.O_RDONLY)
        except OSError:
            continue
    done: list[list[str]] = []
    try:
        todo, at = [list(open_)] if open_ else [], 0
        while todo:
            after = []
            for some in todo:
                split: dict[bytes, list[str]] = {}
                for p in some:
                    try:
                        split.setdefault(os.pread(open_[p], block, at), []).append(p)
                    except OSError:
                        continue
                for piece, same in split.items():
                    (done if len(same) == 1 or not piece else after).append(same)
            todo, at = after, at + block
    finally:
        for fd in open_.values():
            os.close(fd)
    return done


def _on_disk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("size", "hash", "chunk", "path")), strict=True))
    for _, group in groupby(rows, key=lambda r: r[:3]):
        paths = [r[3] for r in group]
        for k in range(0, len(paths), 4 * CHUNK):  # a chunk has about CHUNK; file handles stay bounded
            pairs = [(p, c[0]) for c in refined(paths[k : k + 4 * CHUNK]) for p in c]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs, strict=True)], schema=_PAIRS)


def _in_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, seen = None, {}
    for b in batches:
        out = []
        for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in ("size", "hash", "chunk", "path")), strict=True)):
            if key[:3] != now:
                now, seen = key[:3], {}
            out.append((key[3], seen.setdefault(b.column("content")[k].as_py(), key[3])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=_PAIRS)


def _round(files: DataFrame, rows: DataFrame, by_content: bool, chunk: int) -> DataFrame:
    """``path, rep`` of each of ``rows`` (path, size, hash: staged): the file that its class in its chunk goes on with."""
    parts = rows.groupBy("size", "hash").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / chunk)).alias("parts")).filter("parts > 1")
    large = stage(parts, "large")
    if in_columns(files):
        key = F.xxhash64(F.lit(99), "content") if by_content else F.xxhash64("path")
        few = rows.count() <= MOST_KEYS
        here = files.select("path", "content") if few else kept(files.select("path", "content"), rows, "path")
        placed = here.join(F.broadcast(rows) if few else rows, "path").withColumn("key", key)
    else:
        placed = rows.select("path", "size", "hash")
        if by_content:
            second = stage(computed(rows.select("path", "size", *(F.lit(0).cast("long").alias(c) for c in ("dev", "inode", "ctime"))), "sha512"), "second")
            placed = placed.join(second.select("path", F.xxhash64("hash").alias("key")), "path")
        else:
            placed = placed.withColumn("key", F.xxhash64("path"))
    small = large.count() <= MOST_KEYS
    placed = placed.join(F.broadcast(large) if small else large, ["size", "hash"], "left")
    placed = placed.withColumn("chunk", F.pmod("key", F.coalesce("parts", F.lit(1)))).drop("key", "parts")
    placed = placed.repartition("size", "hash", "chunk").sortWithinPartitions("size", "hash", "chunk", "path")
    return placed.mapInArrow(_in_columns if in_columns(files) else _on_disk, "path string, rep string")


def classes_of(files: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``class, path, size``: files in classes of two or more, of equal bytes; ``class`` is the first path. ``groups``: path, size and hash of the files to compare, grouped by the latter two."""
    start = stage(groups.select("path", "size", "hash"), "compared")
    now, links, before, by_content = start, None, None, False
    while True:
        several = now.groupBy("size", "hash").agg(F.count("*").alias("_n")).filter("_n > 1")
        size = several.agg(F.max("_n").alias("most"), F.sum("_n").alias("all")).first()
        if size["most"] is None:
            break
        by_content = before is not None and size["all"] > before / 2
        rows = stage(now.join(several.drop("_n"), ["size", "hash"], "left_semi"), "rows")
        made = stage(_round(files, rows, by_content, chunk), "made")
        links = made if links is None else stage(links.join(made.select(F.col("path").alias("rep"), F.col("rep").alias("next")), "rep", "left").select("path", F.coalesce("next", "rep").alias("rep")), "links")
        if by_content or size["most"] <= chunk:
            break
        before = size["all"]
        now = rows.join(made.select(F.col("rep").alias("path")).distinct(), "path", "left_semi")
    if links is None:
        return start.select(F.col("path").alias("class"), "path", "size").limit(0)
    named = links.groupBy("rep").agg(F.min("path").alias("class"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return links.join(named, "rep").join(start.select("path", "size"), "path").select("class", "path", "size")


def byte_classes(files: DataFrame, options: Options = Options(hidden=True), alg: str | None = "sha512", chunk: int = CHUNK) -> DataFrame:
    """``class, path, size`` of all files with equal bytes. ``alg``: the digest that groups are made by before; None: by sizes alone, so nothing but bytes decides."""
    f = accepted(files, options)
    if alg:
        rows = computed(f if in_columns(f) else stage(f.select("path", "size", "dev", "inode", "ctime"), "narrow"), alg).filter(F.col("hash").isNotNull())
    else:
        rows = f.select("path", "size").withColumn("hash", F.lit(b""))
    return classes_of(f, rows, chunk)


def byte_equal(files: DataFrame) -> DataFrame:
    """``first, path, size``: each file whose bytes equal those of another, with the first path of its class."""
    return byte_classes(files).filter("path <> class").select(F.col("class").alias("first"), "path", "size")
