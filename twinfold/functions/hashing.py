"""Digests: built-in expressions for content in a column, streamed reads for files of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.extents import read_range
from twinfold.model import ALGORITHMS

#: Fixed value: the long whose XXH64 under Spark's seed 42 is 1; chaining it makes the seed of the next column 1.
SEED_ONE = -7682426122119481604
#: Files whose digests are sent on at once.
FILES = 1000


def check_alg(alg: str) -> str:
    if alg not in ALGORITHMS:
        raise ValueError(f"unknown hash function {alg!r}; one of {', '.join(ALGORITHMS)}")
    return alg


def digest(alg: str, content: Column) -> Column:
    """The digest as bytes in memory order; null content (unreadable) has none."""
    check_alg(alg)
    if alg == "xxhash":
        h = F.lpad(F.hex(F.xxhash64(F.lit(SEED_ONE), content)), 16, "0")
        out = F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8))))
    else:
        out = F.unhex({"md5": F.md5, "sha1": F.sha1, "sha512": lambda c: F.sha2(c, 512)}[alg](content))
    return F.when(content.isNotNull(), out)


def dump(path: Column, hash_: Column) -> Column:
    """``path: aa bb cc `` with each byte of the digest in hex."""
    return F.concat(path, F.lit(": "), F.regexp_replace(F.lower(F.hex(hash_)), "(..)", "$1 "))


def file_digest(path: str, alg: str, size: int | None = None, most: int | None = None, skip: int = 0) -> bytes | None:
    """Of a file on disk, read in pieces and without its holes, or of ``most`` bytes after the first ``skip``; None if it cannot be read or is shorter than ``size``."""
    out, covered, _ = read_range(path, alg, skip, most)
    if size is not None and covered < min(max(0, size - skip), size if most is None else most):
        return None
    return out


def hash_files(files: DataFrame, alg: str, most: int | None = None, skip: int = 0) -> DataFrame:
    """``files`` (path and size at least) with ``hash`` of what is on disk; every executor must see the paths."""
    check_alg(alg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, FILES):
                part = b.slice(k, FILES)
                hashes = [file_digest(p, alg, s, most, skip) for p, s in zip(part.column("path").to_pylist(), part.column("size").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hashes, pa.binary())], [*part.schema.names, "hash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, hash binary")
