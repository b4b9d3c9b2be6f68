"""Helpers shared by the operators: table reading, shared-folder staging, row digests."""

from __future__ import annotations

import ctypes
import functools
import gc
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.plans.staging import place, release, shared_dir, stage, staged_alone

__all__ = ["place", "release", "shared_dir", "stage", "staged_alone"]

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """``doc_id``, the whole text (null: empty) and the columns named; all other columns are pruned."""
    return docs.select("doc_id", *more, F.coalesce(F.col(text), F.lit("")).alias("text"))


def slices(batches, column: str, size: int):
    """The batches in slices of about ``size`` bytes (or items) of a column, one row at least, so that what a worker holds at once is bounded.

    Lengths come from the column's offsets; no value is copied.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows, at = batch.column(column), 0
        kind = rows.type
        width = np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) or pa.types.is_large_list(kind) else np.int32
        ends = np.frombuffer(rows.buffers()[1], width)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, width)
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Memo:
    """Two generations of entries, each of at most ``most``: when the newer one is full it becomes the older, and entries in use move on."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def room(self, n: int) -> None:
        if len(self.now) + n > self.most:
            self.now, self.old = {}, self.now


class Bounded(dict):
    """A memo of at most ``most`` entries; when full it starts over, so a worker's memory stays bounded."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.clear()


def trim() -> None:
    """Give freed memory back to the system: a Python worker that waits for its next task would hold it otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def uncollected():
    """Without collection of cycles, whatever happens inside: a worker that is used again must collect."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


_owner: list = [None, None]


def claim(name: str, clear=None) -> None:
    """Called by an operator in a Python worker, which Spark uses again for other operators: drops what the one before has kept there."""
    if _owner[0] != name:
        if _owner[1]:
            _owner[1]()
        _owner[:] = [name, clear]
        gc.collect()
        trim()


def trimmed(run):
    """``run``, a function from batches to batches, with ``trim`` after its last one."""

    @functools.wraps(run)
    def whole(*args):
        yield from run(*args)
        trim()

    return whole
