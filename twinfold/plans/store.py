"""The duplicate store and the hash cache: Parquet tables in buckets, so that one path is looked up in one of them."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.model import CACHE, MEMBERS, META, SEPARATOR, VERSION
from twinfold.operators.scan import as_sets, members
from twinfold.plans.staging import deleted, listed, settled

#: Fixed value: age in days after which a store is called old.
OLD_DAYS = 3
#: Folders that a table is dealt to by a hash of its key, and deltas of a cache from which it is compacted.
BUCKETS, DELTAS = 16, 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucketed(df: DataFrame, key: str, path: str, buckets: int = BUCKETS, *more: str) -> None:
    """Write a table in folders by bucket of its key, sorted by key within them, with Bloom filters of the key.

    Rows are dealt by ranges of bucket and key, and of ``more`` where a key has many rows, so no bucket or key is one task, and a file holds few keys.
    """
    rows = df.withColumn("bucket", bucket_of(F.col(key), buckets))
    order = ["bucket", key, *more]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(path)


def rows_at(table: DataFrame, key: str, values: list, buckets: int) -> DataFrame:
    """The rows of a bucketed table with one of some keys: only their buckets' files are listed, and of these only the parts whose statistics and filters may hold them are read."""
    if not values:
        return table.limit(0).drop("bucket")
    at = F.col("bucket").isin([bucket_of(F.lit(v), buckets) for v in values])
    return table.filter(at & F.col(key).isin(values)).drop("bucket")


class Generations:
    """Folders ``g00000000``, ``g00000001``, ... below a path: the last one that is complete holds, and a new one is written beside it, so a job that fails leaves what was there."""

    def __init__(self, spark: SparkSession, path: str, parts: tuple[str, ...]):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _names(self) -> list[str]:
        return [x for x in listed(self.spark, self.path) if re.fullmatch(r"g\d{8}", x)]

    def _complete(self) -> list[str]:
        return [x for x in self._names() if all("_SUCCESS" in listed(self.spark, f"{self.path}/{x}/{p}") for p in self.parts)]

    def last(self) -> str | None:
        done = self._complete()
        return f"{self.path}/{done[-1]}" if done else None

    def replace(self, *tables) -> None:
        """Write the next generation (tables, or functions that write one to a path), which may be derived from the last, then drop the earlier ones."""
        before = self._names()
        new = f"{self.path}/g{int(before[-1][1:]) + 1 if before else 0:08d}"
        for name, table in zip(self.parts, tables, strict=True):
            if isinstance(table, DataFrame):
                table.write.parquet(f"{new}/{name}")
            else:
                table(f"{new}/{name}")
        self.drop(before)

    def drop(self, names: list[str] | None = None) -> None:
        for name in self._names() if names is None else names:
            deleted(self.spark, f"{self.path}/{name}")


class DuplicateStore:
    """Membership rows (set, size, path), by set and by path, and ``meta`` below one folder; saving replaces all at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.kept = Generations(spark, path, ("members", "paths", "meta"))

    def save(self, sets: DataFrame, hidden: bool = False, hardlink_is_unique: bool = False, now_ms: int | None = None, buckets: int = BUCKETS) -> None:
        """``sets`` are sets or membership rows."""
        row = (hidden, VERSION, now_ms if now_ms is not None else int(time.time() * 1000), "ignore" if hardlink_is_unique else "normal", buckets)
        rows = settled(members(sets), "members")
        by_id, by_path = (lambda at: bucketed(rows, "id", at, buckets, "path")), (lambda at: bucketed(rows, "path", at, buckets))
        self.kept.replace(by_id, by_path, self.spark.createDataFrame([row], META).coalesce(1))

    def _last(self) -> str:
        where = self.kept.last()
        if where is None:
            raise FileNotFoundError(f"no duplicate store at {self.path}")
        return where

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{MEMBERS}, bucket int").parquet(f"{self._last()}/{name}")

    def members(self) -> DataFrame:
        """``id, each_size, path``."""
        return self._table("members").drop("bucket")

    def load(self) -> DataFrame:
        """``id, count, each_size, paths``; a set's paths are held together, so operators over large sets take ``members``."""
        return as_sets(self.members())

    def sets_of(self, paths: list[str]) -> list[int]:
        """The sets that some paths are in, by the index of paths; as many as paths at most."""
        return [r["id"] for r in rows_at(self._table("paths"), "path", paths, self.meta()["buckets"]).select("id").distinct().collect()]

    def candidates(self, paths: list[str]) -> DataFrame:
        """Membership rows of the sets of a few paths: a point read of the index, then one of the sets."""
        return rows_at(self._table("members"), "id", self.sets_of(paths), self.meta()["buckets"])

    def meta(self) -> dict:
        return self.spark.read.schema(META).parquet(f"{self._last()}/meta").first().asDict()

    def warnings(self, hardlink_is_unique: bool = False, now_ms: int | None = None) -> list[str]:
        """About another version or an old store; asking again for what the store was built with is an error."""
        meta = self.meta()
        if hardlink_is_unique and meta["hardlinks"] == "ignore":
            raise ValueError("the store was built with hard links held to be unique; the option cannot be given again")
        out = []
        if meta["version"] != VERSION:
            out.append(f"store has version {meta['version']}, this is {VERSION}")
        hours = ((now_ms if now_ms is not None else int(time.time() * 1000)) - meta["dbtime"]) // 3_600_000
        if hours > OLD_DAYS * 24:
            out.append(f"store is {hours} hours old")
        return out


class HashCache:
    """Digests by path, as a log: a base table in buckets and deltas beside it, each with a few new rows; made empty on first use.

    What was written last about a path holds: rows of another size or change time are stale, whichever algorithm they are of. Saving a file's digest writes its row and reads nothing;
    looking one up reads a bucket of the base and of the deltas. ``compact`` makes a new base of both, which ``append`` does by itself from ``DELTAS`` deltas on.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.kept = Generations(spark, path, ("hashes",))

    def deltas(self) -> list[str]:
        """The deltas that are complete, oldest first."""
        names = [x for x in listed(self.spark, f"{self.path}/deltas") if re.fullmatch(r"delta=d\d{20}-\w+", x)]
        return [f"{self.path}/deltas/{x}" for x in names if "_SUCCESS" in listed(self.spark, f"{self.path}/deltas/{x}")]

    def _tables(self) -> tuple[DataFrame, DataFrame | None]:
        """The base and the deltas' rows, which have ``seq``, the time of writing."""
        where, deltas = self.kept.last(), self.deltas()
        base = self.spark.read.schema(f"{CACHE}, bucket int").parquet(f"{where}/hashes") if where else self.spark.createDataFrame([], f"{CACHE}, bucket int")
        return base, self.spark.read.schema(f"{CACHE}, seq long, delta string, bucket int").option("basePath", f"{self.path}/deltas").parquet(*deltas).drop("delta") if deltas else None

    @staticmethod
    def _newest(base: DataFrame, deltas: DataFrame | None) -> DataFrame:
        if deltas is None:
            return base
        fresh = deltas.groupBy("path").agg(F.max(F.struct("seq", "size", "ctime")).alias("_v"))
        both = base.withColumn("seq", F.lit(0).cast("long")).unionByName(deltas).join(fresh, "path", "left")
        valid = both.filter(F.col("_v").isNull() | ((F.col("size") == F.col("_v.size")) & (F.col("ctime") == F.col("_v.ctime"))))
        return one_hash(valid)

    def load(self) -> DataFrame:
        base, deltas = self._tables()
        return self._newest(base.drop("bucket"), deltas.drop("bucket") if deltas is not None else None)

    def lookup(self, paths: list[str]) -> DataFrame:
        """The rows of a few paths: a point read."""
        base, deltas = self._tables()
        return self._newest(rows_at(base, "path", paths, self.buckets), rows_at(deltas, "path", paths, self.buckets) if deltas is not None else None)

    def append(self, rows: DataFrame) -> None:
        """Write new rows beside what is there. Two digests of one file state and algorithm are an error when they are read."""
        seq = time.time_ns()
        place = f"{self.path}/deltas/delta=d{seq:020d}-{uuid.uuid4().hex}"
        bucketed(rows.select("path", "size", "ctime", "alg", "hash", F.lit(seq).alias("seq")), "path", place, self.buckets)
        if len(self.deltas()) >= DELTAS:
            self.compact()

    def compact(self) -> None:
        """A new base with all rows that hold; the deltas that are in it go."""
        old = self.deltas()
        self._replace(self.load())
        for d in old:
            deleted(self.spark, d)

    def _replace(self, table: DataFrame) -> None:
        self.kept.replace(lambda at: bucketed(table.select("path", "size", "ctime", "alg", "hash"), "path", at, self.buckets))

    def save(self, table: DataFrame) -> None:
        """Replace all rows."""
        old = self.deltas()
        self._replace(table)
        for d in old:
            deleted(self.spark, d)

    def delete(self) -> None:
        deleted(self.spark, f"{self.path}/deltas")
        self.kept.drop()

    def ls(self) -> DataFrame:
        return self.load().select("path", "size", "ctime", "alg", F.lower(F.hex("hash")).alias("hash"))


def one_hash(rows: DataFrame) -> DataFrame:
    """A row for each file state and algorithm; two different digests of one are an error."""
    out = rows.groupBy("path", "size", "ctime", "alg").agg(F.min("hash").alias("hash"), F.max("hash").alias("_other"))
    check = F.when(F.col("hash") != F.col("_other"), F.raise_error(F.concat(F.lit("cached hash differs: "), F.col("path"))).cast("binary")).otherwise(F.col("hash"))
    return out.select("path", "size", "ctime", "alg", check.alias("hash"))


def to_delimited(sets: DataFrame) -> DataFrame:
    """Members as one string, for exchange."""
    return sets.withColumn("paths", F.array_join("paths", SEPARATOR))


def from_delimited(sets: DataFrame) -> DataFrame:
    return sets.withColumn("paths", F.split("paths", SEPARATOR))
