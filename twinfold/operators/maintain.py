"""Refresh of stored sets, clean-up scripts (never run here) and the hash cache."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.hashing import check_alg, file_digest
from twinfold.functions.paths import shell_quoted
from twinfold.model import CACHE, Options
from twinfold.operators.scan import as_sets, members, set_counts, shared
from twinfold.operators.verify import present
from twinfold.plans.store import HashCache, one_hash


def refresh(sets: DataFrame, now: DataFrame) -> DataFrame:
    """Sets (or membership rows, as given) without the members that are gone; sets left with one member go. Contents are not looked at."""
    left = members(sets).join(present(now).select("path"), "path", "left_semi")
    return as_sets(left) if "paths" in sets.columns else shared(left, "id").select("id", "each_size", "path")


def script(sets: DataFrame, link: str | None = None) -> DataFrame:
    """``keeping, path, line``: what a clean-up script says for each set; the first path is kept."""
    if link not in (None, "soft", "hard"):
        raise ValueError("link must be soft, hard or None")
    m = members(sets)
    one = m.join(set_counts(m).select("id", F.col("first").alias("keeping")), "id")
    remove = F.concat(F.lit("rm "), shell_quoted(F.col("path")))
    if link:
        remove = F.concat(remove, F.lit("\n" + ("ln -s " if link == "soft" else "ln ")), shell_quoted(F.col("keeping")), F.lit(" "), shell_quoted(F.col("path")))
    return one.select("keeping", "path", F.when(F.col("path") == F.col("keeping"), F.concat(F.lit("# KEEPING: "), F.col("path"))).otherwise(remove).alias("line"))


BANNER = "#\n# Commands to remove the duplicates listed in the store; the first file of each set is kept.\n# Review before use.\n#"


def script_text(sets: DataFrame, link: str | None = None) -> DataFrame:
    """The whole script in order, a ``value`` for each member, the banner first; for ``write.text``. Sets are sorted, not collected."""
    rows = script(sets, link).select(F.lit(1).alias("part"), "keeping", (F.col("path") != F.col("keeping")).alias("later"), "path", F.col("line").alias("value"))
    banner = sets.sparkSession.createDataFrame([(0, "", False, "", BANNER)], "part int, keeping string, later boolean, path string, value string")
    return banner.unionByName(rows).orderBy("part", "keeping", "later", "path").select("value")


def valid_entries(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows whose file still has the size and change time."""
    return cache.join(files.select("path", "size", "ctime"), ["path", "size", "ctime"], "left_semi")


def looked_up(files: DataFrame, cache: DataFrame, alg: str) -> DataFrame:
    """``path, result, hash`` with result file_not_present, hash_not_present or hash_found."""
    check_alg(alg)
    known = valid_entries(cache, files)
    any_ = known.select("path").distinct().withColumn("known", F.lit(True))
    out = files.select("path").join(any_, "path", "left").join(known.filter(F.col("alg") == alg).select("path", "hash"), "path", "left")
    return out.select("path", F.when(F.col("known").isNull(), "file_not_present").when(F.col("hash").isNull(), "hash_not_present").otherwise("hash_found").alias("result"), "hash")


def upserted(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new rows (same columns). Rows of a file whose size or change time differ are dropped; two hashes for one file and algorithm are an error."""
    changed = fresh.select("path", F.col("size").alias("s"), F.col("ctime").alias("t")).distinct()
    stale = cache.join(changed, "path").filter((F.col("size") != F.col("s")) | (F.col("ctime") != F.col("t"))).select("path").distinct()
    return one_hash(cache.join(stale, "path", "left_anti").unionByName(fresh))


def hash_one(path: str, alg: str = "xxhash", cache: DataFrame | None = None) -> bytes:
    """The digest of one file, from the cache if it is there and current."""
    check_alg(alg)
    s = os.stat(path)
    if cache is not None:
        hit = cache.filter((F.col("path") == path) & (F.col("size") == s.st_size) & (F.col("ctime") == int(s.st_ctime)) & (F.col("alg") == alg)).first()
        if hit:
            return bytes(hit["hash"])
    out = file_digest(path, alg, s.st_size)
    if out is None:
        raise OSError(f"cannot read {path}")
    return out


def hash_and_save(path: str, store: HashCache, alg: str = "xxhash", min_size: int = Options.cache_min_size) -> bytes:
    """The digest of one file; a file of more than ``min_size`` bytes is looked up in the cache, by a point read, and saved there as one more row."""
    s = os.stat(path)
    if s.st_size <= min_size:
        return hash_one(path, alg)
    state = (F.col("size") == s.st_size) & (F.col("ctime") == int(s.st_ctime)) & (F.col("alg") == alg)
    if hit := store.lookup([path]).filter(state).first():
        return bytes(hit["hash"])
    out = hash_one(path, alg)
    store.append(store.spark.createDataFrame([(path, s.st_size, int(s.st_ctime), alg, bytearray(out))], CACHE).coalesce(1))
    return out
