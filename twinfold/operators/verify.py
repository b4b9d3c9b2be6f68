"""Re-verification of stored sets against the current files.

``now`` is a FILES table with content, or of paths on disk; ``sets`` a table of sets or of membership rows. Each member is hashed once. Labels need counts only and are
linear in the members; pairs are made for the paths asked about, as the details of a file or a listing are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.paths import cut, under
from twinfold.model import STATUS
from twinfold.operators.membership import kept
from twinfold.operators.scan import NARROW, computed, in_columns, members, set_counts
from twinfold.plans.staging import settled, stage
from twinfold.plans.store import DuplicateStore


def present(now: DataFrame) -> DataFrame:
    return now.filter(F.col("kind") == "file")


def current(now: DataFrame, wanted: DataFrame, alg: str) -> DataFrame:
    """``path, dev, inode, hash`` of the wanted paths that exist; unreadable files have no hash.

    Only what is wanted is digested, and contents do not move: those in a column are picked where they are, by their paths if these are few, else by a membership filter of them. Files
    on disk are picked by path before they are read.
    """
    wanted = stage(wanted.select("path").distinct(), "wanted")
    if in_columns(now):
        rows = computed(kept(present(now), wanted, "path"), alg).join(wanted, "path")
    else:
        rows = computed(stage(present(now).select(*NARROW).join(wanted, "path", "left_semi"), "present"), alg)
    return rows.select("path", "dev", "inode", "hash")


def excluded(path: Column, exclude_path: str | None) -> Column:
    if not exclude_path:
        return F.lit(False)
    if not exclude_path.startswith("/"):
        raise ValueError("exclude_path must be absolute")
    return under(path, exclude_path)


def status_of(exclude_path: str | None = None) -> Column:
    """Excluded, then missing, then hard link, then equal digest."""
    out = F.when(excluded(F.col("candidate"), exclude_path), STATUS["exclude"])
    out = out.when(F.col("c_inode").isNull(), STATUS["not_duplicate"])
    out = out.when((F.col("p_dev") == F.col("c_dev")) & (F.col("p_inode") == F.col("c_inode")), STATUS["hardlink"])
    return out.when(F.col("p_hash") == F.col("c_hash"), STATUS["duplicate"]).otherwise(STATUS["not_duplicate"])


def verified_pairs(sets: DataFrame, now: DataFrame, alg: str = "xxhash", paths: DataFrame | None = None, exclude_path: str | None = None) -> DataFrame:
    """``path, candidate, status`` of each queried path (default: all existing members) and each other member of its set.

    The rows are those asked for: as many as a path has candidates. Labels do not need them, see ``listing``.
    """
    m = settled(members(sets).select("id", "path"), "members")
    asked = m if paths is None else m.join(paths.select("path").distinct(), "path", "left_semi")
    pairs = asked.join(m.select("id", F.col("path").alias("candidate")), "id").filter("path <> candidate")
    info = current(now, m if paths is None else m.join(asked.select("id").distinct(), "id", "left_semi"), alg)
    side = lambda p, c: info.select(F.col("path").alias(c), *(F.col(x).alias(f"{p}_{x}") for x in ("dev", "inode", "hash")))
    out = pairs.join(side("p", "path"), "path").join(side("c", "candidate"), "candidate", "left")
    return out.select("path", "candidate", status_of(exclude_path).alias("status"))


def duplicate_counts(sets: DataFrame, now: DataFrame, alg: str = "xxhash", exclude_path: str | None = None, hardlink_is_unique: bool = False) -> DataFrame:
    """``path, n``: verified duplicates of each existing member; hard links count unless they are held to be unique.

    Counts of the set's files by digest, by inode and by both stand in for pairs. A file's duplicates are those of its digest less those that are its
    own inode, and its hard links those of its inode less itself.
    """
    m = settled(members(sets).select("id", "path"), "members")
    info = m.join(current(now, m, alg), "path")
    here = info.withColumn("counts", (~excluded(F.col("path"), exclude_path)).cast("long"))
    cells = here.groupBy("id", "hash", "dev", "inode").agg(F.sum("counts").alias("both"))
    equal = cells.filter(F.col("hash").isNotNull()).groupBy("id", "hash").agg(F.sum("both").alias("equal"))
    linked = cells.groupBy("id", "dev", "inode").agg(F.sum("both").alias("linked"))
    # One row for each inode and digest of a set, then back to the paths.
    per = cells.join(equal, ["id", "hash"], "left").join(linked, ["id", "dev", "inode"])
    same = F.coalesce(F.col("equal") - F.col("both"), F.lit(0))
    per = per.select("id", "dev", "inode", F.col("hash").alias("h"), same.alias("same"), "linked")
    rows = here.join(per, ["id", "dev", "inode"]).filter(F.col("hash").eqNullSafe(F.col("h")))
    links = F.lit(0) if hardlink_is_unique else F.col("linked") - F.col("counts")
    return rows.select("path", (F.col("same") + links).alias("n"))


def _tree(now: DataFrame, path: str | list[str] | None) -> DataFrame:
    roots = [path] if isinstance(path, str) else path or []
    here = present(now)
    for_any = None
    for r in roots:
        c = under(F.col("path"), r)
        for_any = c if for_any is None else for_any | c
    return here if for_any is None else here.filter(for_any)


def listing(sets: DataFrame, now: DataFrame, path: str | list[str] | None = None, alg: str = "xxhash", exclude_path: str | None = None, hardlink_is_unique: bool = False) -> DataFrame:
    """``path, label, n_duplicates`` of every file of the tree; files that no set knows are unique."""
    files = _tree(now, path).select("path")
    if path:  # only sets of the files asked about are looked at
        m = settled(members(sets), "members")
        sets = m.join(m.join(files, "path", "left_semi").select("id").distinct(), "id", "left_semi")
    counts = duplicate_counts(sets, now, alg, exclude_path, hardlink_is_unique)
    out = files.join(counts, "path", "left").withColumn("n_duplicates", F.coalesce("n", F.lit(0)))
    return out.select("path", F.when(F.col("n_duplicates") > 0, "DUPLICATE").otherwise("UNIQUE").alias("label"), "n_duplicates")


def dups(sets: DataFrame, now: DataFrame, path: str | list[str] | None = None, **options) -> DataFrame:
    return listing(sets, now, path, **options).filter("label = 'DUPLICATE'").select("path")


def uniques(sets: DataFrame, now: DataFrame, path: str | list[str] | None = None, **options) -> DataFrame:
    return listing(sets, now, path, **options).filter("label = 'UNIQUE'").select("path")


def file_status(sets: DataFrame, now: DataFrame, path: str, alg: str = "xxhash", exclude_path: str | None = None) -> DataFrame:
    """Every candidate of one file with its status."""
    return verified_pairs(sets, now, alg, sets.sparkSession.createDataFrame([(path,)], "path string"), exclude_path)


def file_in_store(store: DuplicateStore, now: DataFrame, path: str, alg: str = "xxhash", exclude_path: str | None = None) -> DataFrame:
    """``file_status`` by point reads: the store's index gives the sets of the path, their members are read from their buckets, and only these files are digested."""
    return file_status(store.candidates([path]), now, path, alg, exclude_path)


def listing_lines(labels: DataFrame, both: bool = True, prefix: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """``path, n, line``: what ls (``both`` labels, which are then written before the path), dups or uniques print; order by path and n.

    ``prefix`` is cut from paths that begin with it. ``pairs``, from ``verified_pairs`` for the same paths, adds a line for each candidate with its status.
    """
    shown = cut(F.col("path"), prefix)
    label = F.when(F.col("label") == "UNIQUE", "   UNIQUE: ").otherwise("DUPLICATE: ") if both else F.lit("")
    out = labels.select("path", F.lit("").alias("n"), F.concat(label, shown).alias("line"))
    if pairs is not None:
        status = F.rpad("status", 3, " ")
        more = pairs.join(labels.select("path"), "path", "left_semi")
        out = out.unionByName(more.select("path", F.col("candidate").alias("n"), F.concat(F.lit("             "), status, F.lit(": "), cut(F.col("candidate"), prefix)).alias("line")))
    return out


def validate(sets: DataFrame, now: DataFrame, alg: str = "xxhash") -> DataFrame:
    """``id, path, count, n_ok, ok``: each set's first member against the others; a set is good when all others still equal it."""
    m = settled(members(sets).select("id", "each_size", "path"), "members")
    first = set_counts(m).select("id", "count", F.col("first").alias("path"))
    info = current(now, m, alg)
    p = first.join(info.select("path", F.col("dev").alias("p_dev"), F.col("inode").alias("p_inode"), F.col("hash").alias("p_hash")), "path", "left")
    c = m.select("id", F.col("path").alias("candidate")).join(info.select(F.col("path").alias("candidate"), F.col("dev").alias("c_dev"), F.col("inode").alias("c_inode"), F.col("hash").alias("c_hash")), "candidate", "left")
    rows = p.join(c, "id").filter("path <> candidate")
    good = status_of().isin(STATUS["duplicate"], STATUS["hardlink"]) & F.col("p_inode").isNotNull()
    out = rows.groupBy("id", "path", "count").agg(F.sum(good.cast("long")).alias("n_ok"))
    return out.withColumn("ok", F.col("n_ok") == F.col("count") - 1)
