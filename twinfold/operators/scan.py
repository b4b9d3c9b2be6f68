"""The scan: one narrow table of sizes and digests, grouped.

Contents are never shuffled. Content in a column is read once, in a projection that keeps its size and digest; ``column_rounds`` asks for prefix rounds there too, which read it twice: once for the
digests of all prefixes, kept as narrow columns, once for the digests of what is left. Files on disk are walked once and staged as rows of sizes; sizes that occur once are dropped
before anything is opened, each prefix round opens each surviving file once and is staged, a file no longer than the prefix is done with it, and only files that still share
their prefixes are read whole, large ones by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from twinfold.functions.hashing import digest, hash_files
from twinfold.functions.paths import hidden
from twinfold.model import SEPARATOR, Options
from twinfold.operators.membership import bloom, kept, marked, words_for
from twinfold.operators.ranges import RANGE, tree_digests
from twinfold.plans.staging import stage

#: What a scan carries of a file besides its digest.
NARROW = ("path", "size", "dev", "inode", "ctime")
#: Bytes and files that one task reads, and most tasks.
TASK_BYTES, TASK_FILES, TASKS = 512_000_000, 20_000, 100_000


def in_columns(files: DataFrame) -> bool:
    """Whether contents, or the digests that a scan has made of them, are in a column, not on disk."""
    return "content" in files.columns or "hash" in files.columns


def accepted(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Regular files that take part: size, name and kind filters."""
    out = files.filter((F.col("kind") == "file") & (F.col("size") >= options.min_size))
    if options.skip_separator:
        out = out.filter(~F.col("name").contains(SEPARATOR))
    if not options.hidden:
        out = out.filter(~hidden(F.expr("substring(path, length(root) + if(root = '/', 1, 2))")))
    return out


def size_groups(files: DataFrame) -> DataFrame:
    """``size, count`` of the sizes that two files or more have."""
    return files.groupBy("size").agg(F.count("*").alias("count")).filter("count > 1")


def shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys another row has too; ``rows`` are narrow. Counts are combined before they are shuffled, and a semi-join can be split where a key is hot."""
    more = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)
    return rows.join(more, list(keys), "left_semi")


def same_size(files: DataFrame) -> DataFrame:
    """``path, size, dev, inode, ctime`` of files whose size is not unique."""
    return shared(files.select(*NARROW), "size")


def drop_hard_links(rows: DataFrame) -> DataFrame:
    """Of each (device, inode) the row with the first path; ``rows`` are narrow."""
    rest = [c for c in rows.columns if c not in ("dev", "inode")]
    first = rows.groupBy("dev", "inode").agg(F.min_by(F.struct(*rest), "path").alias("_row"))
    return first.select(*(F.col(c) if c in ("dev", "inode") else F.col(f"_row.{c}").alias(c) for c in rows.columns))


def prefix_digests(files: DataFrame, alg: str, most: int, skip: int = 0) -> DataFrame:
    """Narrow rows with ``hash``, the digest of ``most`` bytes after the first ``skip``; unreadable files are dropped."""
    if in_columns(files):
        out = files.select(*NARROW, digest(alg, F.substring("content", skip + 1, most)).alias("hash"))
    else:
        out = hash_files(files.select(*NARROW), alg, most, skip)
    return out.filter(F.col("hash").isNotNull())


def same_prefix(files: DataFrame, alg: str, most: int) -> DataFrame:
    """Narrow rows of the files that share size and the digest of the first ``most`` bytes with another."""
    return shared(prefix_digests(files, alg, most), "size", "hash").drop("hash")


def computed(files: DataFrame, alg: str) -> DataFrame:
    """Narrow rows with the ``hash`` of the whole content; null where it cannot be read. Rows of files on disk should be staged, as they are gone through by size."""
    if "hash" in files.columns:  # by ``scanned``
        return files.select(*NARROW, "hash")
    return files.select(*NARROW, digest(alg, F.col("content")).alias("hash")) if in_columns(files) else disk_digests(files.select(*NARROW), alg)


def disk_digests(rows: DataFrame, alg: str, span: int = RANGE) -> DataFrame:
    """Narrow rows of files on disk with ``hash``: of the whole bytes up to a range's, beyond that the fold of the ranges' digests, which are read in any task."""
    large = rows.filter(F.col("size") > span)
    small = hash_files(spread(rows.filter(F.col("size") <= span)), alg)
    return small if large.isEmpty() else small.unionByName(tree_digests(large, alg, span))


def served_by(files: DataFrame, cache: DataFrame, alg: str, cache_min_size: int = 0) -> DataFrame:
    """Narrow rows with ``hash`` of the files in size groups that a cache serves whole."""
    known = cache.filter((F.col("alg") == alg) & (F.col("size") > cache_min_size)).select("path", "size", "ctime", "hash")
    hits = files.select(*NARROW).join(known, ["path", "size", "ctime"], "left").select(*NARROW, "hash")
    whole = hits.groupBy("size").agg(F.bool_and(F.col("hash").isNotNull()).alias("whole")).filter("whole").select("size")
    return hits.join(whole, "size", "left_semi")


def beside_cache(files: DataFrame, alg: str, served: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Narrow rows with ``hash`` of the files with content in a column that are not ``served`` (staged).

    A membership filter of the served files stands beside the contents, so theirs are not digested and none moves. Files that pass the filter without being served are found on narrow rows
    and digested by themselves. ``observation`` counts contents ``digested`` and ``spared`` in the first pass.
    """
    key = ("path", "size", "ctime")
    if "hash" in files.columns:
        return computed(files, alg).join(served.select("path"), "path", "left_anti")
    if (words := words_for(served.count())) is None:
        return computed(files, alg).join(served.select("path"), "path", "left_anti")
    filter_ = stage(bloom(served, words, *key), "filter")
    rows = marked(files, filter_, words, *key).select(*NARROW, "maybe", F.when(~F.col("maybe"), digest(alg, F.col("content"))).alias("hash"))
    if observation is not None:
        rows = rows.observe(observation, F.count_if(~F.col("maybe")).alias("digested"), F.count_if("maybe").alias("spared"))
    first = rows.filter(~F.col("maybe")).drop("maybe")
    again = stage(marked(files.select(*NARROW), filter_, words, *key).filter("maybe").drop("maybe").join(served.select("path"), "path", "left_anti"), "again")
    return first if again.isEmpty() else first.unionByName(computed(kept(files, again, "path"), alg).join(again.select("path"), "path", "left_semi"))


def hashed(files: DataFrame, alg: str, cache: DataFrame | None = None, cache_min_size: int = 0, observation: Observation | None = None) -> DataFrame:
    """Narrow rows with ``hash``: from a cache where a size group is wholly in it, else computed. Unreadable files are dropped; what the cache serves is not digested."""
    if cache is None:
        return computed(files, alg).filter(F.col("hash").isNotNull())
    if not in_columns(files):
        files = stage(files.select(*NARROW), "files")
    served = stage(served_by(files, cache, alg, cache_min_size), "served")
    rest = beside_cache(files, alg, served, observation) if in_columns(files) else computed(files.join(served.select("path"), "path", "left_anti"), alg)
    return served.unionByName(rest).filter(F.col("hash").isNotNull())


def spread(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Narrow rows of files dealt to as many tasks as the bytes that will be read of them, or their number, ask for."""
    size = F.col("size") if most is None else F.least("size", F.lit(most))
    t = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return rows.repartition(min(TASKS, max(1, -(-t["bytes"] // TASK_BYTES), -(-t["n"] // TASK_FILES))))


def _on_disk(f: DataFrame, options: Options, cache: DataFrame | None, every: bool = False) -> DataFrame:
    """Narrow rows with the ``hash`` of each file that may have a duplicate: the size, prefix and whole-file rounds, each staged.

    ``every``: rows of all files of shared sizes, as the statistics need them: one that a round tells apart has that round's digest, one that cannot be read has none.
    """
    f = stage(f.select(*NARROW), "files")
    f = shared(f, "size")
    if options.hardlink_is_unique:
        f = drop_hard_links(f) if every else shared(drop_hard_links(f), "size")
    done = []
    if cache is not None:
        done.append(stage(served_by(f, cache, options.alg, options.cache_min_size), "served"))
        f = f.join(done[0].select("path"), "path", "left_anti")
    for most in sorted(options.prefixes):
        read = stage(hash_files(spread(f, most), options.alg, most), f"prefix{most}")
        done.append(read.filter(F.col("hash").isNotNull() & (F.col("size") <= most)))
        more = read.filter(F.col("hash").isNotNull() & (F.col("size") > most))
        f = shared(more, "size", "hash").drop("hash")
        if every:
            done += [read.filter(F.col("hash").isNull()), more.join(f.select("path"), "path", "left_anti")]
    out = stage(computed(f, options.alg), "whole")
    for part in done:
        out = out.unionByName(part)
    return out if every else out.filter(F.col("hash").isNotNull())


def _column_rounds(f: DataFrame, options: Options) -> DataFrame:
    """As ``_on_disk`` for contents in a column: one pass for all prefixes, the rounds on their digests, one pass for what is left."""
    order = sorted(options.prefixes)
    left = stage(f.filter(F.col("content").isNotNull()).select(*NARROW, *(digest(options.alg, F.substring("content", 1, p)).alias(f"prefix{p}") for p in order)), "prefixes")
    left = shared(left, "size")
    if options.hardlink_is_unique:
        left = shared(drop_hard_links(left), "size")
    done = []
    for p in order:
        done.append(left.filter(F.col("size") <= p).select(*NARROW, F.col(f"prefix{p}").alias("hash")))
        left = shared(left.filter(F.col("size") > p), "size", f"prefix{p}")
    left = stage(left.select(*NARROW), "left")
    out = computed(kept(f, left, "path"), options.alg).join(left.select("path"), "path", "left_semi")
    for part in done:
        out = out.unionByName(part)
    return out


def scanned(files: DataFrame, options: Options = Options(), cache: DataFrame | None = None) -> DataFrame:
    """FILES rows, staged, with ``hash`` in place of content: one read for the sets, the statistics and what else a scan is asked for, which then take these rows as ``files``.

    Files of a size of their own are not opened on disk, nor digested any further than rounds need; they have no hash, and no one asks for it.
    """
    names = [c for c in files.columns if c not in ("content", "hash")]
    if "content" in files.columns:
        takes_part = F.coalesce((F.col("kind") == "file") & (F.col("size") >= options.min_size), F.lit(False))
        if cache is None or not options.use_cache:
            return stage(files.select(*names, F.when(takes_part, digest(options.alg, F.col("content"))).alias("hash")), "scanned")
        rows = hashed(accepted(files, options), options.alg, cache, options.cache_min_size)
        return stage(files.select(*names).join(rows.select("path", "hash"), "path", "left"), "scanned")
    seen = stage(files.select(*names), "seen")
    rows = _on_disk(accepted(seen, options), options, cache if options.use_cache else None, every=True)
    return stage(seen.join(rows.select("path", "hash"), "path", "left"), "scanned")


def candidates(files: DataFrame, options: Options = Options(), cache: DataFrame | None = None) -> DataFrame:
    """Narrow rows with ``hash`` of all files that may be in a duplicate set."""
    f, cache = accepted(files, options), cache if options.use_cache else None
    if not in_columns(files):
        return _on_disk(f, options, cache)
    if options.column_rounds and options.prefixes and cache is None:
        return _column_rounds(f, options)
    rows = hashed(f, options.alg, cache, options.cache_min_size)
    return drop_hard_links(rows) if options.hardlink_is_unique else rows


def set_id() -> Column:
    return F.xxhash64("size", "hash")


def duplicate_members(files: DataFrame, options: Options = Options(), cache: DataFrame | None = None) -> DataFrame:
    """``id, each_size, path``: a row for each member of a set of two or more files with equal content, however large the set."""
    return shared(candidates(files, options, cache), "size", "hash").select(set_id().alias("id"), F.col("size").alias("each_size"), "path")


def as_sets(rows: DataFrame) -> DataFrame:
    """``id, count, each_size, paths`` of membership rows, a row for each set of two or more; for reports and exchange, as a set's paths are held together."""
    out = rows.groupBy("id", "each_size").agg(F.count("*").cast("int").alias("count"), F.array_sort(F.collect_list("path")).alias("paths"))
    return out.filter("count > 1").select("id", "count", "each_size", "paths")


def set_counts(rows: DataFrame) -> DataFrame:
    """``id, each_size, count, first`` of membership rows, without their paths."""
    return rows.groupBy("id", "each_size").agg(F.count("*").cast("int").alias("count"), F.min("path").alias("first")).filter("count > 1")


def duplicate_sets(files: DataFrame, options: Options = Options(), cache: DataFrame | None = None) -> DataFrame:
    """``id, count, each_size, paths``: sets of two or more files with equal content."""
    return as_sets(candidates(files, options, cache).select(set_id().alias("id"), F.col("size").alias("each_size"), "path"))


def members(sets: DataFrame) -> DataFrame:
    """``id, each_size, path``: one row for each member of each set; membership rows stay as they are."""
    return sets.select("id", "each_size", F.explode("paths").alias("path")) if "paths" in sets.columns else sets.select("id", "each_size", "path")


def singles(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``path, size`` of files whose size is shared but whose content is not."""
    rows = hashed(accepted(files, options) if in_columns(files) else stage(same_size(accepted(files, options)), "same_size"), options.alg)
    groups = rows.groupBy("size", "hash").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return groups.filter("n = 1").join(size_groups(rows).select("size"), "size", "left_semi").select("path", "size")


def cache_served_groups(files: DataFrame, cache: DataFrame, alg: str, cache_min_size: int) -> DataFrame:
    """``size, count, served`` of the size groups that a cache can serve whole, with the files that it serves."""
    f = same_size(files)
    known = cache.filter((F.col("alg") == alg) & (F.col("size") > cache_min_size)).select("path", "size", "ctime", F.lit(True).alias("hit"))
    return f.join(known, ["path", "size", "ctime"], "left").groupBy("size").agg(F.count("*").alias("count"), F.bool_and(F.coalesce("hit", F.lit(False))).alias("whole")).filter("whole").select("size", "count")


def statistics(files: DataFrame, options: Options = Options(), cache: DataFrame | None = None) -> DataFrame:
    """One row: what the scan saw, skipped, found, could not read and took from a cache. Given the rows of ``scanned``, nothing is read or digested again.

    ``consistent``: accepted files are as many as those alone in their size, left out as hard links, in a set, unlike all others, or unreadable, each counted by itself.
    """
    kind, size = F.col("kind"), F.col("size")
    count_if = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    narrow = [c for c in files.columns if c not in ("content", "hash")]
    if not options.hidden:  # as in a walk, which does not see them
        files = files.filter(~hidden(F.expr("substring(path, length(root) + if(root = '/', 1, 2))")))
    if not in_columns(files):  # the tree is walked once for all counts
        files = stage(files.select(*narrow), "seen")
    small = (kind == "file") & (size < options.min_size)
    seen = files.select(*narrow).agg(F.count("*").alias("files_seen"), count_if(small).alias("too_small"), count_if(kind == "other").alias("not_file"), count_if((kind == "error") | ((kind == "file") & size.isNull())).alias("errors"), count_if(kind == "badsep").alias("bad_separator"), count_if((kind == "file") & ~small & size.isNotNull()).alias("accepted"))
    f = accepted(files, options)
    sizes = f.groupBy("size").agg(F.count("*").alias("n"))
    own = sizes.agg(count_if(F.col("n") > 1).alias("size_sets"), total(F.when(F.col("n") > 1, F.col("n"))).alias("processed"), count_if(F.col("n") == 1).alias("unique_by_size"), total("n").alias("in_sizes"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest_size_group"), F.max_by("size", F.struct("n", F.negative("size"))).alias("largest_size_group_size"))
    links = same_size(f).agg((F.count("*") - F.count_distinct("dev", "inode")).alias("hard_links_skipped" if options.hardlink_is_unique else "hard_links"))
    # Unreadable files have no digest; each file of a shared size that has one is in a set or alone.
    rows = computed(f if in_columns(files) else same_size(f), options.alg).join(sizes.filter("n > 1").select("size"), "size", "left_semi")
    if options.hardlink_is_unique:
        rows = drop_hard_links(rows)
    groups = rows.groupBy("size", "hash").agg(F.count("*").alias("n"))
    ok = F.col("hash").isNotNull()
    found = groups.agg(total(F.when(ok & (F.col("n") > 1), F.col("n"))).alias("duplicate_files"), count_if(ok & (F.col("n") > 1)).alias("duplicate_groups"), F.coalesce(F.max(F.when(ok & (F.col("n") > 1), F.col("n"))), F.lit(0)).cast("long").alias("largest_set"), count_if(ok & (F.col("n") == 1)).alias("unique_files"), total(F.when(~ok, F.col("n"))).alias("unreadable"))
    out = seen.join(own).join(links).join(found)  # one-row tables
    if cache is not None:
        out = out.join(cache_served_groups(f, cache, options.alg, options.cache_min_size).agg(F.count("*").alias("size_list_done_from_cache"), total("count").alias("files_done_from_cache")))
    skipped = F.col("hard_links_skipped") if options.hardlink_is_unique else F.lit(0)
    sums = F.col("unique_by_size") + skipped + F.col("duplicate_files") + F.col("unique_files") + F.col("unreadable")
    return out.withColumn("consistent", (F.col("accepted") == F.col("in_sizes")) & (F.col("accepted") == sums)).drop("in_sizes")


def stats_lines(stats: DataFrame) -> DataFrame:
    """``key value`` lines of a statistics row."""
    return stats.select(F.explode(F.array(*(F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in stats.columns))).alias("line"))


def append_stats(stats: DataFrame, out: str) -> None:
    """Append the lines of a statistics row to the text table ``out``."""
    stats_lines(stats).coalesce(1).write.mode("append").text(out)
