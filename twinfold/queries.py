"""Registered queries of the duplicate engine, each with its DuckDB SQL.

They run over ``documents`` by the corpus adapter. Lists are joined with ``|`` so that values compare as plain strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import hashing, paths
from twinfold.model import Options
from twinfold.operators import classes, maintain, ranges, scan, verify
from twinfold.plans import report
from twinfold.plans.staging import place
from twinfold.plans.store import DuplicateStore, HashCache, from_delimited, to_delimited
from twinfold.sources.corpus import document_files

ALL = Options(alg="md5", hidden=True, prefixes=())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FILES = """WITH files AS (
  SELECT *, CAST(octet_length(encode(content)) AS BIGINT) AS size, md5(content) AS h FROM (
    SELECT doc_id, '/' || source || '/' || CASE WHEN lang = 'de' THEN '.de' ELSE lang END || '/' || doc_id || '.txt' AS path, text AS content,
           min(doc_id) OVER (PARTITION BY text, doc_id % 2) AS inode FROM documents)),
sets AS (SELECT size, h, count(*) AS n, min(path) AS kept, string_agg(path, '|' ORDER BY path) AS paths FROM files WHERE size >= 1 GROUP BY size, h HAVING count(*) > 1),
m AS (SELECT s.kept, s.n, f.* FROM files f JOIN sets s USING (size, h)),
now AS (SELECT path, inode, CASE WHEN doc_id % 7 = 0 THEN content || 'x' ELSE content END AS c FROM files WHERE doc_id % 5 <> 0),
pairs AS (SELECT a.path, b.path AS candidate, na.inode AS ai, nb.inode AS bi, na.c AS ac, nb.c AS bc, nb.path IS NULL AS gone
          FROM m a JOIN m b ON a.kept = b.kept AND a.size = b.size AND a.path <> b.path JOIN now na ON na.path = a.path LEFT JOIN now nb ON nb.path = b.path),
stat AS (SELECT path, candidate, CASE WHEN gone THEN '---' WHEN ai = bi THEN 'HL' WHEN ac = bc THEN 'DUP' ELSE '---' END AS status FROM pairs)
"""


def query(sql: str | None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = _FILES + sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files(spark: SparkSession, sf_dir: str, hard_links: bool = False) -> DataFrame:
    return document_files(docs(spark, sf_dir), hard_links)


def sets(spark: SparkSession, sf_dir: str, options: Options = ALL) -> DataFrame:
    return scan.duplicate_sets(files(spark, sf_dir), options)


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after some documents vanished and some changed; inodes stay those of the original contents."""
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return document_files(docs(spark, sf_dir).filter(F.col("doc_id") % 5 != 0), True, changed)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership rows of the corpus."""
    return scan.duplicate_members(files(spark, sf_dir), ALL)


def flat(s: DataFrame) -> DataFrame:
    return s.select("each_size", "count", F.array_join("paths", "|").alias("paths"))


_FLAT = "SELECT size AS each_size, CAST({n} AS INTEGER) AS count, {paths} AS paths FROM "


@query("SELECT path, size, CAST(inode AS BIGINT) AS inode FROM files")
def tree_scan(spark, sf_dir):
    # The adapter's inode is a hash; for the SQL it is named by the smallest document that shares it.
    f = files(spark, sf_dir, True).select("path", "size", "inode", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("id"))
    return f.join(f.groupBy("inode").agg(F.min("id").alias("first")), "inode").select("path", "size", F.col("first").alias("inode"))


@query("SELECT path FROM files WHERE starts_with(path, '/src1/') OR starts_with(path, '/src2/')")
def scan_multi_root(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.filter(paths.under(F.col("path"), "/src1")).unionByName(f.filter(paths.under(F.col("path"), "/src2"))).select("path")


@query("SELECT path FROM files WHERE path NOT LIKE '%/.%' AND size >= 1")
def hidden_filter(spark, sf_dir):
    return scan.accepted(files(spark, sf_dir)).select("path")


@query("SELECT path, size FROM files WHERE size >= 2000")
def minsize_scan(spark, sf_dir):
    return scan.accepted(files(spark, sf_dir), Options(min_size=2000, hidden=True)).select("path", "size")


@query("SELECT size, count(*) AS count FROM files GROUP BY size HAVING count(*) > 1")
def size_groups(spark, sf_dir):
    return scan.size_groups(files(spark, sf_dir))


@query("SELECT min(path) AS path, size FROM files GROUP BY size HAVING count(*) = 1")
def unique_by_size(spark, sf_dir):
    return files(spark, sf_dir).groupBy("size").agg(F.min("path").alias("path"), F.count("*").alias("n")).filter("n = 1").select("path", "size")


@query("SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size, substr(hex(encode(content)), 1, 512)) AS n FROM files) WHERE n > 1")
def prefix_groups(spark, sf_dir):
    return scan.same_prefix(scan.accepted(files(spark, sf_dir), ALL), "md5", 256).select("path", "size")


_SETS = _FLAT.format(n="n", paths="paths") + "sets"


@query(_SETS)
def dup_sets(spark, sf_dir):
    return flat(sets(spark, sf_dir))


@query(_SETS)
def dup_sets_staged(spark, sf_dir):
    return flat(sets(spark, sf_dir, Options(hidden=True, prefixes=(256, 4096), column_rounds=True)))


for _alg in ("md5", "sha1", "sha512", "xxhash"):
    query(_SETS, f"dup_sets_{_alg}")(lambda spark, sf_dir, alg=_alg: flat(sets(spark, sf_dir, Options(alg=alg, hidden=True, prefixes=()))))


@query("SELECT size AS each_size, CAST(count(*) AS INTEGER) AS count, string_agg(path, '|' ORDER BY path) AS paths FROM files WHERE path NOT LIKE '%/.%' GROUP BY size, h HAVING count(*) > 1")
def dup_sets_visible(spark, sf_dir):
    return flat(sets(spark, sf_dir, Options(alg="md5", prefixes=())))


@query("SELECT path, md5(content) AS digest FROM files")
def digest_md5(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.lower(F.hex(hashing.digest("md5", F.col("content")))).alias("digest"))


@query("SELECT path, sha1(content) AS digest FROM files")
def digest_sha1(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.lower(F.hex(hashing.digest("sha1", F.col("content")))).alias("digest"))


@query("SELECT path || ': ' || regexp_replace(md5(content), '(..)', '\\1 ', 'g') AS line FROM files")
def hash_dump(spark, sf_dir):
    return files(spark, sf_dir).select(hashing.dump(F.col("path"), hashing.digest("md5", F.col("content"))).alias("line"))


@query("SELECT min(path) AS path, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1) GROUP BY size, h HAVING count(*) = 1")
def skim_uniques(spark, sf_dir):
    return scan.singles(files(spark, sf_dir), ALL)


@query("""SELECT size AS each_size, CAST(count(*) AS INTEGER) AS count, string_agg(path, '|' ORDER BY path) AS paths
FROM (SELECT inode, size, h, min(path) AS path FROM files GROUP BY inode, size, h) GROUP BY size, h HAVING count(*) > 1""")
def hardlink_unique_scan(spark, sf_dir):
    return flat(scan.duplicate_sets(files(spark, sf_dir, True), Options(alg="md5", hidden=True, prefixes=(), hardlink_is_unique=True)))


_TOTALS = "(SELECT n * size AS total, size AS each_size, string_split(paths, '|') AS p FROM sets)"


@query(f"SELECT total, each_size, total || ' total bytes used by duplicates of size ' || each_size || ':' || chr(10) || array_to_string(list_transform(p, lambda x: '  ' || x), chr(10)) || chr(10) || chr(10) AS entry FROM {_TOTALS}", "report_text")
def report_text(spark, sf_dir):
    return report.rendered(sets(spark, sf_dir), "text")


@query(f"SELECT total, each_size, total || ',' || each_size || ',' || array_to_string(list_transform(p, lambda x: '\"' || replace(x, '\"', '\"\"') || '\"'), ',') AS entry FROM {_TOTALS}")
def report_csv(spark, sf_dir):
    return report.rendered(sets(spark, sf_dir), "csv")


@query(f"SELECT total, each_size, '[ ' || total || ', ' || each_size || ', ' || array_to_string(list_transform(p, lambda x: '\"' || x || '\"'), ', ') || ' ]' AS entry FROM {_TOTALS}")
def report_json(spark, sf_dir):
    return report.rendered(sets(spark, sf_dir), "json")


@query(f"SELECT total, each_size, total || ',' || each_size || ',' || array_to_string(list_transform(p, lambda x: '\"' || CASE WHEN starts_with(x, '/src1') THEN substr(x, 6) ELSE x END || '\"'), ',') AS entry FROM {_TOTALS}")
def report_cut(spark, sf_dir):
    return report.rendered(sets(spark, sf_dir), "csv", prefix="/src1")


@query("SELECT n * size AS total, size AS each_size, CAST(n AS INTEGER) AS count, paths FROM sets WHERE n * size >= 5000")
def report_minsize(spark, sf_dir):
    return report.totals(sets(spark, sf_dir), 5000).withColumn("paths", F.array_join("paths", "|"))


@query("SELECT CAST(b AS BIGINT) AS bytes, CAST(b // 1024 AS BIGINT) AS kib, CAST(b // 1024 // 1024 AS BIGINT) AS mib, CAST(b // 1024 // 1024 // 1024 AS BIGINT) AS gib FROM (SELECT coalesce(sum(n * size), 0) AS b FROM sets)")
def report_total(spark, sf_dir):
    return report.grand_total(sets(spark, sf_dir))


@query("SELECT n * size AS total, size AS each_size, CAST(n AS INTEGER) AS count, paths FROM sets ORDER BY total DESC, each_size DESC, kept LIMIT 10")
def worst_offenders(spark, sf_dir):
    return report.worst(sets(spark, sf_dir)).withColumn("paths", F.array_join("paths", "|"))


@query("SELECT CAST(max(n) AS INTEGER) AS largest, count(*) AS n_sets, CAST(sum(n) AS BIGINT) AS n_files FROM sets")
def largest_set(spark, sf_dir):
    return sets(spark, sf_dir).agg(F.max("count").alias("largest"), F.count("*").alias("n_sets"), F.sum("count").alias("n_files"))


_LISTING = "(SELECT n.path, CAST(coalesce(sum(CASE WHEN s.status IN ({counted}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_duplicates FROM now n LEFT JOIN stat s USING (path) GROUP BY n.path)"
_LS = "SELECT path, CASE WHEN n_duplicates > 0 THEN 'DUPLICATE' ELSE 'UNIQUE' END AS label, n_duplicates FROM " + _LISTING.format(counted="'DUP', 'HL'")


@query(_LS)
def ls(spark, sf_dir):
    return verify.listing(rows(spark, sf_dir), now(spark, sf_dir), alg="md5")


@query(_LS + " WHERE starts_with(path, '/src1/')")
def ls_path(spark, sf_dir):
    return verify.listing(rows(spark, sf_dir), now(spark, sf_dir), "/src1", alg="md5")


@query(f"SELECT path FROM ({_LS}) WHERE label = 'DUPLICATE'")
def dups(spark, sf_dir):
    return verify.dups(rows(spark, sf_dir), now(spark, sf_dir), alg="md5")


@query(f"SELECT path FROM ({_LS}) WHERE label = 'UNIQUE'")
def uniques(spark, sf_dir):
    return verify.uniques(rows(spark, sf_dir), now(spark, sf_dir), alg="md5")


@query("SELECT path FROM " + _LISTING.format(counted="'DUP'") + " WHERE n_duplicates = 0")
def verify_hardlink_unique(spark, sf_dir):
    return verify.uniques(rows(spark, sf_dir), now(spark, sf_dir), alg="md5", hardlink_is_unique=True)


@query("SELECT path, candidate, status FROM stat")
def verify_status(spark, sf_dir):
    return verify.verified_pairs(rows(spark, sf_dir), now(spark, sf_dir), "md5")


@query("SELECT path, candidate, CASE WHEN starts_with(candidate, '/src1/') THEN 'xxx' ELSE status END AS status FROM stat")
def verify_exclude(spark, sf_dir):
    return verify.verified_pairs(rows(spark, sf_dir), now(spark, sf_dir), "md5", exclude_path="/src1")


@query("SELECT path, candidate, status FROM stat WHERE path = (SELECT min(path) FROM m WHERE path IN (SELECT path FROM now))")
def file_lookup(spark, sf_dir):
    s, n = rows(spark, sf_dir), now(spark, sf_dir)
    first = scan.members(s).select("path").join(n.select("path"), "path", "left_semi").agg(F.min("path").alias("path"))
    return verify.verified_pairs(s, n, "md5", first)


@query("SELECT size AS each_size, CAST(count(*) AS INTEGER) AS count, string_agg(path, '|' ORDER BY path) AS paths FROM m WHERE path IN (SELECT path FROM now) GROUP BY size, h HAVING count(*) > 1")
def refresh(spark, sf_dir):
    return flat(maintain.refresh(sets(spark, sf_dir), now(spark, sf_dir)))


_VALID = """(SELECT m.kept AS path, CAST(m.n AS INTEGER) AS count, CAST(sum(CASE WHEN m.path <> m.kept AND a.path IS NOT NULL AND b.path IS NOT NULL AND (a.inode = b.inode OR a.c = b.c) THEN 1 ELSE 0 END) AS BIGINT) AS n_ok
FROM m LEFT JOIN now a ON a.path = m.kept LEFT JOIN now b ON b.path = m.path GROUP BY m.kept, m.n, m.size, m.h)"""


@query(f"SELECT path, count, n_ok, n_ok = count - 1 AS ok FROM {_VALID}")
def validate(spark, sf_dir):
    return verify.validate(rows(spark, sf_dir), now(spark, sf_dir), "md5").drop("id")


@query(f"SELECT count(*) AS n_sets, CAST(sum(CASE WHEN n_ok = count - 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_errors FROM {_VALID}")
def validate_errors(spark, sf_dir):
    v = verify.validate(rows(spark, sf_dir), now(spark, sf_dir), "md5")
    return v.agg(F.count("*").alias("n_sets"), F.sum((~F.col("ok")).cast("long")).alias("n_errors"))


_SCRIPT = "SELECT kept AS keeping, path, CASE WHEN path = kept THEN '# KEEPING: ' || path ELSE 'rm ''' || path || ''''{more} END AS line FROM m"


@query(_SCRIPT.format(more=""))
def rmsh(spark, sf_dir):
    return maintain.script(rows(spark, sf_dir))


@query(_SCRIPT.format(more=" || chr(10) || 'ln -s ''' || kept || ''' ''' || path || ''''"))
def rmsh_soft(spark, sf_dir):
    return maintain.script(rows(spark, sf_dir), "soft")


@query(_SCRIPT.format(more=" || chr(10) || 'ln ''' || kept || ''' ''' || path || ''''"))
def rmsh_hard(spark, sf_dir):
    return maintain.script(rows(spark, sf_dir), "hard")


def _cached(spark, sf_dir) -> DataFrame:
    """A cache of two thirds of the files, some entries of an earlier state."""
    d = files(spark, sf_dir).withColumn("id", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long"))
    size = F.when(F.col("id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size"))
    return d.filter("id % 3 <> 0").select("path", size.alias("size"), "ctime", F.lit("md5").alias("alg"), hashing.digest("md5", F.col("content")).alias("hash"))


@query("SELECT path, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'file_not_present' ELSE 'hash_found' END AS result FROM files")
def cache_lookup(spark, sf_dir):
    return maintain.looked_up(files(spark, sf_dir).drop("content"), _cached(spark, sf_dir), "md5").select("path", "result")


@query("SELECT path, 'hash_not_present' AS result FROM files WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0")
def cache_lookup_other_alg(spark, sf_dir):
    return maintain.looked_up(files(spark, sf_dir).drop("content"), _cached(spark, sf_dir), "sha1").select("path", "result").filter("result <> 'file_not_present'")


@query("SELECT path, size FROM files WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0")
def cache_invalidate(spark, sf_dir):
    return maintain.valid_entries(_cached(spark, sf_dir), files(spark, sf_dir)).select("path", "size")


@query("SELECT size, count(*) AS count FROM files GROUP BY size HAVING count(*) > 1 AND bool_and(doc_id % 3 <> 0 AND doc_id % 4 <> 0)")
def cache_served_groups(spark, sf_dir):
    return scan.cache_served_groups(files(spark, sf_dir), _cached(spark, sf_dir), "md5", 0)


@query(_SETS)
def cache_served_sets(spark, sf_dir):
    return flat(scan.duplicate_sets(files(spark, sf_dir), Options(alg="md5", hidden=True, prefixes=(), cache_min_size=0), _cached(spark, sf_dir)))


@query("SELECT path, size, h AS hash FROM files")
def cache_upsert(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "size", "ctime", F.lit("md5").alias("alg"), hashing.digest("md5", F.col("content")).alias("hash"))
    return maintain.upserted(_cached(spark, sf_dir), f).select("path", "size", F.lower(F.hex("hash")).alias("hash"))


@query("""SELECT (SELECT count(*) FROM files) AS files_seen, (SELECT count(*) FROM files WHERE size < 100) AS too_small, 0::BIGINT AS not_file, 0::BIGINT AS errors, 0::BIGINT AS bad_separator,
(SELECT count(*) FROM files WHERE size >= 100) AS accepted, count(*) FILTER (k > 1) AS size_sets, CAST(sum(k) FILTER (k > 1) AS BIGINT) AS processed, count(*) FILTER (k = 1) AS unique_by_size,
max(k) AS largest_size_group, (SELECT size FROM files WHERE size >= 100 GROUP BY size ORDER BY count(*) DESC, size LIMIT 1) AS largest_size_group_size,
CAST((SELECT sum(k - i) FROM (SELECT count(*) AS k, count(DISTINCT inode) AS i FROM files WHERE size >= 100 GROUP BY size HAVING count(*) > 1)) AS BIGINT) AS hard_links,
(SELECT CAST(sum(n) AS BIGINT) FROM sets WHERE size >= 100) AS duplicate_files, (SELECT count(*) FROM sets WHERE size >= 100) AS duplicate_groups, (SELECT max(n) FROM sets WHERE size >= 100) AS largest_set,
CAST(sum(k) FILTER (k > 1) AS BIGINT) - (SELECT CAST(sum(n) AS BIGINT) FROM sets WHERE size >= 100) AS unique_files, 0::BIGINT AS unreadable,
(SELECT count(*) FROM (SELECT 1 FROM files WHERE size >= 100 GROUP BY size HAVING count(*) > 1 AND bool_and(doc_id % 3 <> 0 AND doc_id % 4 <> 0))) AS size_list_done_from_cache,
(SELECT CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM files WHERE size >= 100 GROUP BY size HAVING count(*) > 1 AND bool_and(doc_id % 3 <> 0 AND doc_id % 4 <> 0))) AS files_done_from_cache, true AS consistent
FROM (SELECT size, count(*) AS k FROM files WHERE size >= 100 GROUP BY size)""")
def scan_stats(spark, sf_dir):
    options = Options(alg="md5", min_size=100, hidden=True, prefixes=(), cache_min_size=0)
    return scan.statistics(scan.scanned(files(spark, sf_dir, True), options), options, _cached(spark, sf_dir))


@query("SELECT size AS each_size, CAST(count(*) AS INTEGER) AS count, string_agg(path, '|' ORDER BY path) AS paths FROM files WHERE doc_id % 11 <> 0 GROUP BY size, h HAVING count(*) > 1")
def unreadable(spark, sf_dir):
    f = files(spark, sf_dir)
    bad = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 11 == 0
    return flat(scan.duplicate_sets(f.withColumn("content", F.when(~bad, F.col("content"))), ALL))


@query("SELECT * FROM (SELECT min(path) OVER (PARTITION BY content) AS first, path, size FROM files WHERE size >= 1) WHERE path <> first")
def byte_compare(spark, sf_dir):
    return classes.byte_equal(files(spark, sf_dir))


@query("SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name FROM files")
def path_split(spark, sf_dir):
    return files(spark, sf_dir).select("path", "dir", "name")


@query("SELECT size AS each_size, path FROM m")
def set_members(spark, sf_dir):
    return rows(spark, sf_dir).select("each_size", "path")


@query("SELECT size, count(*) AS count FROM files GROUP BY size ORDER BY count DESC, size LIMIT 1")
def largest_size_group(spark, sf_dir):
    groups = scan.size_groups(files(spark, sf_dir)).agg(F.max(F.struct("count", F.negative("size").alias("less"))).alias("most"))
    return groups.select((-F.col("most.less")).alias("size"), F.col("most.count").alias("count"))


@query("SELECT path, md5(substr(regexp_replace(content, '[^\\x00-\\x7F]', '?', 'g'), 65, 128)) AS digest FROM files WHERE size >= 1")
def prefix_skip(spark, sf_dir):
    """Blocks after some are skipped; of texts, whose characters the SQL counts, so that content is in ASCII for both."""
    ascii_ = document_files(docs(spark, sf_dir), content=F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))
    return scan.prefix_digests(scan.accepted(ascii_, ALL), "md5", 128, 64).select("path", F.lower(F.hex("hash")).alias("digest"))


_LINES = "(SELECT path, '' AS n, CASE WHEN n_duplicates > 0 THEN 'DUPLICATE: ' ELSE '   UNIQUE: ' END || CASE WHEN starts_with(path, '/src1') THEN substr(path, 6) ELSE path END AS line FROM " + _LISTING.format(counted="'DUP', 'HL'") + ")"


@query(f"SELECT path, n, line FROM {_LINES} UNION ALL SELECT path, candidate, '             ' || rpad(status, 3, ' ') || ': ' || CASE WHEN starts_with(candidate, '/src1') THEN substr(candidate, 6) ELSE candidate END FROM stat")
def ls_details(spark, sf_dir):
    m, n = rows(spark, sf_dir), now(spark, sf_dir)
    return verify.listing_lines(verify.listing(m, n, alg="md5"), prefix="/src1", pairs=verify.verified_pairs(m, n, "md5"))


@query("""SELECT 1 AS part, n * size AS total, size AS each_size, kept AS first,
CASE WHEN row_number() OVER (ORDER BY n * size, size, kept) = 1 THEN '' ELSE ',' || chr(10) END || '[ ' || n * size || ', ' || size || ', "' || replace(paths, '|', '", "') || '" ]' AS value FROM sets
UNION ALL SELECT 0, 0, 0, '', '[' UNION ALL SELECT 2, 0, 0, '', ']'""")
def report_json_file(spark, sf_dir):
    return report.report_rows(sets(spark, sf_dir), "json")


@query("SELECT * FROM (SELECT min(path) OVER (PARTITION BY content) AS class, path, size, count(*) OVER (PARTITION BY content) AS n FROM files WHERE size >= 1) WHERE n > 1".replace("*", "class, path, size", 1))
def byte_classes(spark, sf_dir):
    """Files of equal size compared by their bytes alone, no digest before."""
    return classes.byte_classes(files(spark, sf_dir), ALL, alg=None)


@query(_SETS)
def dup_sets_folded(spark, sf_dir):
    """Contents cut into ranges, digested apart and folded in a tree, as large files on disk are."""
    f = scan.accepted(files(spark, sf_dir), ALL)
    folds = ranges.folded(ranges.column_ranges(F.col("path"), F.col("content"), f, "md5", 512), "md5", 1 << 20, 8)
    found = f.select("path", "size").join(folds, "path").select(scan.set_id().alias("id"), F.col("size").alias("each_size"), "path")
    return flat(scan.as_sets(found))


@query(None)
def digest_sha512(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.lower(F.hex(hashing.digest("sha512", F.col("content")))).alias("digest"))


@query(None)
def digest_xxhash(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.lower(F.hex(hashing.digest("xxhash", F.col("content")))).alias("digest"))


@query(_FLAT.format(n="n", paths="paths") + "sets WHERE n > 2")
def set_exchange(spark, sf_dir):
    """Sets written with their members as one string and read back."""
    return flat(from_delimited(to_delimited(sets(spark, sf_dir)))).filter("count > 2")


@query("SELECT path, candidate, status FROM stat WHERE path = (SELECT min(path) FROM m WHERE path IN (SELECT path FROM now))")
def store_lookup(spark, sf_dir):
    """``file_lookup`` from a store on disk: by the index of paths, then the one set's members; only its files are digested."""
    store, n = DuplicateStore(spark, place(spark, "store")), now(spark, sf_dir)
    store.save(rows(spark, sf_dir))
    first = store.members().select("path").join(n.select("path"), "path", "left_semi").agg(F.min("path").alias("path")).first()["path"]
    return verify.file_in_store(store, n, first, "md5")


@query("SELECT path, size, h AS hash FROM files WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 OR doc_id % 12 = 1 OR doc_id % 12 = 4 ORDER BY path")
def cache_log(spark, sf_dir):
    """A cache with a base, some stale entries, and two deltas: what was written last holds, and what no file has any more goes."""
    cache, f = HashCache(spark, place(spark, "cache")), files(spark, sf_dir)
    cache.save(_cached(spark, sf_dir))
    fresh = f.withColumn("id", F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")).withColumn("hash", hashing.digest("md5", F.col("content")))
    for rest in (1, 4):
        cache.append(fresh.filter(F.col("id") % 12 == rest).select("path", "size", "ctime", F.lit("md5").alias("alg"), "hash"))
    return maintain.valid_entries(cache.load(), f).select("path", "size", F.lower(F.hex("hash")).alias("hash"))
