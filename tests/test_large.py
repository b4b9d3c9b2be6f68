"""Large files by ranges, holes, classes of equal bytes, membership filters, the index of a store and the log of a cache."""

import hashlib
import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from test_plans import nodes

from twinfold import queries as engine
from twinfold.functions import extents, hashing
from twinfold.model import CACHE, Options
from twinfold.operators import classes, maintain, membership, ranges, scan, verify
from twinfold.plans.staging import stage
from twinfold.plans.store import DuplicateStore, HashCache
from twinfold.sources.corpus import files_from
from twinfold.sources.tree import tree


def narrow(spark, top):
    return stage(tree(spark, [str(top)]).select(*scan.NARROW), "narrow")


def test_large_sparse_files(spark, tmp_path):
    """Two pairs of files of 2.2 and 4.3 GB without data: their ranges are dealt to many tasks, nothing is read, and the pairs are found."""
    sizes = {"a1": 2_203_588_743, "a2": 2_203_588_743, "b1": 4_294_967_296, "b2": 4_294_967_296}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
    rows = ranges.ranges(narrow(spark, tmp_path))
    assert rows.count() == 2 * (33 + 64) and rows.agg(F.sum("length")).first()[0] == sum(sizes.values())
    dealt = ranges.dealt(rows)
    per = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert dealt.rdd.getNumPartitions() == 25 and len(per) > 20 and max(per) <= 12  # 512 MB a task
    assert ranges.range_digests(dealt, "xxhash").agg(F.sum("read")).first()[0] == 0
    sets = scan.duplicate_sets(tree(spark, [str(tmp_path)]), Options(prefixes=(65536,))).collect()
    assert sorted(sorted(os.path.basename(p) for p in r.paths) for r in sets) == [["a1", "a2"], ["b1", "b2"]]
    assert sum(r["count"] * r["each_size"] for r in sets) == 12_997_112_078


@pytest.mark.parametrize(("span", "fan"), [(1000, 2), (4096, 3), (1 << 20, 1024)])
def test_folds_tell_files_apart_as_digests_do(spark, tmp_path, span, fan):
    rng = random.Random(3)
    body = rng.randbytes(50_000)
    made = {"a": body, "b": body, "first": b"x" + body[1:], "last": body[:-1] + b"x", "swapped": body[1000:2000] + body[:1000] + body[2000:], "short": body[:999], "none": b"", "shorter": body[:998], "twice": body[:999]}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    for alg in ("md5", "xxhash"):
        got = {os.path.basename(r.path): bytes(r.hash) for r in ranges.tree_digests(narrow(spark, tmp_path), alg, span, fan).collect()}
        assert len(got) == len(made)
        for x in made:
            for y in made:
                assert (got[x] == got[y]) == (made[x] == made[y])


def test_fold_of_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 5000)
    rows = narrow(spark, tmp_path)
    with open(tmp_path / "f", "r+b") as f:
        f.truncate(2500)
    assert ranges.tree_digests(rows, "md5", 1000).first().hash is None
    os.remove(tmp_path / "f")
    assert ranges.tree_digests(rows, "md5", 1000).first().hash is None
    assert ranges.tree_digests(rows.limit(0), "md5", 1000).count() == 0


def test_holes_are_not_read(spark, tmp_path):
    """Data at the start, in the middle and nowhere else: extents tell them, digests of the whole and of ranges are those of the bytes, and only data is read."""
    page = 1 << 16
    whole = bytearray(40 * page)
    whole[:page] = b"a" * page
    whole[20 * page : 22 * page] = b"b" * (2 * page)
    with open(tmp_path / "s", "wb") as f:
        f.truncate(len(whole))
        f.write(whole[:page])
        f.seek(20 * page)
        f.write(whole[20 * page : 22 * page])
    found = [(r.start, r.length, r.data) for r in ranges.holes(narrow(spark, tmp_path)).orderBy("start").collect()]
    assert found == [(0, page, True), (page, 19 * page, False), (20 * page, 2 * page, True), (22 * page, 18 * page, False)]
    path = str(tmp_path / "s")
    assert extents.read_range(path, "md5") == (hashlib.md5(whole).digest(), len(whole), 3 * page)
    assert extents.read_range(path, "sha1", 10 * page + 7, 11 * page) == (hashlib.sha1(whole[10 * page + 7 : 21 * page + 7]).digest(), 11 * page, page + 7)
    assert hashing.file_digest(path, "sha512", len(whole)) == hashlib.sha512(whole).digest()
    read = ranges.range_digests(ranges.ranges(narrow(spark, tmp_path), 4 * page), "md5").agg(F.sum("read").alias("read"), F.count_if(F.col("hash").isNull()).alias("bad")).first()
    assert (read.read, read.bad) == (3 * page, 0)


FORGED = {"a1": b"one", "a2": b"one", "b1": b"two", "b2": b"two", "b3": b"two", "c": b"six", "d": b"ten"}


def classed(df):
    out = {}
    for r in df.collect():
        out.setdefault(os.path.basename(r["class"]), []).append(os.path.basename(r.path))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("chunk", [256, 2, 1])
def test_classes_under_one_forged_digest(spark, tmp_path, chunk):
    """Files of one size and one (forged) digest fall into the classes of their bytes, those that differ from the first too."""
    want = {"a1": ["a1", "a2"], "b1": ["b1", "b2", "b3"]}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in FORGED.items()], "name string, c binary")
    f = files_from(rows, F.concat(F.lit("/r/"), F.col("name")), F.col("c"))
    forged = f.select("path", "size", F.lit(b"same").alias("hash"))
    assert classed(classes.classes_of(f, forged, chunk)) == want
    for name, data in FORGED.items():
        (tmp_path / name).write_bytes(data)
    here = narrow(spark, tmp_path)
    assert classed(classes.classes_of(here, here.select("path", "size", F.lit(b"same").alias("hash")), chunk)) == want
    assert classed(classes.byte_classes(tree(spark, [str(tmp_path)]), alg=None, chunk=chunk)) == want
    assert classes.classes_of(f.limit(0), forged.limit(0)).count() == 0


def test_many_classes_and_a_large_one(spark):
    """Of 3000 files of one size and digest 1000 are equal, the others in pairs: more classes than fit into a chunk."""
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, F.lit("00000")).otherwise(F.lpad(F.floor(F.col("id") / 2).cast("string"), 5, "0")).alias("c"))
    f = files_from(rows, F.concat(F.lit("/r/"), F.col("id").cast("string")), F.col("c"))
    got = classes.classes_of(f, f.select("path", "size", F.lit(b"same").alias("hash")), 20)
    sizes = got.groupBy("class").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {r["count"]: r["n"] for r in sizes} == {1000: 1, 2: 1000}


def test_refinement_reads_in_lockstep(tmp_path):
    body = os.urandom(5 * classes.BLOCK)
    made = {"a": body, "b": body, "c": body[:-1] + b"!", "d": body[:-1] + b"!", "e": b"!" + body[1:], "f": body[: 2 * classes.BLOCK]}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = classes.refined([str(tmp_path / n) for n in [*made, "gone"]])
    assert sorted(sorted(os.path.basename(p) for p in c) for c in got) == [["a", "b"], ["c", "d"], ["e"], ["f"]]


def test_cache_spares_digests(spark, sf_dir):
    """Contents that the cache serves are not digested: as many digests as misses, and a second pass for the few that pass the filter wrongly."""
    f, cache = stage(engine.files(spark, sf_dir), "files"), engine._cached(spark, sf_dir)
    served = stage(scan.served_by(f, cache, "md5"), "served")
    n, all_ = served.count(), f.count()
    assert 0 < n < all_
    seen = Observation("digests")
    rows = scan.hashed(f, "md5", cache, 0, seen).collect()
    assert seen.get["digested"] + seen.get["spared"] == all_ and n <= seen.get["spared"] <= n + 0.05 * all_
    assert sorted((r.path, bytes(r.hash)) for r in rows) == sorted((r.path, bytes(r.hash)) for r in scan.hashed(f, "md5").collect())


def test_filter_has_no_misses_and_few_false_hits(spark):
    keys = stage(spark.range(20_000).select(F.col("id").alias("k")), "keys")
    words = membership.words_for(20_000)
    rows = membership.marked(spark.range(60_000).select(F.col("id").alias("k")), membership.bloom(keys, words, "k"), words, "k")
    counts = {(r["member"], r["maybe"]): r["count"] for r in rows.groupBy((F.col("k") < 20_000).alias("member"), "maybe").count().collect()}
    assert counts[True, True] == 20_000 and (True, False) not in counts and counts.get((False, True), 0) < 0.02 * 40_000
    assert membership.words_for(10**12) is None


def test_only_what_is_asked_is_digested(spark, sf_dir, monkeypatch):
    """Few paths are picked exactly, more by a filter, very many not at all; results are the same."""
    n, m = engine.now(spark, sf_dir), stage(engine.rows(spark, sf_dir), "rows")
    want = sorted(map(tuple, verify.current(n, m, "md5").collect()))
    for keys, words in ((10, 4_000_000), (10, 0)):
        monkeypatch.setattr(membership, "MOST_KEYS", keys)
        monkeypatch.setattr(membership, "MOST_WORDS", words)
        assert sorted(map(tuple, verify.current(n, m, "md5").collect())) == want


def test_store_point_reads(spark, sf_dir, tmp_path):
    """One path is looked up in one bucket of the index, and its set in one bucket of the members."""
    m, n = engine.rows(spark, sf_dir), engine.now(spark, sf_dir)
    store = DuplicateStore(spark, str(tmp_path / "s"))
    store.save(m)
    asked = [r.path for r in m.select("path").join(n.select("path"), "path", "left_semi").limit(5).collect()]
    for path in asked:
        got = sorted(map(tuple, verify.file_in_store(store, n, path, "md5").collect()))
        assert got == sorted(map(tuple, verify.file_status(m, n, path, "md5").collect()))
        read = store.candidates([path])
        assert read.count() > 1
        scans = [x for x in nodes(read._jdf.queryExecution().executedPlan()) if x.nodeName().startswith("Scan parquet")]
        read._jdf.queryExecution().executedPlan().executeCollect()
        assert [x.metrics().apply("numPartitions").value() for x in scans] == [1] and scans[0].metrics().apply("numFiles").value() < len(read.inputFiles())
        assert "PartitionFilters: [isnotnull(bucket" in scans[0].verboseStringWithOperatorId() + str(scans[0]) and "EqualTo(id" in str(scans[0])
    assert store.candidates(["/none"]).count() == 0 and store.sets_of(["/none"]) == []


def weigh(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_saving_one_digest_writes_one_row(spark, tmp_path):
    """However large the cache, a new digest is one more row beside it."""
    grown = []
    for n in (10, 100_000):
        cache = HashCache(spark, str(tmp_path / f"c{n}"))
        cache.save(spark.range(n).select(F.concat(F.lit("/p/"), "id").alias("path"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("ctime"), F.lit("md5").alias("alg"), F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("hash")))
        (tmp_path / f"f{n}").write_bytes(b"q" * 2000)
        before = weigh(tmp_path / f"c{n}")
        first = maintain.hash_and_save(str(tmp_path / f"f{n}"), cache, "sha1", 1000)
        grown.append(weigh(tmp_path / f"c{n}") - before)
        assert first == hashlib.sha1(b"q" * 2000).digest() and len(cache.deltas()) == 1
        assert maintain.hash_and_save(str(tmp_path / f"f{n}"), cache, "sha1", 1000) == first and len(cache.deltas()) == 1
        assert cache.lookup(["/p/7", str(tmp_path / f"f{n}"), "/none"]).count() == 2 and cache.load().count() == n + 1
    assert abs(grown[1] - grown[0]) < 200


def test_newest_rows_of_a_cache_hold(spark, tmp_path, monkeypatch):
    row = lambda *r: spark.createDataFrame([(*x[:4], bytearray(x[4])) for x in r], CACHE)
    cache = HashCache(spark, str(tmp_path / "c"))
    cache.append(row(("/a", 1, 1, "md5", b"x"), ("/b", 1, 1, "md5", b"y")))
    cache.append(row(("/a", 1, 1, "sha1", b"z")))
    assert sorted((r.path, r.alg) for r in cache.load().collect()) == [("/a", "md5"), ("/a", "sha1"), ("/b", "md5")]
    cache.append(row(("/a", 2, 5, "md5", b"n")))  # changed: both older digests are stale
    cache.append(row(("/a", 2, 5, "md5", b"n")))
    want = [("/a", 2, "md5", b"n"), ("/b", 1, "md5", b"y")]
    rows = lambda df: sorted((r.path, r["size"], r.alg, bytes(r.hash)) for r in df.collect())
    assert rows(cache.load()) == want and rows(cache.lookup(["/a"])) == want[:1]
    cache.compact()
    assert cache.deltas() == [] and rows(cache.load()) == want
    cache.append(row(("/b", 1, 1, "md5", b"other")))
    with pytest.raises(Exception, match="differs"):
        cache.load().collect()
    cache.save(row(("/c", 1, 1, "md5", b"c")))
    assert rows(cache.load()) == [("/c", 1, "md5", b"c")] and cache.deltas() == []
    monkeypatch.setattr("twinfold.plans.store.DELTAS", 2)
    cache.append(row(("/d", 1, 1, "md5", b"d")))
    cache.append(row(("/e", 1, 1, "md5", b"e")))
    assert cache.deltas() == [] and cache.load().count() == 3
    cache.delete()
    assert cache.load().count() == 0
