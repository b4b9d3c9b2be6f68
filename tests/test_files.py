"""Trees on disk, stores, caches and scripts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from twinfold.functions import hashing
from twinfold.model import Options
from twinfold.operators import maintain, scan, verify
from twinfold.plans import report
from twinfold.plans.store import DuplicateStore, HashCache, from_delimited, to_delimited
from twinfold.sources.tree import checked_roots, tree


@pytest.fixture
def top(tmp_path):
    t = tmp_path / "t"
    (t / "sub" / ".hid").mkdir(parents=True)
    for name, text in {"a": "first file\n", "b": "first file\n", "c": "other file\n", "empty": "", ".h": "first file\n", "sub/d": "first file\n", "sub/.hid/e": "first file\n", "_u": "x"}.items():
        (t / name).write_text(text)
    os.link(t / "a", t / "link")
    os.symlink(t / "a", t / "sym")
    return str(t)


def names(df, col="path"):
    return sorted(os.path.basename(r[0]) for r in df.select(col).collect())


def stored(spark, sets, tmp_path):
    """As a later command sees them: lazily derived sets would follow the files."""
    store = DuplicateStore(spark, str(tmp_path / "kept"))
    store.save(sets)
    return store.load()


def test_tree(spark, top):
    rows = tree(spark, [top])
    assert names(rows.filter("kind = 'file'")) == ["_u", "a", "b", "c", "d", "empty", "link"]
    assert names(rows.filter("kind = 'other'")) == ["sym"]
    assert names(tree(spark, [top], Options(hidden=True)).filter("kind = 'file'")) == [".h", "_u", "a", "b", "c", "d", "e", "empty", "link"]


@pytest.mark.parametrize("alg", ["md5", "sha1", "sha512", "xxhash"])
def test_sets_on_disk(spark, top, alg):
    sets = scan.duplicate_sets(tree(spark, [top]), Options(alg=alg, prefixes=(4,)))
    assert [names(sets.select(F.explode("paths")), "col")] == [["a", "b", "d", "link"]]
    own = scan.duplicate_sets(tree(spark, [top]), Options(alg=alg, hardlink_is_unique=True))
    assert own.select("count").collect()[0][0] == 3


def test_statistics(spark, top):
    s = scan.statistics(tree(spark, [top])).first()
    assert (s.files_seen, s.too_small, s.not_file, s.accepted, s.duplicate_files, s.duplicate_groups) == (8, 1, 1, 6, 4, 1)
    assert "duplicate_groups 1" in [r.line for r in scan.stats_lines(scan.statistics(tree(spark, [top]))).collect()]


def test_hard_links_listed_but_not_counted(spark, top, tmp_path):
    sets = stored(spark, scan.duplicate_sets(tree(spark, [top]), Options(min_size=2)), tmp_path)
    os.remove(f"{top}/b")
    os.remove(f"{top}/sub/d")
    now = tree(spark, [top])
    assert verify.file_status(sets, now, f"{top}/a").filter("status = 'HL'").count() == 1
    assert names(verify.dups(sets, now)) == ["a", "link"]
    assert "a" in names(verify.uniques(sets, now, hardlink_is_unique=True))
    left = maintain.refresh(sets, now)
    assert [r["count"] for r in left.collect()] == [2]


def test_changed_file_fails_validation(spark, top, tmp_path):
    sets = stored(spark, scan.duplicate_sets(tree(spark, [top]), Options()), tmp_path)
    assert verify.validate(sets, tree(spark, [top])).first().ok
    with open(f"{top}/b", "w") as f:
        f.write("FIRST file\n")
    r = verify.validate(sets, tree(spark, [top])).first()
    assert (r.ok, r.n_ok) == (False, 2)


def test_roots(top, tmp_path):
    assert checked_roots([f"{top}/sub/.."]) == [top]
    (tmp_path / "tx").mkdir()
    assert len(checked_roots([top, str(tmp_path / "tx")])) == 2
    for bad in ([f"{top}/a"], [top, f"{top}/sub"]):
        with pytest.raises(ValueError):
            checked_roots(bad)


def test_unreadable_and_sparse(tmp_path):
    p = tmp_path / "s"
    with open(p, "wb") as f:
        f.truncate(5_000_000)
    import hashlib

    assert hashing.file_digest(str(p), "md5", 5_000_000) == hashlib.md5(bytes(5_000_000)).digest()
    assert hashing.file_digest(str(p), "md5", 5_000_001) is None
    assert hashing.file_digest(str(tmp_path / "none"), "md5") is None


def test_column_and_file_digests_agree(spark, tmp_path):
    data = bytes(range(256)) * 300
    (tmp_path / "x").write_bytes(data)
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    for alg in ("md5", "sha1", "sha512", "xxhash"):
        assert bytes(df.select(hashing.digest(alg, F.col("c"))).first()[0]) == hashing.file_digest(str(tmp_path / "x"), alg)
    assert df.select(hashing.digest("xxhash", F.lit(None).cast("binary"))).first()[0] is None
    with pytest.raises(ValueError):
        hashing.check_alg("crc")


def test_store(spark, tmp_path):
    sets = spark.createDataFrame([(1, 2, 3 << 31, ["/a", "/b"])], "id long, count int, each_size long, paths array<string>")
    store = DuplicateStore(spark, str(tmp_path / "store"))
    store.save(sets, hardlink_is_unique=True, now_ms=0)
    assert store.load().collect() == sets.collect()
    assert store.warnings(now_ms=1000) == []
    assert "100 hours" in store.warnings(now_ms=100 * 3_600_000)[0]
    with pytest.raises(ValueError):
        store.warnings(hardlink_is_unique=True)
    assert from_delimited(to_delimited(sets)).collect() == sets.collect()


def test_cache(spark, tmp_path):
    row = "path string, size long, ctime long, alg string, hash binary"
    cache = HashCache(spark, str(tmp_path / "cache"))
    assert cache.load().count() == 0
    cache.save(maintain.upserted(cache.load(), spark.createDataFrame([("/a", 1, 1, "md5", bytearray(b"x"))], row)))
    cache.save(maintain.upserted(cache.load(), spark.createDataFrame([("/a", 1, 1, "sha1", bytearray(b"y")), ("/b", 2, 2, "md5", bytearray(b"z"))], row)))
    assert cache.load().count() == 3
    cache.save(maintain.upserted(cache.load(), spark.createDataFrame([("/a", 5, 9, "md5", bytearray(b"n"))], row)))
    assert sorted((r.path, r.alg) for r in cache.ls().collect()) == [("/a", "md5"), ("/b", "md5")]
    with pytest.raises(Exception, match="differs"):
        maintain.upserted(cache.load(), spark.createDataFrame([("/b", 2, 2, "md5", bytearray(b"other"))], row)).collect()
    cache.delete()
    assert cache.load().count() == 0


def test_reports(spark, tmp_path):
    sets = spark.createDataFrame([(1, 2, 10, ["/x/a", "/x/it's \"b\""]), (2, 3, 1, ["/c", "/d\\e", "/f"])], "id long, count int, each_size long, paths array<string>")
    lines = lambda p: [r.value for r in spark.read.text(p).collect()]
    report.write_report(sets, str(tmp_path / "j"), "json")
    assert sorted(json.loads("".join(lines(str(tmp_path / "j"))))) == [[3, 1, "/c", "/d\\e", "/f"], [20, 10, "/x/a", "/x/it's \"b\""]]
    assert [r.entry for r in report.rendered(sets, "csv", prefix="/x").collect()] == ['3,1,"/c","/d\\e","/f"', '20,10,"/a","/it\'s ""b"""']
    report.write_report(sets, str(tmp_path / "t"), "text", min_total=5)
    text = lines(str(tmp_path / "t"))
    assert "20 total bytes used by duplicates of size 10:" in text and "Total used: 20 bytes (0 KiB, 0 MiB, 0 GiB)" in text
    with pytest.raises(ValueError):
        report.rendered(sets, "xml")
    assert any("rm '/x/it'\\''s \"b\"'" in r.line for r in maintain.script(sets).collect())
    assert "# KEEPING: /c" in "\n".join(r.value for r in maintain.script_text(sets, "hard").collect())


def test_empty(spark, tmp_path):
    (tmp_path / "e").mkdir()
    f = tree(spark, [str(tmp_path / "e")])
    assert scan.duplicate_sets(f).count() == 0
    assert scan.statistics(f).first().duplicate_files == 0


def test_stream(spark, tmp_path):
    from twinfold.streaming.arrivals import append_to

    schema = "path string, size long, ctime long, content binary"
    spark.createDataFrame([("/a", 1, 1, bytearray(b"x")), ("/e", 0, 1, bytearray(b""))], schema).write.parquet(str(tmp_path / "in"))
    q = append_to(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["/a"]
