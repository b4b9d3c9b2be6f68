"""Results that are known for small trees, rebuilt here: hard links, reports, digests, cache counters, odd names."""

import os
import random

import pytest
from pyspark.sql import functions as F

from twinfold.functions import hashing, paths
from twinfold.model import Options
from twinfold.operators import maintain, scan, verify
from twinfold.plans import report
from twinfold.plans.store import DuplicateStore, HashCache
from twinfold.sources.tree import TreeReader, tree


@pytest.fixture
def links(tmp_path):
    """1 and 5 are one inode, 2, 4 and 6 another, 8 is a copy of 2, 3 a symbolic link."""
    t = tmp_path / "links"
    t.mkdir()
    (t / "1").write_text("first file\n")
    (t / "2").write_text("second file\n")
    os.symlink("1", t / "3")
    os.link(t / "2", t / "4")
    os.link(t / "1", t / "5")
    os.link(t / "2", t / "6")
    (t / "8").write_text("second file\n")
    (t / "script").write_text("#!/bin/sh\n# other\n")
    return str(t)


def printed(spark, top, command, unique=False, exclude=None):
    rows = tree(spark, [top])
    m = scan.duplicate_members(rows)
    labels = verify.listing(m, rows, top, hardlink_is_unique=unique, exclude_path=exclude)
    if command != "ls":
        labels = labels.filter(F.col("label") == ("DUPLICATE" if command == "dups" else "UNIQUE"))
    return sorted(r.line for r in verify.listing_lines(labels, command == "ls", top + "/", verify.verified_pairs(m, rows, exclude_path=exclude)).collect())


HL = ["1", "2", "2", "4", "4", "5", "6", "6"]
DUP = ["2", "4", "6", "8", "8", "8"]
DETAILS = [f"             DUP: {x}" for x in DUP] + [f"             HL : {x}" for x in HL]


def test_hard_link_listings(spark, links):
    assert printed(spark, links, "ls") == sorted(DETAILS + ["   UNIQUE: script"] + [f"DUPLICATE: {x}" for x in "124568"])
    assert printed(spark, links, "ls", True) == sorted(DETAILS + [f"   UNIQUE: {x}" for x in ("1", "5", "script")] + [f"DUPLICATE: {x}" for x in "2468"])
    assert printed(spark, links, "uniques") == ["script"]
    assert printed(spark, links, "uniques", True) == sorted(["             HL : 1", "             HL : 5", "1", "5", "script"])
    assert printed(spark, links, "dups") == sorted(DETAILS + list("124568"))
    assert printed(spark, links, "dups", True) == sorted([x for x in DETAILS if x[-1] not in "15"] + list("2468"))
    assert [x for x in printed(spark, links, "ls", exclude=f"{links}/8") if "xxx" in x] == ["             xxx: 8"] * 3


def test_hard_links_at_scan_time(spark, links):
    (one,) = scan.duplicate_sets(tree(spark, [links]), Options(hardlink_is_unique=True)).collect()
    assert [os.path.basename(p) for p in one.paths] == ["2", "8"]


def test_reports_of_a_tree(spark, tmp_path):
    """Three sets of two files, as many near misses, and the whole report with its head and foot."""
    t = tmp_path / "t"
    t.mkdir()
    rng = random.Random(4)
    base = {n: rng.randbytes(n) for n in (35153, 35223, 35147, 35177, 35151, 254)}
    other = lambda n, at: base[n][:at] + bytes([base[n][at] ^ 1]) + base[n][at + 1 :]
    made = {"1": base[35153], "2": other(35153, 9), "3": base[35153], "three1diffA": other(35177, 100), "three1diffB": base[35177], "three1diffC": base[35177], "z": other(254, 0), "z1": base[254], "z2": base[254]}
    made |= {f"F{i}": other(35223, 1000 * i) for i in range(1, 5)} | {"c1": base[35147], "c2": other(35147, 35146)} | {f"threediff{c}": other(35151, i) for i, c in enumerate("ABC")}
    for name, data in made.items():
        (t / name).write_bytes(data)
    sets = scan.duplicate_sets(tree(spark, [str(t)]))
    report.write_report(sets, str(tmp_path / "text"), "text", prefix=f"{t}/")
    text = "".join(open(f"{tmp_path}/text/{x}").read() for x in sorted(os.listdir(tmp_path / "text")) if x.startswith("part"))
    assert text.startswith("\n508 total bytes used by duplicates of size 254:\n  z1\n  z2\n\n\n70306 total")
    want = ["", "", "", "", "", "", "", "  1", "  3", "  three1diffB", "  three1diffC", "  z1", "  z2"]
    want += ["508 total bytes used by duplicates of size 254:", "70306 total bytes used by duplicates of size 35153:", "70354 total bytes used by duplicates of size 35177:", "Total used: 141168 bytes (137 KiB, 0 MiB, 0 GiB)"]
    assert sorted(text.splitlines()) == want
    report.write_report(sets, str(tmp_path / "json"), "json", prefix=f"{t}/")
    lines = "".join(open(f"{tmp_path}/json/{x}").read() for x in sorted(os.listdir(tmp_path / "json")) if x.startswith("part")).splitlines()
    assert lines == ["[", '[ 508, 254, "z1", "z2" ]', ",", '[ 70306, 35153, "1", "3" ]', ",", '[ 70354, 35177, "three1diffB", "three1diffC" ]', "]"]
    script = [r.value for r in maintain.script_text(sets, "hard").collect()]
    assert script[0] == maintain.BANNER and [x.split("/")[-1] for x in script[1::2]] == ["1", "three1diffB", "z1"]
    assert report.report_rows(sets.limit(0), "json").orderBy("part").select("value").collect()[0].value == "["


def test_cache_counters(spark, tmp_path):
    """A cold cache serves no size group; a second scan serves all whose files it holds."""
    t = tmp_path / "t"
    t.mkdir()
    for k in range(4):
        (t / f"a{k}").write_bytes(bytes([k // 2]) * 3000)
        (t / f"b{k}").write_bytes(bytes([k // 2]) * (2000 + k // 2))
    (t / "small1").write_bytes(b"x" * 10)
    (t / "small2").write_bytes(b"x" * 10)
    options, cache = Options(alg="md5", cache_min_size=1000), HashCache(spark, str(tmp_path / "cache"))
    rows = tree(spark, [str(t)])
    cold = scan.statistics(rows, options, cache.load()).first()
    assert (cold.size_list_done_from_cache, cold.files_done_from_cache, cold.size_sets, cold.duplicate_files, cold.consistent) == (0, 0, 4, 10, True)
    done = hashing.hash_files(scan.accepted(rows, options).select(*scan.NARROW), "md5").select("path", "size", "ctime", F.lit("md5").alias("alg"), "hash")
    cache.save(maintain.upserted(cache.load(), done.filter("size > 1000")))
    warm = scan.statistics(rows, options, cache.load()).first()
    assert (warm.size_list_done_from_cache, warm.files_done_from_cache) == (3, 8)
    assert warm.duplicate_files == scan.duplicate_members(rows, options, cache.load()).count() == 10
    for _ in range(2):
        scan.append_stats(scan.statistics(rows, options, cache.load()), str(tmp_path / "stats"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "stats")).collect()]
    assert lines.count("size_list_done_from_cache 3") == 2 and lines.count("duplicate_groups 5") == 2


def test_hash_command_saves(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"q" * 2000)
    (tmp_path / "little").write_bytes(b"q")
    cache = HashCache(spark, str(tmp_path / "cache"))
    first = maintain.hash_and_save(str(tmp_path / "big"), cache, "sha512", 1000)
    maintain.hash_and_save(str(tmp_path / "little"), cache, "sha512", 1000)
    assert [(os.path.basename(r.path), r.hash) for r in cache.ls().collect()] == [("big", first.hex())]
    assert maintain.hash_and_save(str(tmp_path / "big"), cache, "sha512", 1000) == first and cache.ls().count() == 1


def test_digest_bytes(spark):
    """Published vectors, and that XXH64 has seed 1 and is shown in memory order."""
    import xxhash

    d = spark.createDataFrame([(bytearray(b"abc"),)], "c binary")
    value = lambda alg: bytes(d.select(hashing.digest(alg, F.col("c"))).first()[0]).hex()
    assert value("md5") == "900150983cd24fb0d6963f7d28e17f72"
    assert value("sha1") == "a9993e364706816aba3e25717850c26c9cd0d89d"
    assert value("sha512").startswith("ddaf35a193617abacc417349ae204131") and len(value("sha512")) == 128
    assert value("xxhash") == xxhash.xxh64(b"abc", seed=1).digest()[::-1].hex()
    assert d.select(hashing.dump(F.lit("f"), hashing.digest("md5", F.col("c"))).alias("x")).first().x.startswith("f: 90 01 50 ")


def test_names_that_are_not_utf8(spark, tmp_path):
    t = tmp_path / "t"
    t.mkdir()
    for raw in (b"caf\xe9", b"caf\xe8", "café".encode()):
        with open(os.path.join(os.fsencode(t), raw), "wb") as f:
            f.write(b"equal")
    rows = tree(spark, [str(t)])
    (one,) = scan.duplicate_sets(rows).collect()
    assert sorted(paths.raw_of(p) for p in one.paths) == sorted(os.path.join(os.fsencode(t), x) for x in (b"caf\xe9", b"caf\xe8", "café".encode()))
    assert all(paths.text_of(paths.raw_of(p)) == p for p in one.paths)
    assert verify.validate(scan.duplicate_members(rows), rows).first().ok


def test_reader_entries(spark, tmp_path, monkeypatch):
    """Entries that vanish or cannot be listed are errors; names with the separator, other kinds and other devices are told apart; deep trees are split."""
    t = tmp_path / "t"
    for k in range(3):
        for j in range(40):
            (t / f"d{k}" / f"e{j}").mkdir(parents=True)
            (t / f"d{k}" / f"e{j}" / "f").write_text(f"{k} {j}")
    (t / "bad\x1cname").write_text("x")
    os.mkfifo(t / "pipe")
    kinds = {r["kind"]: r["count"] for r in tree(spark, [str(t)]).groupBy("kind").count().collect()}
    assert kinds == {"file": 120, "badsep": 1, "other": 1}
    assert tree(spark, [str(t)], Options(skip_separator=False)).filter("kind = 'file'").count() == 121
    reader = TreeReader({"roots": f'["{t}"]'})
    assert len(reader.partitions()) == 124  # the root, three directories and what is below each
    gone = TreeReader({"roots": f'["{t}/none"]', "one_file_system": "true"})
    assert [r[4] for p in gone.partitions() for r in gone.read(p)] == ["error"]
    two = tree(spark, [str(t / "d0"), str(t / "d1")]).filter("kind = 'file'")
    assert two.count() == 80 and two.select("root").distinct().count() == 2
    stat = TreeReader._stat

    def elsewhere(path):
        s = stat(path)
        return os.stat_result((s.st_mode, s.st_ino, s.st_dev + 1, *s[3:])) if s and path.endswith(b"/d2") else s

    monkeypatch.setattr(TreeReader, "_stat", staticmethod(elsewhere))
    one = TreeReader({"roots": f'["{t}"]', "one_file_system": "true"})
    monkeypatch.setattr("twinfold.sources.tree.LEVELS", 0)
    assert sum(r[4] == "file" for p in one.partitions() for r in one.read(p)) == 81


def test_paths(spark):
    d = spark.createDataFrame([("/a",), ("/a/b",), ("a/b",)], "p string")
    assert [tuple(r) for r in d.select(paths.dir_of(F.col("p")), paths.name_of(F.col("p"))).collect()] == [("/", "a"), ("/a", "b"), ("a", "b")]
    assert [r[0] for r in spark.createDataFrame([(10000,), (10001,)], "ms long").select(paths.duration(F.col("ms"))).collect()] == ["10000ms", "10s"]


def test_store_keeps_the_last_complete_generation(spark, tmp_path):
    store = DuplicateStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.load()
    rows = spark.createDataFrame([(1, 10, "/a"), (1, 10, "/b")], "id long, each_size long, path string")
    store.save(rows)
    with pytest.raises(Exception, match="broken"):
        store.save(rows.withColumn("path", F.raise_error(F.lit("broken")).cast("string")))
    assert store.members().count() == 2 and store.load().first().paths == ["/a", "/b"]
    store.save(maintain.refresh(store.members(), spark.createDataFrame([("/a", "file")], "path string, kind string")))
    assert store.load().count() == 0 and store.meta()["version"] == "1"
