"""Push-down to the tree source, the walk by levels, the report sink, and scans whose statistics read nothing again."""

import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, Not, StringStartsWith

from twinfold import queries as engine
from twinfold.functions import extents, hashing
from twinfold.model import Options
from twinfold.operators import maintain, scan, verify
from twinfold.plans import report, sink
from twinfold.plans.staging import stage
from twinfold.plans.store import DuplicateStore
from twinfold.sources.tree import TreeReader, tree
from twinfold.sources.walk import files_at, names, walk


@pytest.fixture
def top(tmp_path):
    t = tmp_path / "t"
    for k in range(4):
        for j in range(5):
            (t / f"d{k}" / f"e{j}" / ".hid").mkdir(parents=True)
            for i in range(3):
                (t / f"d{k}" / f"e{j}" / f"f{i}").write_text("x" * 100 * i)
            (t / f"d{k}" / f"e{j}" / ".hid" / "z").write_text("z")
    os.mkfifo(t / "pipe")
    os.symlink("d0", t / "link")
    (t / "bad\x1cname").write_text("b")
    return str(t)


def asked(top, *filters, **options):
    """Rows that a reader gives for some filters, the filters that it gives back, and what it looked at."""
    reader = TreeReader({"roots": f'["{top}"]'} | options)
    back = list(reader.pushFilters(list(filters)))
    looked, opened = [], []
    lstat, scandir = reader._stat, reader._entries
    reader._stat = lambda p: looked.append(p) or lstat(p)
    reader._entries = lambda p: opened.append(p) or scandir(p)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    return rows, back, len(looked), len(set(opened))


def test_filters_are_pushed_down(top):
    every, _, looked, opened = asked(top)
    assert len(every) == 63 and opened == 25
    rows, back, n, dirs = asked(top, StringStartsWith(("path",), f"{top}/d1/e2/"), IsNotNull(("path",)))
    assert not back and sorted(r[3] for r in rows) == ["f0", "f1", "f2"] and dirs == 3 and n < 15 < looked
    rows, back, n, dirs = asked(top, EqualTo(("path",), f"{top}/d3/e4/f1"))
    assert [r[1] for r in rows] == [f"{top}/d3/e4/f1"] and dirs == 3
    rows, *_ = asked(top, In(("dir",), (f"{top}/d0/e0", f"{top}/d2/e1")))
    assert len(rows) == 6
    rows, back, *_ = asked(top, GreaterThanOrEqual(("size",), 200), EqualTo(("kind",), "file"), Not(EqualTo(("name",), "f1")), EqualTo(("inode",), 3))
    assert len(rows) == 20 and all(r[5] >= 200 for r in rows) and len(back) == 2  # what it does not know is given back
    rows, back, n, _ = asked(top, EqualTo(("name",), "f2"))
    assert len(rows) == 20 and n < looked  # other names are not looked at
    assert asked(top, EqualTo(("name",), None))[1] and not asked(top, StringStartsWith(("path",), "/elsewhere"))[0]


def test_pushed_filters_give_the_same_rows(spark, top):
    rows = tree(spark, [top], Options(hidden=True))
    held = stage(rows, "rows")
    for condition in ("size >= 100 AND size < 200", f"startswith(path, '{top}/d2')", f"dir = '{top}/d2/e1'", "name IN ('f0', 'z')", "kind = 'file' AND name <> 'f1'", "endswith(name, '2')", "contains(path, 'hid')", "size IS NULL", "size IS NOT NULL AND inode > 0", f"path = '{top}/d0/e0/f0' OR size = 0"):
        assert sorted(map(tuple, rows.filter(condition).collect())) == sorted(map(tuple, held.filter(condition).collect())), condition
    plan = rows.filter(f"startswith(path, '{top}/d2') AND size > 5")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # the reader takes both
    assert "Filter" in rows.filter("inode > 5")._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")


@pytest.mark.parametrize("options", [Options(), Options(hidden=True), Options(one_file_system=True, skip_separator=False)])
def test_walk_equals_tree(spark, top, options):
    assert sorted(map(tuple, walk(spark, [top], options, 7).collect())) == sorted(map(tuple, tree(spark, [top], options).collect()))
    assert sorted(map(tuple, walk(spark, [f"{top}/d0", f"{top}/d1"], options).collect())) == sorted(map(tuple, tree(spark, [f"{top}/d0", f"{top}/d1"], options).collect()))


def test_walk_reports_what_cannot_be_read(spark, top):
    dirs = spark.createDataFrame([("/", 1, f"{top}/gone"), ("/", 1, f"{top}/d0")], "root string, dev long, path string")
    assert names(dirs, False).filter("name IS NULL").count() == 1 and names(dirs, False).count() == 6
    gone = files_at(spark.createDataFrame([(f"{top}/d0/e0/f1",), (f"{top}/none",), ("/",)], "path string"))
    assert sorted((r.name, r.kind, r["size"]) for r in gone.collect() if r.name) == [("f1", "file", 100), ("none", "error", None)]


def test_a_flat_directory_is_looked_at_by_many_tasks(spark, tmp_path):
    """200,000 files in one directory: their names are one task's, their states those of ten."""
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(200_000):
        os.close(os.open(flat / str(k), os.O_CREAT))
    try:
        found = names(spark.createDataFrame([(str(flat), 0, str(flat))], "root string, dev long, path string"), False)
        assert found.count() == 200_000
        rows = walk(spark, [str(flat)])
        assert rows.filter("kind = 'file' AND size = 0").count() == 200_000
        assert len({f for f in rows.inputFiles()}) == 10
    finally:
        shutil.rmtree(flat)


def text_at(path):
    return "".join(open(f"{path}/{x}", newline="").read() for x in sorted(os.listdir(path)))


@pytest.mark.parametrize("fmt", ["text", "csv", "json"])
def test_sink_writes_what_reports_do(spark, sf_dir, tmp_path, fmt):
    """Byte for byte, with sets in pieces over several tasks; nothing but the report is left."""
    m, s = stage(engine.rows(spark, sf_dir), "rows"), stage(engine.sets(spark, sf_dir), "sets")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for k, (least, prefix) in enumerate([(0, None), (5000, "/src1"), (1 << 40, None)]):
            out = str(tmp_path / f"sink{k}")
            sink.write_report(m, out, fmt, least, prefix)
            sink.write_report(m, out, fmt, least, prefix)  # over the first
            report.write_report(s, str(tmp_path / f"plain{k}"), fmt, least, prefix)
            want = "".join(open(f"{tmp_path}/plain{k}/{x}", newline="").read() for x in sorted(os.listdir(tmp_path / f"plain{k}")) if x.startswith("part"))
            assert text_at(out) == want
            assert all(x.startswith("report-") for x in os.listdir(out)) and (least > 5000 or len(os.listdir(out)) > 4)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_sink_of_a_very_large_set(spark, tmp_path):
    """A million members of one set: sorted and written in parts, none of which holds the set."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("id"), F.lit(7).cast("long").alias("each_size"), F.concat(F.lit("/f/"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("path"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sink.write_report(rows, str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [os.path.getsize(tmp_path / "r" / x) for x in os.listdir(tmp_path / "r") if "part" in x]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    lines = text_at(tmp_path / "r").split("\n")
    assert lines[:3] == ["", "7000000 total bytes used by duplicates of size 7:", "  /f/0000000"] and len(lines) == n + 6
    assert lines[-3:-1] == ["", "Total used: 7000000 bytes (6835 KiB, 6 MiB, 0 GiB)"]


def test_aborted_reports_leave_nothing(spark, tmp_path):
    out = str(tmp_path / "r")
    bad = spark.createDataFrame([(1, 5, "/a"), (1, 5, "/b")], "id long, each_size long, path string")
    sink.write_report(bad, out)
    before = text_at(out)
    spark.dataSource.register(sink.ReportSink)
    broken = bad.select(F.when(F.col("path") == "/b", F.raise_error(F.lit("broken")).cast("string")).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("dupreport").option("path", out).mode("overwrite").save()
    assert text_at(out) == before and not [x for x in os.listdir(out) if x.startswith(".")]


def test_scan_and_statistics_read_once(spark, sf_dir, tmp_path, monkeypatch):
    """Sets and statistics of one scan take the same rows: contents are digested once, files on disk opened once a round."""
    f, options = engine.files(spark, sf_dir, True), Options(hidden=True)
    rows = scan.scanned(f, options)
    for make in (scan.duplicate_members, scan.statistics):
        plan = make(rows, options)._jdf.queryExecution().optimizedPlan().toString()
        assert "documents" not in plan and "xxhash64(-7682426122119481604" not in plan
    assert scan.statistics(rows, options).first() == scan.statistics(f, options).first()
    assert scan.duplicate_members(rows, options).count() == scan.duplicate_members(f, options).count()

    for name, data in {"a": b"q" * 9000, "b": b"q" * 9000, "c": b"q" * 8999 + b"r", "d": b"p" * 9000, "e": b"tiny", "f": b"tiny", "g": b"alone", "h": b"z" * 9000}.items():
        (tmp_path / name).write_bytes(data)
    os.link(tmp_path / "a", tmp_path / "l")
    here = tree(spark, [str(tmp_path)])
    asked, digests = [], scan.hash_files
    monkeypatch.setattr(scan, "hash_files", lambda df, *more: asked.append(df.count()) or digests(df, *more))
    for unique in (False, True):
        o = Options(prefixes=(100,), hardlink_is_unique=unique)
        rows = scan.scanned(here, o)
        n = len(asked)
        s = scan.statistics(rows, o).first().asDict()
        sets = scan.duplicate_sets(rows, o).collect()
        assert len(asked) == n and s["consistent"]  # nothing was opened for either
        plain = scan.statistics(here, o).first().asDict()
        assert s == plain
        assert sorted(r["count"] for r in sets) == [2, 2 if unique else 3]
        assert (s["duplicate_files"], s["unique_files"], s["unreadable"], s["unique_by_size"]) == (4 if unique else 5, 3, 0, 1)
    assert asked[0] == 8  # all files of shared sizes are opened for the prefix


def test_file_command_on_disk_needs_no_walk(spark, top, tmp_path):
    rows = tree(spark, [top])
    store = DuplicateStore(spark, str(tmp_path / "s"))
    store.save(scan.duplicate_members(rows))
    path = f"{top}/d0/e0/f1"
    asked = store.candidates([path])
    got = verify.file_status(asked, files_at(asked.select("path")), path)
    assert got.count() == 19 and {r.status for r in got.collect()} == {"DUP"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, verify.file_status(store.members(), rows, path).collect()))
    assert maintain.hash_one(path, "md5") == hashing.file_digest(path, "md5") == extents.read_range(path, "md5")[0]
