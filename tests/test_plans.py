"""How plans move data: contents stay where they are read, sources are read once, and nothing grows with the square of a set."""

import os
import re

import pytest
from pyspark.sql import functions as F

from twinfold import queries as engine
from twinfold.model import Options
from twinfold.operators import classes, maintain, scan, verify
from twinfold.sources.corpus import document_files, files_from
from twinfold.sources.tree import tree


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def exchanged(df):
    """The columns of each shuffle of the physical plan."""
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
    return [re.findall(r"(\w+)#", n.output().mkString(",")) for n in found]


@pytest.fixture
def large(spark):
    """As at a large scale: no side is small enough to be broadcast, and plans are shown as they begin."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_contents_are_not_exchanged(spark, sf_dir, large):
    f, n, m = engine.files(spark, sf_dir, True), engine.now(spark, sf_dir), engine.rows(spark, sf_dir)
    cases = {
        "sets": scan.duplicate_members(f, Options(hidden=True)),
        "prefixes": scan.duplicate_members(f, Options(hidden=True, prefixes=(256, 4096))),
        "links": scan.duplicate_members(f, Options(hidden=True, hardlink_is_unique=True)),
        "cache": scan.duplicate_members(f, Options(alg="md5", hidden=True, cache_min_size=0), engine._cached(spark, sf_dir)),
        "singles": scan.singles(f, Options(hidden=True)),
        "prefix groups": scan.same_prefix(f, "md5", 256),
        "listing": verify.listing(m, n, alg="md5"),
        "details": verify.verified_pairs(m, n, "md5"),
        "validate": verify.validate(m, n, "md5"),
        "refresh": maintain.refresh(m, n),
        "tree_scan": engine.tree_scan(spark, sf_dir),
        "statistics": scan.statistics(f, Options(hidden=True)),
    }
    for name, df in cases.items():
        moved = exchanged(df)
        assert moved and not {"text", "content"} & {c for columns in moved for c in columns}, name


def test_digest_stays_below_the_joins(spark, sf_dir):
    """A semi-join pushed below the digest would carry contents; the join on paths is an inner one for that reason."""
    plan = verify.current(engine.now(spark, sf_dir), engine.rows(spark, sf_dir), "md5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("md5(")


def test_listing_is_linear(spark):
    """A set of 200,000 equal files: labels need no pairs, and no row holds the set's paths."""
    n = 200_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 100 == 0, F.lit("other")).otherwise(F.lit("same")).alias("c"))
    f = files_from(rows, F.concat(F.lit("/r/"), F.col("id").cast("string")), F.col("c"), inode=F.when(F.col("id") < 10, F.lit(-1)).otherwise(F.col("id")))
    m = scan.duplicate_members(f, Options(hidden=True))
    assert m.count() == n and scan.set_counts(m).count() == 2
    labels = verify.listing(m, f)
    sums = labels.groupBy("n_duplicates").count().collect()
    assert {r["n_duplicates"]: r["count"] for r in sums} == {n * 99 // 100 - 1: n * 99 // 100, n // 100 - 1: n // 100}
    unique = verify.listing(m, f, hardlink_is_unique=True).groupBy("n_duplicates").count().collect()
    # ids 1 to 9 are nine links of one inode; id 0 has the other content and that inode too
    assert {r["n_duplicates"]: r["count"] for r in unique} == {n * 99 // 100 - 1: n * 99 // 100 - 9, n * 99 // 100 - 9: 9, n // 100 - 1: n // 100}
    assert maintain.refresh(m, f.filter("inode >= 0")).count() == n - 10
    assert classes.byte_equal(f.limit(1000)).count() == 998


def test_labels_equal_pairs(spark, sf_dir):
    """Counts stand in for pairs in every combination of options."""
    m, n = engine.rows(spark, sf_dir), engine.now(spark, sf_dir)
    for exclude in (None, "/src1"):
        pairs = verify.verified_pairs(m, n, "md5", exclude_path=exclude)
        for unique in (False, True):
            counted = ["DUP"] if unique else ["DUP", "HL"]
            want = {r["path"]: r["n"] for r in pairs.groupBy("path").agg(F.sum(F.col("status").isin(counted).cast("long")).alias("n")).collect() if r["n"]}
            got = {r["path"]: r["n_duplicates"] for r in verify.listing(m, n, alg="md5", exclude_path=exclude, hardlink_is_unique=unique).filter("n_duplicates > 0").collect()}
            assert got == want


def test_tree_is_walked_and_read_once_a_round(spark, tmp_path, monkeypatch):
    """Every round is written once and read back: what is hashed comes from the round before, and the result from files that are there."""
    for k in range(6):
        (tmp_path / f"f{k}").write_bytes(b"a" * 5000 + bytes([k // 3]) * 5000)
    (tmp_path / "alone").write_bytes(b"z" * 77)
    rounds, plans, stage, hash_files = [], [], scan.stage, scan.hash_files
    monkeypatch.setattr(scan, "stage", lambda df, name: rounds.append((name, df.count())) or stage(df, name))
    monkeypatch.setattr(scan, "hash_files", lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or hash_files(df, *more))
    out = scan.duplicate_members(tree(spark, [str(tmp_path)]), Options(prefixes=(64, 6000)))
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert rounds == [("files", 7), ("prefix64", 6), ("prefix6000", 6), ("whole", 6)]
    assert len(plans) == 4 and not any("filetree" in p or "MapInArrow" in p for p in plans)
    assert out.count() == 6


def test_prefix_rounds_on_disk(spark, tmp_path):
    """Files that differ in their first bytes, in the middle, at the end, or not at all; short files are done after one round."""
    (tmp_path / "t").mkdir()
    body = bytes(range(256)) * 40
    kinds = {"a1": body, "a2": body, "first": b"x" + body[1:], "middle": body[:5000] + b"x" + body[5001:], "last": body[:-1] + b"x", "s1": b"tiny", "s2": b"tiny", "s3": b"tinx"}
    for name, data in kinds.items():
        (tmp_path / "t" / name).write_bytes(data)
    for prefixes in ((), (4,), (64, 8000), (16, 1 << 20)):
        for alg in ("xxhash", "sha512"):
            got = scan.duplicate_sets(tree(spark, [str(tmp_path / "t")]), Options(alg=alg, prefixes=prefixes)).collect()
            assert sorted(sorted(os.path.basename(p) for p in r.paths) for r in got) == [["a1", "a2"], ["s1", "s2"]]


def test_corpus_inodes_need_no_shuffle(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in document_files(d, True)._jdf.queryExecution().executedPlan().toString()
