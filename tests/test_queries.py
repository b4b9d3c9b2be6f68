"""Every registered query of the engine against its SQL."""

import pytest
from compare import same

from twinfold import queries as engine


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    ok, why = same(engine.QUERIES[name](spark, sf_dir), engine.ORACLES[name], sf_dir)
    assert ok, why


def test_known_counts(spark, sf_dir):
    sets = engine.sets(spark, sf_dir)
    assert sets.count() == 62
    assert sets.agg({"count": "sum"}).first()[0] == 135


@pytest.mark.parametrize("alg", ["sha512", "xxhash"])
def test_digests_without_sql(spark, sf_dir, alg):
    import hashlib

    import xxhash

    want = {r.path: bytes(r.content) for r in engine.files(spark, sf_dir).select("path", "content").collect()}
    digest = (lambda c: hashlib.sha512(c).hexdigest()) if alg == "sha512" else (lambda c: xxhash.xxh64(c, seed=1).digest()[::-1].hex())
    assert {r.path: r.digest for r in engine.QUERIES[f"digest_{alg}"](spark, sf_dir).collect()} == {p: digest(c) for p, c in want.items()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


