"""The pipeline, stage by stage, against the operators' brute-force versions."""

import hashlib
import re
from collections import Counter

from compare import oracle_rows
from test_operators import brute_groups, brute_pii, brute_targets, tik  # noqa: F401

import corpus_pipeline as pipeline
from twinfold.llm import oracles


def covered(text):
    """The code points of all base kinds' spans, by brute force."""
    return {i for _, a, b in brute_pii(text) for i in range(a, b)}


def follows(text, clean):
    """Whether ``clean`` is ``text`` with some pieces put as a kind in angle brackets, which hold all that ``covered`` names; everything else is untouched."""
    pieces = re.split("<(?:EMAIL|IP|CARD|PHONE|IBAN|SSN)>", clean)
    left, at = covered(text), 0
    for k, piece in enumerate(pieces):
        at = text.find(piece, at) if k < len(pieces) - 1 else len(text) - len(piece)
        if at < 0 or text[at : at + len(piece)] != piece or left & set(range(at, at + len(piece))):
            return False
        at += len(piece)
    return True


def test_stages(spark, tik):  # noqa: F811
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = {r.doc_id: r.text for r in docs.collect()}
    step = dict(pipeline.STAGES)
    assert len(pipeline.STAGES) == 5

    good = step["quality rules"](spark, docs, sf).cache()
    names, verdicts = oracle_rows(oracles.OP5, sf)  # by SQL
    kept = {dict(zip(names, v, strict=True))["doc_id"] for v in verdicts if dict(zip(names, v, strict=True))["kept"]}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == columns

    one = step["near-duplicates"](spark, good, sf).cache()
    groups = brute_groups({i: held[i] for i in kept}, 5)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in groups.items() if i == c) and one.columns == columns

    clean = step["personal data"](spark, one, sf).cache()
    for r in clean.collect():
        assert not brute_pii(r.text) and r.n_chars == len(r.text) and follows(held[r.doc_id], r.text)
        assert covered(held[r.doc_id]) or r.text == held[r.doc_id] or re.search("<(IBAN|SSN)>", r.text)

    mixed = step["mixing"](spark, clean, sf).cache()
    assert mixed.columns == columns
    rows = {r.doc_id: r for r in clean.collect()}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in rows.items()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(got.values()) <= 3 and all(tuple(r) == tuple(rows[r.doc_id]) for r in mixed.collect())  # rows as they were, three times at most
    sources = sorted({r.source for r in rows.values()}, key=lambda x: (x is None, x or ""))
    sizes = [sum(words[i] for i, r in rows.items() if r.source == x) for x in sources]
    for x, goal in zip(sources, brute_targets(sizes, [1 + k % 3 for k in range(len(sources))]), strict=True):
        taken = sum(n * words[i] for i, n in got.items() if rows[i].source == x)
        own = sorted(words[i] for i, r in rows.items() if r.source == x)
        assert abs(taken - goal) < max(0.02 * goal, own[0] + 1), (x, taken, goal)

    texts = {r.doc_id: r.text for r in clean.collect()}
    rows = step["tokens"](spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in rows) == got
    for r in rows:
        assert r.n_tokens == len(tik.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pipeline.run(spark, sf).collect()))


def test_awkward_tables(spark, odd, empty):
    """Every stage on nulls, empty, long and repeated texts, clashing columns and no rows at all."""
    sf = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        for name, step in pipeline.STAGES[:-1]:
            out = step(spark, docs, sf)
            rows = sorted(map(str, out.collect()))
            held = sorted(map(str, docs.collect()))
            assert out.columns == odd.columns, name
            if name in ("quality rules", "near-duplicates"):  # rows that stay are rows as they were
                assert set(rows) <= set(held) and len(rows) <= len(held)
            elif name == "personal data":
                assert len(rows) == len(held) and (not held or rows != held)
            else:
                assert set(rows) <= set(held) and (not held or rows)
        assert pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    step = dict(pipeline.STAGES)
    assert step["near-duplicates"](spark, odd, sf).filter("doc_id = 1").count() == 2  # repeated rows of the doc_id that is kept
    clean = {(r.doc_id, r.text) for r in step["personal data"](spark, odd, sf).collect()}
    assert (2, None) in clean and (3, "") in clean
    again = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert again.unionByName(again).count() == step["personal data"](spark, again.unionByName(again), sf).count()
