"""The operators against SQL, the public libraries or brute force, and on awkward tables."""

import base64
import hashlib
import itertools
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from compare import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinfold.llm import ann, bpe, graph, mixing, near_dup, oracles, pii, ppm, quality, queries, token_count, token_file, toxicity
from twinfold.llm.common import place, release, shared_dir
from twinfold.plans.staging import listed

RANKS, JSON, MODEL = (P.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXT = st.text(alphabet="abeht in\n\t'!1é😀▁<s>", max_size=60)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    ok, why = same(queries.QUERIES[name](spark, sf_dir), oracles.ORACLES[name], sf_dir)
    assert ok, why


# 1


def test_nearest_odd(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (100, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"block": F.lit(1), "kind": F.lit("x"), "id": F.lit("y"), "vec": F.lit(2)})
    got = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 50 == 0, k=2).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (50, 1, 0), (50, 2, 1)]
    assert got[0][3] == 1.0 and abs(got[2][3] - math.sqrt(0.5)) < 1e-12
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def exact_nearest(rows, k=5):
    """Ranks by a plain loop over pairs."""
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None]
    out = []
    for q, v in {(i, tuple(x)) for i, x in fine if i % 50 == 0}:
        v = np.array(v)
        scores = [(-float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), i) for i, x in fine if i != q]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_magnitudes_of_any_size(spark):
    """Squares that overflow or vanish change nothing: cosines are those of the vectors scaled by powers of two."""
    rng = np.random.default_rng(5)
    plain = rng.standard_normal((400, 16))
    scale = 2.0 ** rng.integers(-900, 900, 400)
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(plain, scale, strict=True))]
    got = sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()))
    want = exact_nearest([(i, v.tolist()) for i, v in enumerate(plain)])
    assert [r[:3] for r in got] == [r[:3] for r in want] and max(abs(a[3] - b[3]) for a, b in zip(got, want, strict=True)) < 1e-12


@pytest.mark.parametrize("block", [None, 37])
def test_recall_against_exact_search(spark, sf_dir, block):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = exact_nearest([(r.vec_id, r.embedding) for r in e.collect()])
    got = sorted(map(tuple, ann.nearest(e, F.col("vec_id") % 50 == 0, block=block).collect()))
    hit = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(hit) >= 0.99 * len(want)
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(got, want, strict=True) if a[2] == b[2])


def test_nearest_with_repeated_rows(spark):
    """A query row that is there twice is asked once; another vector of its id is asked apart; a candidate that is there twice ranks twice."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(16))]) for i in range(1, 60)]
    rows += [rows[49], rows[4], (50, [float(x) for x in np.float32(rng.standard_normal(16))])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, block=9).collect()
    assert Counter(r["rank"] for r in got) == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2}
    assert [r[:3] for r in sorted(map(tuple, got))] == [r[:3] for r in exact_nearest(rows)]


# 2, 3, 10


@pytest.fixture(scope="module")
def libraries():
    """One of each, as workers that go from operator to operator would build them again and again."""
    return bpe.Codec(RANKS, P.PATTERN), token_file.LibraryEncoder(JSON), token_count.PieceCounter(MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_encoders_equal_libraries(tik, libraries, batch):
    codec, enc, pieces = libraries
    got = codec.encode(batch)
    assert [x.tolist() for x in got] == [tik.encode_ordinary(t) for t in batch]
    assert codec.decode(got) == [t.encode() for t in batch]
    flat, n = enc.encode(pa.array(batch))
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in batch]
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert [pieces.count(t) for t in batch] == [len(pieces.sp.encode(t)) for t in batch]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["foo", "bar", " ", "  ", "\n", "\n\n", "\t", "é", "###", "'s", "123", "\0", "\x1f", "<|endoftext|>", "<|endof", "text|>", "\r\n", "\u200b", "\xa0", "日本"]), max_size=12).map("".join), min_size=1, max_size=6))
def test_library_encoder_with_odd_spaces(libraries, batch):
    enc = libraries[1]
    flat, n = enc.encode(pa.array(batch))
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in batch]
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_long_words(tik, libraries):
    """Words beyond ``LONG``, with the dealt vocabulary: windows are put together, and a run that no two windows cut alike takes the query for whole words."""
    rng = np.random.default_rng(2)
    letters = lambda some, n: "".join(rng.choice(list(some), n))
    long = ["=" * 4999, "ab" * 700, letters("abcdefghij", 1500), "é" * 999, letters("日本語言葉", 800), " " * 300 + "x", "aab" * 333, "0" * 3001, "---!" * 500, "!---" * 77, letters("-=", 1200), "x" * 20_000, letters("abcdefghijklmnopqrstuvwxyz", 20_000)]
    got = libraries[0].encode(long)
    assert [x.tolist() for x in got] == [tik.encode_ordinary(t) for t in long] and libraries[0].decode(got) == [t.encode() for t in long]


def test_which_query_takes_long_words(tik, libraries, monkeypatch):
    codec, asked = libraries[0], []
    contract = codec._contract
    monkeypatch.setattr(codec, "_contract", lambda words, query=bpe._ENCODE: (asked.append((query is bpe._ENCODE_LONG, max(map(len, words)))), contract(words, query))[1])
    letters = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 5000))
    assert codec.long_word(letters.encode()).split() == [b"%d" % i for i in tik.encode_ordinary(letters)]
    assert asked and not any(whole for whole, _ in asked) and max(n for _, n in asked) <= bpe.WIDEST  # windows only
    asked.clear()
    assert codec.long_word(b"-" * 5000).split() == [b"%d" % i for i in tik.encode_ordinary("-" * 5000)]
    assert (True, 5000) in asked


def test_long_words_take_linear_time(tik, libraries):
    """A word of a megabyte; twice the length takes about twice the time."""
    import time

    took = []
    for n in (125_000, 250_000):
        word = "".join(np.random.default_rng(n).choice(list("abcdefghijklmnopqrstuvwxyz"), n))
        began = time.process_time()
        ids = libraries[0].long_word(word.encode())
        took.append(time.process_time() - began)
        assert ids.split() == [b"%d" % i for i in tik.encode_ordinary(word)]
    assert took[1] < 3 * took[0] + 1
    for word in ("=" * 1_000_000, "é漢" * 200_000):
        began = time.process_time()
        ids = libraries[0].long_word(word.encode())
        assert time.process_time() - began < 90 and ids.split() == [b"%d" % i for i in tik.encode_ordinary(word)]


def _falling(tmp_path):
    words = [bytes([i]) for i in range(256)] + [b"ab", b"xab", b"aba"]
    order = {w: i for i, w in enumerate(words)} | {b"xab": 256, b"ab": 257}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % i for w, i in order.items()))
    import tiktoken

    return bpe.Codec(str(tmp_path / "ranks"), ".+"), tiktoken.Encoding("falls", pat_str=".+", mergeable_ranks=order, special_tokens={})


def test_ranks_that_fall(tmp_path):
    """A vocabulary in which a merge makes a pair of a lower rank: both queries take that pair first."""
    codec, tik = _falling(tmp_path)
    for t in ("xabab" * 60, "abab" * 90, "ba" * 150 + "xab" * 70, "xab" * 3, "abxab" * 41):
        assert codec.encode([t])[0].tolist() == tik.encode_ordinary(t)
        assert codec._whole(t.encode()).split() == [b"%d" % i for i in tik.encode_ordinary(t)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab-= 0x", min_size=1, max_size=40))
def test_whole_words_equal_the_library(tik, libraries, text):
    for word in libraries[0].split(text):
        assert libraries[0]._whole(word.encode()).split() == [b"%d" % i for i in tik.encode_ordinary(word)]


def test_bpe_digests(docs, odd, empty, plain, tik):
    for r in bpe.digests(docs, RANKS, P.PATTERN).collect():
        ids = tik.encode_ordinary(plain[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()
    rows = bpe.digests(odd, RANKS, P.PATTERN).collect()
    texts = [r.text or "" for r in odd.collect()]
    assert Counter((r.n_tokens, r.decoded_sha256) for r in rows) == Counter((len(tik.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    back = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert Counter(bytes(r.bytes) for r in back.collect()) == Counter(t.encode() for t in texts)
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0


def test_small_memos(tik, plain):
    c = bpe.Codec(RANKS, P.PATTERN, encoded=50, decoded=50)
    some = list(plain.values())[:20]
    for t in some:
        ids = c.encode([t])
        assert ids[0].tolist() == tik.encode_ordinary(t) and c.decode(ids) == [t.encode()]


def test_token_files(spark, docs, odd, empty, plain):
    out = f"{shared_dir(spark)}/tok1"
    token_file.write_token_files(docs, JSON, out)
    lib, start = token_file.encoder(JSON).library, 0
    for r in token_file.read_token_files(spark, out).orderBy("doc_id").collect():
        ids = lib.encode(plain[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    wanted = spark.createDataFrame([(5,), (77,), (77,), (999,), (-1,), (None,)], "doc_id long")
    picked = {r.doc_id: r for r in token_file.read_documents(spark, out, wanted).collect()}
    everything = {r.doc_id: r for r in token_file.read_token_files(spark, out).filter("doc_id IN (5, 77, 999)").collect()}
    assert {i: (r.start, r.ids) for i, r in picked.items()} == {i: (r.start, r.ids) for i, r in everything.items()} and len(picked) == 3
    token_file.write_token_files(odd, JSON, f"{out}b")
    got = token_file.read_token_files(spark, f"{out}b").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9] and got[3].ids == [0]
    token_file.write_token_files(empty, JSON, f"{out}e")
    assert token_file.read_token_files(spark, f"{out}e").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_elias_fano(steps):
    v = np.concatenate(([0], np.cumsum(steps)))
    ef = token_file.Boundaries.of(v)
    ef = token_file.Boundaries.unpack(ef.pack(), ef.low_bits, ef.n)
    assert ef.selects(0, len(v)).tolist() == v.tolist() == [ef.select(i) for i in range(len(v))]
    a, b = sorted((steps[0] % (len(v) + 1), steps[-1] % (len(v) + 1)))
    assert ef.selects(a, b).tolist() == v[a:b].tolist()


def test_many_rows_of_one_id(spark):
    """Rows without an id, or with one id, are dealt to several files and blocks; the dataset is deleted with the staged tables."""
    d = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " * 40) for i in range(4000)], "doc_id long, text string")
    rows = token_file.token_blocks(d, JSON).select("file", "n_ids").collect()
    assert len(rows) == 1  # too little text for more than one file
    old, token_file.SMALL = token_file.SMALL, 100_000
    try:
        assert len({r.file for r in token_file.token_blocks(d, JSON).select("file").collect()}) >= 3
    finally:
        token_file.SMALL = old
    out = place(spark, "tokens")
    token_file.write_token_files(d, JSON, out)
    assert token_file.read_token_files(spark, out, False).agg(F.sum("n_tokens"), F.count("*")).first() == (sum(len(token_file.encoder(JSON).library.encode(f"text {i} " * 40).ids) + 1 for i in range(4000)), 4000)
    release()
    assert listed(spark, out) == []


def test_shared_folder_without_a_setting(tmp_path):
    """A plain local session gets a folder of its own; other masters are told to set one."""
    import subprocess
    import sys

    code = "from pyspark.sql import SparkSession\nimport os\nfrom twinfold.plans.staging import shared_dir, stage, release\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\nd = stage(s.range(5), 'x')\nprint(d.count(), shared_dir(s) == shared_dir(s), s.conf.get('spark.checkpoint.dir', 'unset'))\nw = shared_dir(s)[7:]\nrelease()\nprint(os.listdir(w))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(Path(__file__).resolve().parents[2]), env=dict(os.environ, PYTHONPATH=str(Path(__file__).resolve().parents[2]), SPARK_CONF_DIR=str(tmp_path)))
    assert "5 True unset" in done.stdout and "[]" in done.stdout, done.stderr[-2000:]

def test_token_counts(docs, odd, empty, plain):
    sp = token_count.counter(MODEL).sp
    for r in token_count.token_counts(docs, MODEL, 100).collect():
        n = len(sp.encode(plain[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(plain[r.doc_id].encode()), n, n > 100)
    assert Counter(r.n_tokens for r in token_count.token_counts(odd, MODEL).collect()) == Counter(len(sp.encode(r.text or "")) for r in odd.collect())
    assert token_count.token_counts(empty, MODEL).count() == 0


# 4


def brute_ppm(texts, learned, order):
    c = [defaultdict(Counter) for _ in range(order + 1)]
    for t in learned:
        q = b"\xff" * order + t + b"\xff"
        for p in range(order, len(q)):
            for j in range(order + 1):
                c[j][q[p - j : p]][q[p]] += 1

    def p_of(ctx, s):
        out, gone = 1.0, set()
        for j in range(order, -1, -1):
            left = {k: n for k, n in c[j][ctx[order - j :]].items() if k not in gone}
            total = sum(left.values())
            if s in left:
                return out * (2 * left[s] - 1) / (2 * total)
            if left:
                out *= len(left) / (2 * total)
                gone |= set(left)
        return out / (256 - len(gone))

    for t in texts:
        q = b"\xff" * order + t + b"\xff"
        yield sum(math.log10(p_of(q[p - order : p], q[p])) for p in range(order, len(q)))


def test_ppm(spark, odd, empty):
    """All documents of the smallest table, with one copy of each kind of awkward identifier."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in some}
    learned = [t for i, t in some.items() if not held[i]]
    counts = Counter(itertools.chain.from_iterable(t.lower().split() for t in learned))
    n, v = counts.total() + len(learned), len(counts) + 1
    scores = dict(zip(some, brute_ppm(some.values(), learned, ppm.ORDER), strict=True))
    for r in ppm.score(d).collect():
        words = some[r.doc_id].lower().split()
        base = [counts[w] for w in words] + [len(learned)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(base), sum(x > 0 for x in base), n)
        assert math.isclose(r.base_score, sum(math.log10((x + 1) / (n + v + 1)) for x in base), rel_tol=1e-9)
        assert math.isclose(r.score, scores[r.doc_id], rel_tol=1e-9)
    # Small blocks, in which a repeated row and rows without an id are dealt by their texts, give the same scores.
    again = d.unionByName(d.filter("doc_id = 3")).unionByName(d.filter("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long")))
    a, b = (sorted(((r.doc_id is None, r.doc_id, round(r.score, 6), r.train_tokens) for r in ppm.score(again, block_bytes=size).collect()), key=str) for size in (10_000, ppm.BLOCK))
    assert a == b and len(a) == len(some) + 5
    rows = ppm.score(odd).collect()
    assert len(rows) == 11 and all(r.score < 0 for r in rows) and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert ppm.score(empty).count() == 0


# 5, 6


def test_quality_odd(odd, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality.quality(odd).collect()}
    assert rows[2, 0].base_failed and rows[3, 0].base_failed and not rows[4, 0].kept
    assert rows[1, 10].n_repeat_words == 10 and rows[1, 10].n_dup_lines == 1
    assert rows[7, 30001].n_repeat_words == 30000
    assert quality.quality(empty).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_keeps_clean(docs, spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/labels.parquet").join(quality.quality(docs), "doc_id").filter("NOT base_failed")
    assert m.filter("quality = 1 AND NOT kept").count() == 0 and m.filter("quality = 0 AND kept").count() == 0


def brute_pii(t):
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ (14)%9\n", max_size=60))
def test_pii_base(t):
    assert [x[:3] for x in pii.spans(t) if x[0] in pii.BASE] == brute_pii(t)


def test_pii_rows(docs, odd, empty, plain):
    for r in pii.pii_spans(docs).collect():
        base = brute_pii(plain[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.BASE)
        found = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in found if k in pii.BASE] == base and len(r.scores) == len(found)
        assert all(0 <= x <= 1 for x in r.scores) and all(x >= pii.THRESHOLD for x, f in zip(r.scores, found, strict=True) if f[0] not in pii.BASE)
    (r,) = pii.pii_spans(odd).filter("doc_id = 8").collect()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert pii.pii_spans(empty).count() == 0
    (c,) = pii.redact(odd).filter("doc_id = 8").collect()
    assert "<EMAIL>" in c.text and "4111" not in c.text and c.n_chars == len(c.text)


def test_pii_checksums_and_context():
    found = lambda t: [x[0] for x in pii.spans(t)]
    assert found("pay to IBAN GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert found("GB83 WEST 1234 5698 7654 32") == []
    assert found("ssn 123-45-6789") == ["ssn"] and found("code 123-45-6789") == []
    near, far = pii.spans("mail a@b.co")[0][3], pii.spans("version example a@b.co")[0][3]
    assert near > far


# 7


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    t = mixing.targets([10, 1000, 0], [3, 1, 1])
    assert t == [30, 980, 0]


def test_min_cost_flow():
    # the shared pattern goes to the source that has nothing else
    flows = mixing.min_cost_flow([10, 10], [[0], [0, 1]], [10, 10])
    assert sorted(flows) == [(0, 0, 0, 10), (1, 0, 1, 10)]
    flows = mixing.min_cost_flow([10], [[0]], [25])
    assert flows == [(0, 0, 0, 10), (0, 1, 0, 10), (0, 2, 0, 5)]


def test_mix(docs, odd, empty):
    a, b = (sorted(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert a == b
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for _, size, source_size, target, taken, source in a:
        assert taken % max(1, size) == 0 and taken <= 3 * size
        by[source][0] += size
        by[source][1] += taken
        by[source][2:] = target, max(by[source][3], size)
        assert source_size > 0
    assert math.isclose(sum(x[2] for x in by.values()), sum(x[0] for x in by.values()))
    # Whole documents are taken, so a source of 50 documents may lack less than one of them; on average it is far closer.
    assert all(abs(taken - target) < largest for _, taken, target, largest in by.values())
    assert sum(abs(taken - target) / target for _, taken, target, _ in by.values()) / len(by) < 0.02
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and len({r.taken for r in rows if r.doc_id == 1}) == 1
    assert {(r.doc_id, r.source) for r in rows if r.source is None} == {(2, None), (5, None)} and mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def brute_targets(sizes, weights):
    """Shares by bisection on the level at which weight times level, at most thrice the size, sums to the total."""
    total, low, high = sum(sizes), 0.0, 1e15
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * n, w * mid) for n, w in zip(sizes, weights, strict=True)) < total else (low, mid)
    return [min(3 * n, w * low) for n, w in zip(sizes, weights, strict=True)]


def test_threshold_is_compared_on_training_rows():
    """Parts that the fit left out decide; a threshold that no word reaches finds nothing, and rows that are alike in all parts are found."""
    rng = np.random.default_rng(8)
    rows = [(k % 4, np.unique(np.append(rng.integers(10, 5000, 30), [3] if k % 3 == 0 else [])).astype(np.int32), k % 3 == 0) for k in range(240)]
    got = toxicity.compared(rows, (toxicity.SURE, 1e9))
    assert got[toxicity.SURE][0] == 1.0 and got[toxicity.SURE][1] < 0.05 and got[1e9][0] == 0.0


def test_labels_of_held_out_rows_and_repeats_change_nothing(spark):
    text = lambda i: "nasty words here" if i % 4 == 0 else f"plain talk {i % 7}"
    docs = spark.createDataFrame([(i, text(i), "en", "s", 1) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = [(i, 0, int(i % 4 == 0)) for i in range(200)]
    schema = "doc_id long, quality int, toxic int"
    first, prior = toxicity.train(docs, spark.createDataFrame(marks, schema))
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    for other in (marks + marks[:50], flipped):
        again, same_prior = toxicity.train(docs, spark.createDataFrame(other, schema))
        assert prior == same_prior and np.array_equal(first, again)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=5), st.integers(0, 3), st.integers(0, 300))
def test_nearest_sum(sizes, copies, goal):
    times = mixing.nearest_sum(sizes, copies, goal)
    sums = {sum(n * k for n, k in zip(sizes, x, strict=True)) for x in itertools.product(range(copies + 1), repeat=len(sizes))}
    best = min(sums, key=lambda x: (abs(x - goal), x))
    assert all(0 <= k <= copies for k in times) and sum(n * k for n, k in zip(sizes, times, strict=True)) == best


@pytest.mark.parametrize("sf", ["0.01", "0.001"])
def test_mix_meets_each_target(spark, sf):
    d = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    own = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")), r.source) for r in d.collect()}
    sizes = Counter()
    for n, source in own.values():
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, brute_targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = Counter()
    for r in mixing.mix(d).collect():
        assert (r.size, r.source) == own[r.doc_id] and r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9)
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) < 0.02 * t for s, t in goal.items())


def brute_flow(supply, members, quotas):
    """Most words, then the least cost, by trying every way."""
    best = (0, 0)

    def go(i, left, used, sent):
        nonlocal best
        if i == len(arcs):
            cost = sum(max(0, u - supply[p]) + max(0, u - 2 * supply[p]) for p, u in enumerate(used))
            best = max(best, (sent, -cost))
            return
        p, s = arcs[i]
        for n in range(min(left[s], 3 * supply[p] - used[p]) + 1):
            go(i + 1, [x - n * (j == s) for j, x in enumerate(left)], [x + n * (j == p) for j, x in enumerate(used)], sent + n)

    arcs = [(p, s) for p, m in enumerate(members) for s in m]
    go(0, quotas, [0] * len(supply), 0)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sets(st.integers(0, 2), min_size=1, max_size=2)), min_size=1, max_size=3), st.lists(st.integers(0, 4), min_size=3, max_size=3))
def test_flow_is_of_least_cost(patterns, quotas):
    supply, members = [n for n, _ in patterns], [sorted(m) for _, m in patterns]
    flows = mixing.min_cost_flow(supply, members, quotas)
    got, cost = Counter(), 0
    for p, r, s, n in flows:
        assert s in members[p]
        got[s] += n
        cost += r * n
    assert all(got[s] <= quotas[s] for s in got)
    assert (sum(got.values()), -cost) == brute_flow(supply, members, quotas)


def plan_of(d, weight):
    """``size``, ``copies`` and the sources of a table with id, of and words."""
    base = mixing.measured(d, F.col("of"), F.col("words"), F.col("id"))
    table, sources = mixing.plan(base, weight)
    return mixing.taken(base, table), sources


def test_mix_with_one_large_document(spark):
    """Targets from few words to nearly thrice the source; the large document is at the edge of some of them."""
    sizes = [60000] + [50 + 7 * i % 101 for i in range(200)]
    d = spark.createDataFrame([(i, s, n) for s in range(12) for i, n in enumerate(sizes, 1000 * s)], "id long, of long, words long").withColumn("of", F.array(F.format_string("s%02d", "of")))
    took, sources = plan_of(d, lambda i: 1.0 + i)
    rows = took.collect()
    assert max(len(r.copies) for r in rows) <= 3
    n = Counter()
    for r in rows:
        for s in r.copies:
            n[s] += r["size"]
    off = {r.position: abs(n[r.position] - r.target) / r.target for r in sources.collect()}
    assert len(off) == 12 and max(off.values()) < 0.02, off


def test_overlapping_sources(spark):
    d = spark.createDataFrame([(i, ["a"] if i < 50 else ["a", "b"], 10) for i in range(100)], "id long, of array<string>, words long")
    took, _ = plan_of(d, lambda i: 1.0)
    n = Counter(s for r in took.collect() for s in r.copies)
    assert abs(n[0] - 50) <= 1 and abs(n[1] - 50) <= 1


# 8


def test_toxicity_held_out(spark, docs, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = toxicity.score(d, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    pos, neg = m[m.toxic == 1].score.to_numpy(), m[m.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg).mean() > 0.8 and (neg >= 0.5).mean() < 0.02
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False] and [r.held_out for r in rows if r.doc_id == 7] == [zlib.crc32(b"7") % 5 == 0]
    assert {r.score for r in toxicity.score(docs.limit(3), labels.limit(0)).collect()} == {0.01}
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_found_in_each_language(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = toxicity.score(d, labels).filter("held_out").join(labels.filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    found = m[m.toxic == 1].groupby("lang").predicted.mean()
    assert all(found[x] >= least for x, least in (("en", 0.8), ("fr", 0.8), ("de", 0.6), ("es", 0.3)))
    assert m[m.toxic == 1].predicted.mean() > 0.8 and m[m.toxic == 0].predicted.mean() < 0.01


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1 << 30), st.floats(0.01, 0.5), st.floats(-3, 3))
def test_nnpu_risk_and_gradient(seed, prior, bias):
    """Against a loop over the texts, and the gradient against differences."""
    rng = np.random.default_rng(seed)
    kept, n = np.arange(6), 6
    rows = [[np.flatnonzero(rng.random(n) < 0.4).astype(np.int32) for _ in range(k)] for k in (4, 9)]
    w = np.append(rng.standard_normal(n), bias)
    p, u = (toxicity._flattened(x, kept) for x in rows)

    def parts(w):
        z = [[sum(w[i] for i in r) + w[-1] for r in x] for x in rows]
        loss = lambda x, sign: sum(math.log1p(math.exp(-sign * v)) for v in x) / len(x)
        return prior * loss(z[0], 1), loss(z[1], -1) - prior * loss(z[0], -1)

    plus, inner = parts(w)
    risk, g = toxicity.step_of(w, p, u, prior)
    assert math.isclose(risk, plus + max(0.0, inner), rel_tol=1e-9, abs_tol=1e-12)
    of = (lambda x: sum(parts(x))) if inner >= 0 else (lambda x: -parts(x)[1])
    for i in range(n + 1):
        d = np.zeros(n + 1)
        d[i] = 1e-5
        assert abs((of(w + d) - of(w - d)) / 2e-5 - g[i]) < 1e-6


def test_nnpu_finds_the_word():
    rng = np.random.default_rng(0)
    noise = lambda: np.unique(rng.integers(100, 5000, 40)).astype(np.int32)
    bad = lambda: np.unique(np.append(noise(), 7)).astype(np.int32)
    w = toxicity.fit([bad() for _ in range(200)], [bad() if rng.random() < 0.1 else noise() for _ in range(1000)], 0.1)
    assert w[7] + w[-1] > 0 > w[-1]


# 9


def brute_groups(rows, size=4):
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    up = {i: i for i in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(rows), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(sets[i]), top(i)) for i in rows}


def test_near_duplicates_of_one_text(spark):
    """A base with variants around the threshold: most variants are linked by the base alone."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = {}
    for i in range(300):
        w = list(base)
        for k in rng.choice(200, rng.integers(0, 12), replace=False):
            w[k] = f"x{rng.integers(1 << 30)}"
        rows[i] = " ".join(w)
    rows[900] = "Other text here" * 3
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_groups(rows)


def test_near_duplicates_with_low_estimates(spark):
    """Pairs of similarity 0.8 that share a band, and whose registers agree by chance in less than 0.71."""
    rows = {}
    for i, seed in enumerate((864, 975, 3276, 5078)):
        w = [f"{seed}w{k}" for k in range(48)]
        rows[2 * i], rows[2 * i + 1] = " ".join(w), " ".join(w[:43] + [f"{seed}x{k}" for k in range(5)])
        x, y = (near_dup.registers(near_dup.shingles(rows[2 * i + k])) for k in range(2))
        assert near_dup.estimate(np.array([(x == y).sum()]), 45, [45])[0] < 0.71 and set(near_dup.bands(x)) & set(near_dup.bands(y))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_groups(rows) and {c for _, c in got.values()} == {0, 2, 4, 6}


def test_near_duplicates_odd(odd, empty):
    rows = sorted(map(tuple, near_dup.near_duplicates(odd).collect()), key=str)
    by = {r[0]: r for r in rows}
    assert by[1][2] == 1 and by[None][2] == 1 and not by[None][3]
    assert by[5][2] == by[6][2] == 5 and by[6][3] is False
    assert by[2][1:] == (0, 2, True) and by[4][1:] == (0, 4, True) and len(rows) == 11
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.keep_one(odd).count() == 9


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    for share in (0.5, 0.8):
        k = int(2000 * 2 * share / (1 + share))
        a, b = x[:2000], x[2000 - k : 4000 - k]
        equal = (near_dup.registers(a) == near_dup.registers(b)).sum()
        assert abs(near_dup.estimate(equal, 2000, np.array([2000])) - share) < 0.15


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, graph.components(e).collect()))
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_registered():
    assert [re.match(r"op(\d+)_", k)[1] for k in queries.QUERIES] == [str(i) for i in range(1, 11)]


def test_nnpu_without_telling_slots():
    rows = [np.array([i], np.int32) for i in range(20)]
    w = toxicity.fit(rows[:5], rows[5:], 0.1)
    assert not w[:-1].any() and np.isfinite(w[-1])
