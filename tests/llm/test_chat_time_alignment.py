"""Chat examples, point-in-time features and tokenizer alignment against brute force, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinfold.llm import alignment, chat, oracles, queries
from twinfold.llm import point_in_time as pit

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

# 11

MARKED = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE]", "[/TURN]", "\\", " ", "a", "<", "[", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[/ROLE]\\"]), MARKED), max_size=6))
def test_template_is_reversible(turns):
    assert list(chat.parsed("".join(chat.formatted(*t)[0] for t in turns))) == turns


def brute_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "user", "</s>[INST] \\[INST]"), (1, 1, "assistant", " \\</s> "), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "b"), (3, 5, None, "x"), (3, 5, "tool", "[ROLE] y"),
    (3, None, "assistant", "first"), (3, None, "assistant", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, -3, "assistant", "é😀" * 2000), (4, 700, "assistant", "end"),
]
CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("section", "chars"), [(64, 1_000_000), (1, 50), (3, 1)])
def test_chat_odd(spark, section, chars):
    rows = ROWS + [(9, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(150)]
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("clash") for c in ("section", "part", "example", "closes", "chars", "target")})
    made = chat.examples(df, section, chars).cache()
    back = chat.read_back(made).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back), key=str) == brute_chat(rows)
    replies = Counter(c for c, _, role, _ in rows if role == "assistant")
    got = made.filter("mask_end > 0").collect()
    assert Counter(r.conv_id for r in got) == replies  # one example for each reply
    whole = {(r.conv_id, r.section, r.part, r.example): r.text for r in chat.whole_text(made).collect()}
    context = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        context[conv].append((role or "", text or ""))
    ends = defaultdict(list)
    for r in got:
        full = whole[r.conv_id, r.section, r.part, r.example]
        turns = list(chat.parsed(full))
        assert turns == context[r.conv_id][: len(turns)] and turns[-1] == ("assistant", chat.unescaped(r.text[r.mask_start : r.mask_end]))
        ends[r.conv_id].append(len(turns))
    for conv, n in ends.items():
        assert sorted(n) == [k + 1 for k, (role, _) in enumerate(context[conv]) if role == "assistant"]
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_chat_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op11_chat(spark, sf_dir).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=str) == brute_chat(rows)


def test_examples_hold_their_whole_context(spark):
    """Rows by themselves, without any other row: across sections, also far apart ones, and beyond a megabyte."""
    turns = [(1, i, ("user", "assistant", "tool")[i % 3], f"turn {i} <s>") for i in range(200)] + [(1, 10**12, "assistant", "far"), (1, None, "system", "first")]
    turns += [(2, i, ("user", "assistant")[i % 2], f"{i}é" * 200_000) for i in range(6)] + [(None, i, ("user", "assistant")[i % 2], f"{i}") for i in range(0, 400, 3)]
    df = spark.createDataFrame(turns, CONV)
    context = defaultdict(list)
    for conv, turn, role, text in sorted(turns, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        context[conv].append((role, text))
    got = defaultdict(list)
    for r in chat.examples(df).filter("mask_end > 0").collect():
        read = list(chat.parsed(r.text))
        assert read == context[r.conv_id][: r.n_turns] and read[-1] == ("assistant", chat.unescaped(r.text[r.mask_start : r.mask_end]))
        got[r.conv_id].append(r.n_turns)
    assert {c: sorted(n) for c, n in got.items()} == {c: [k + 1 for k, (role, _) in enumerate(t) if role == "assistant"] for c, t in context.items()}


def test_chat_equals_sql_beyond_a_section(spark, tmp_path):
    import duckdb

    rows = ROWS + [(9, i, ("user", "assistant", "tool")[i % 3], f"turn {i} </s>") for i in range(300)] + [(10, i % 5, ("user", "assistant")[i % 2], f"{i}é[INST]" * 30_000) for i in range(12)]
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = con.sql(oracles.OP11).fetchall()
    assert sorted(map(tuple, queries.op11_chat(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


# 12

T0 = datetime(2024, 2, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def us(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def brute_features(clicks, sales, lines, windows=(2, 14)):
    day, delay = timedelta(days=1), timedelta(minutes=240)
    cents = lambda x: int(np.floor(100 * x + 0.5)) if x is not None and np.isfinite(x) else 0
    clicks = [c for c in dict.fromkeys(clicks) if None not in (c[1], c[2], c[3])]
    own = [s for s in sales if s[1] is not None and s[4] is not None]
    of = defaultdict(list)
    for x in lines:
        of[x[0]].append(x)
    out = []
    for s in own:
        t = s[4] + timedelta(seconds=zlib.crc32(str(s[0]).encode() if s[0] is not None else b"") % 259200)
        label = any(o[1] == s[1] and t < o[4] <= t + 7 * day for o in own)
        for d in windows:
            c = [x for x in clicks if x[3] == s[1] and t - d * day < x[1] <= t and x[2] + delay <= t]
            known = [o for o in own if o[1] == s[1] and t - d * day < o[4] <= t and o[5] is not None and o[5] + delay <= t]
            its = [x for o in known if o[0] is not None for x in of[o[0]] if x[8] is not None and x[8] <= t]
            last = max(c, key=lambda x: (x[1], x[0] is not None, x[0] or 0), default=(None,))[0]
            out.append((s[0], d, us(t), label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(known), sum(cents(o[3]) for o in known), len(its), len({x[2] for x in its if x[2] is not None}), sum(cents(x[5]) for x in its)))
    return sorted(out, key=str)


def shop(seed, n, hot):
    """A small shop with late, early, missing and repeated rows, ties, and a client (and sale, and item) that has ``hot`` of all rows."""
    r = random.Random(seed)
    when = lambda: T0 + timedelta(hours=r.randrange(24 * 40)) if r.random() < 0.5 else T0 + timedelta(microseconds=r.randrange(40 * pit.DAY))
    late = lambda t: r.choice([t, t, t + timedelta(minutes=r.randrange(600)), t - timedelta(hours=3), t + timedelta(days=r.randrange(20)), None])
    client = lambda: 7 if r.random() < hot else r.choice([1, 2, 3, None])
    amount = lambda: r.choice([1.005, 2.675, -3.333, 1e6 / 7, None, float("nan"), float("inf")])
    clicks = []
    for i in range(n):
        t = when() if r.random() > 0.03 else None
        clicks.append((r.choice([i, i, None]), t, late(t) if t else T0, client(), r.choice(["purchase", "view", None]), amount(), r.choice(["{}", None])))
    clicks += r.sample(clicks, n // 5)
    sales = []
    for i in range(n // 2):
        t = when() if r.random() > 0.03 else None
        sales.append((i, client(), "done", amount(), t, late(t) if t else T0, 1))
    lines = [(0 if r.random() < hot else r.choice([*range(n // 2), n * 9, None]), 1, 5 if r.random() < hot else r.choice([1, 2, 3, None]), 1, 1, amount(), 0.0, "", (T0 + timedelta(days=r.randrange(60))) if r.random() > 0.05 else None) for _ in range(2 * n)]
    return clicks, sales, lines


def asked(spark, tables, **options):
    frames = [spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("client", "cell", "x", "w", "id", "day", "width", "v")}) for rows, schema in zip(tables, (CLICKS, SALES, LINES), strict=True)]
    return sorted(map(tuple, pit.features(*frames, **options).collect()), key=str)


@pytest.mark.parametrize(("seed", "hot", "most", "chunk"), [(1, 0.3, 20_000, 512), (2, 0.6, 40, 16), (3, 0.9, 3, 5)])
def test_features_equal_brute_force(spark, seed, hot, most, chunk):
    tables = shop(seed, 240, hot)
    assert asked(spark, tables, most=most, chunk=chunk) == brute_features(*tables)


def test_features_odd(spark):
    clicks, sales, lines = shop(4, 60, 0.5)
    sales += [(None, 7, None, None, T0, T0, None)]
    assert asked(spark, (clicks, sales, lines), most=10) == brute_features(clicks, sales, lines)
    same = [(0, 7, "", 1.0, T0, T0, 1), (1, 7, "", 1.0, T0, T0, 1)]
    burst = [(0, 1, i % 3, 1, 1, 1.0, 0.0, "", T0) for i in range(300)]  # all at one instant
    assert asked(spark, ([], same, burst), most=5) == brute_features([], same, burst)
    assert asked(spark, (clicks, [], lines)) == [] and asked(spark, ([], [], [])) == []
    assert asked(spark, ([], sales, []), most=5) == brute_features([], sales, [])


def test_repeated_sales_count_each_time(spark):
    row = (5, 7, "", 1.0, T0, T0 - timedelta(days=1), 1)
    got = asked(spark, ([], [row, row], [(5, 1, 1, 1, 1, 2.0, 0.0, "", T0)]))
    assert len(got) == 4 and [r[8:] for r in got if r[1] == 14] == [(2, 200, 2, 1, 400)] * 2  # the sale is more than two days back


def test_times_without_zone_are_utc(spark):
    tables = shop(6, 40, 0.5)
    want = brute_features(*tables)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert asked(spark, tables) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hot_client_is_cut_without_large_broadcasts(spark):
    """The cells of one client are dealt to several tasks, none with more rows than a few cells."""
    clicks, sales, lines = shop(7, 1200, 0.95)
    made = [spark.createDataFrame(rows, schema) for rows, schema in zip((clicks, sales, lines), (CLICKS, SALES, LINES), strict=True)]
    rows = pit.stage(pit.events(*made), "events")
    hot = rows.filter("client = 7").withColumn("width", F.lit(pit.DAY))
    cells = pit.cut(hot).groupBy("cell").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert cells[1] > 30 and cells[0] < 0.15 * cells[2] and cells[2] < 4 * hot.count()


# 13


@pytest.fixture(scope="module")
def pair():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def brute_alignment(rows, pair):
    """Every text by itself; pairs that overlap found by comparing ranges."""
    a, b = pair
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    of = {chr(x if x in plain else next(other)): x for x in range(256)}
    spans = lambda raws: list(zip(np.cumsum([0, *map(len, raws)])[:-1].tolist(), np.cumsum(list(map(len, raws))).tolist(), strict=True))
    heads, links, counts, most = [], [], Counter(), Counter()
    for _, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(map(of.__getitem__, a.id_to_token(i))) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            heads.append((0, 0, 0, ""))
            links.append([])
            continue
        at, bt, mine, j = spans(raw_a), spans(raw_b), [], 0
        for i, (start, end) in zip(ids_a, at, strict=True):
            while bt[j][1] <= start:
                j += 1
            k = j
            while k < len(bt) and bt[k][0] < end:
                mine.append((i, ids_b[k]))
                k += 1
        groups, x, y = [], 0, 0
        for cut in sorted({e for _, e in at} & {e for _, e in bt}):
            p, q = x, y
            while x < len(at) and at[x][1] <= cut:
                x += 1
            while y < len(bt) and bt[y][1] <= cut:
                y += 1
            groups.append(",".join(map(str, ids_a[p:x])) + "|" + ",".join(map(str, ids_b[q:y])))
        heads.append((len(ids_a), len(ids_b), len(groups), sha(";".join(groups))))
        links.append(mine)
        counts.update(mine)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted(((i, *h[:3], len(m), sum(counts[x] == most[x[1]] for x in m), sum(counts[x] for x in m), h[3]) for (i, _), h, m in zip(rows, heads, links, strict=True)), key=str)


def aligned(df, **options):
    return sorted((tuple(r)[:8] for r in alignment.align(df, JSON, MODEL, **options).collect()), key=str)


SPACED = ["a\n\n\nb", " x", "x ", "  ", "\n", "\n\n a", "a  b   c\n", "a\tb\n c", "▁x y", "<0x41> <s> </s> <unk>", "it's 'll 3rd x　y", "a \n b", "a\n b\nc", "\x1cq\x1c w", "é́ ​ z", "a\0b \0"]


@pytest.mark.parametrize("block", [6_000_000, 40])
def test_alignment_odd(spark, odd, empty, pair, block):
    more = spark.createDataFrame([(20 + i, t) for i, t in enumerate(SPACED)], "doc_id long, text string")
    df = odd.unionByName(more, allowMissingColumns=True)
    assert aligned(df, block_links=block) == brute_alignment([(r.doc_id, r.text) for r in df.collect()], pair)
    assert aligned(empty) == []


def test_alignment_query(spark, sf_dir, pair):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r)[:8] for r in queries.op13_alignment(spark, sf_dir).collect()), key=str)
    assert got == brute_alignment(rows, pair)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeht in\n\t'!1é😀▁<s>", max_size=60))
def test_alignment_of_any_text(pair, text):
    one = alignment.Aligner.__new__(alignment.Aligner)
    one.__dict__.update(alignment.aligner(JSON, MODEL).__dict__)
    (head,) = one.aligned([text])
    (want,) = brute_alignment([(0, text)], pair)
    assert (*head[:3], len(head[4]), head[3]) == (*want[1:5], want[7])


def test_segments_are_merged_together(pair):
    """One segment that is not given back does not make its neighbours be merged one by one, nor do spaces within segments."""
    one = alignment.Aligner(JSON, MODEL)
    calls, plain = [], one.encoded
    one.encoded = lambda text: calls.append(len(text)) or plain(text)
    texts = [" ".join(f"w{i}" for i in range(2000)) + " \u2581x", "  ".join(f"w{i} v{i}\t{i}" for i in range(1000)), "w1 w2", "\tw3  \n"]
    got = one.aligned(texts)
    assert len(calls) < 60  # 3003 when they were
    want = brute_alignment(list(enumerate(texts)), pair)
    assert [(*h[:3], len(h[4]), h[3]) for h in got] == [(*w[1:5], w[7]) for w in want]
    assert len(one.memo.now["w1999"][2]) == 4 * 5  # four bytes for a pair


def test_small_memo_changes_nothing(pair):
    words = [*"abcdefghij", "it's", "x\ty", "\u2581", "été", "12.5", ""]
    r = random.Random(1)
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "\n", "  "]) for _ in range(r.randrange(12))) for _ in range(300)]
    one = alignment.Aligner(JSON, MODEL, memo=7)
    got = [h for k in range(0, 300, 20) for h in one.aligned(texts[k : k + 20])]
    want = sorted(brute_alignment(list(enumerate(texts)), pair))
    assert [(*h[:3], len(h[4]), h[3]) for h in got] == [(*w[1:5], w[7]) for w in want]
