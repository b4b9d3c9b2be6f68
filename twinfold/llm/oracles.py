"""DuckDB SQL for those production queries that SQL can express in reasonable time on whole tables.

None is given for byte-pair encodings (2, 3, 10, 13), PPM (4), span offsets (6), the greedy hash-ordered mix (7) and the trained
classifier (8); tests/llm compares these with brute-force versions.
"""

from __future__ import annotations

from .chat import MARKS, OTHER, SECTION, TARGET
from .point_in_time import DAY, DELAY_MINUTES, LABEL, SPREAD, WINDOWS
from .quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH e AS (
    SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
    WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), q AS (
    SELECT DISTINCT vec_id, v, len FROM e WHERE vec_id % 50 = 0
), s AS (
    SELECT q.vec_id AS query_id, q.v, c.vec_id, list_inner_product(q.v, c.v) / (q.len * c.len) AS score
    FROM q JOIN e c ON q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_METRICS = {
    "mean_word_length": "coalesce(word_chars / nullif(n_words, 0), 0)",
    "symbols_per_word": "coalesce(n_symbols / nullif(n_words, 0), 0)",
    "n_stop_words": "n_stop",
    "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
    "bullet_line_ratio": "coalesce(n_bullets / nullif(n_lines, 0), 0)",
    "ellipsis_line_ratio": "coalesce(n_ellipses / nullif(n_lines, 0), 0)",
    "exclamations_per_word": "coalesce(n_exclamations / nullif(n_words, 0), 0)",
}


def _fails(metric: str, least: float | None, most: float | None) -> str:
    tests = [f"{_METRICS[metric]} < {least}"] * (least is not None) + [f"{_METRICS[metric]} > {most}"] * (most is not None)
    return " OR ".join(tests)


_FAILED = ", ".join(f"CASE WHEN {_fails(metric, least, most)} THEN '{name}' END" for name, metric, least, most in RULES)
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP5 = rf"""
WITH d AS (
    SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), g AS (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS x FROM d WHERE len(w) >= 3
), r AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([x.i, x.i + 1, x.i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x.g) AS k FROM g) WHERE k > 1
    ) GROUP BY doc_id
), m AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclamations,
        len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipses,
        len(list_distinct(list_filter(w, lambda x: list_contains([{_STOPS}], x)))) AS n_stop
    FROM d LEFT JOIN r USING (doc_id)
), v AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {_FAILED}) AS failed_rules FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""

OP9 = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), k AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
    SELECT a, b FROM k UNION ALL SELECT b, a FROM k
), reach(a, b) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

_CONTROLS = "|".join(m.replace("[", r"\[") for m in (*(m for pair in MARKS.values() for m in pair), *OTHER))
_ESCAPED = lambda text: f"length({text}) + len(regexp_extract_all({text}, '{_CONTROLS}'))"
_FRAME = " ".join(f"WHEN role = '{role}' THEN {len(a) + len(b) + 2}" for role, (a, b) in MARKS.items())

#: A section is taken to be one part, as it is below ``chat.CHARS`` characters.
OP11 = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(floor(turn / {SECTION}), -1e18) AS section FROM (
        SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    )
), f AS (
    SELECT *, CASE {_FRAME} ELSE {sum(map(len, OTHER)) + 4} + {_ESCAPED("role")} END + {_ESCAPED("text")} AS size FROM t
), r AS (
    SELECT *, sum(size) OVER w AS whole, lead(turn) OVER w IS NULL AND row_number() OVER w = count(*) OVER (PARTITION BY conv_id, section) AS ends FROM f
    WINDOW w AS (PARTITION BY conv_id, section ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY section, turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = '{TARGET}'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY section, turn NULLS FIRST, role, text) FILTER (role = '{TARGET}'), '')) AS loss_sha256,
    CAST(sum(whole) FILTER (role = '{TARGET}' OR ends) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

#: CRC-32 with the usual reflected polynomial, a byte and then a bit at a time.
_CRC = lambda text: f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
_CENTS = lambda amount: f"coalesce(CAST(floor(100 * {amount} + 0.5) AS BIGINT), 0)"

OP12 = f"""
WITH s AS (
    SELECT sale_id, client_id, epoch_us(sold_at) AS sold, epoch_us(arrived_at) + {DELAY_MINUTES * 60_000_000} AS known, {_CENTS("total")} AS cents,
        epoch_us(sold_at) + {_CRC("CAST(sale_id AS VARCHAR)")} % {SPREAD} * 1000000 AS t
    FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), c AS (
    SELECT *, {_CENTS("value")} AS cents, epoch_us(ts) AS us, epoch_us(arrived_at) + {DELAY_MINUTES * 60_000_000} AS known
    FROM (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks)
), p AS (
    SELECT sale_id, client_id, t, d, t - d * {DAY} AS since FROM s, (VALUES {", ".join(f"({d})" for d in WINDOWS)}) v(d)
), pc AS (
    SELECT p.sale_id, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(cents) AS click_cents, arg_max(click_id, (us, click_id)) AS last_click_id
    FROM p JOIN c USING (client_id) WHERE us > since AND us <= t AND known <= t GROUP BY ALL
), ps AS (
    SELECT p.sale_id, d, p.t, s.sale_id AS own, cents FROM p JOIN s USING (client_id) WHERE sold > since AND sold <= p.t AND known <= p.t
), pn AS (
    SELECT sale_id, d, count(*) AS n_sales, sum(cents) AS sale_cents FROM ps GROUP BY ALL
), pl AS (
    SELECT ps.sale_id, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum({_CENTS("amount")}) AS line_cents
    FROM ps JOIN sale_lines l ON l.sale_id = own WHERE epoch_us(shipped_at) <= t GROUP BY ALL
), y AS (
    SELECT DISTINCT a.sale_id FROM s a JOIN s b USING (client_id) WHERE b.sold > a.t AND b.sold <= a.t + {LABEL * DAY}
)
SELECT sale_id, CAST(d AS INTEGER) AS d, t AS t_us, y.sale_id IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases,
    CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id, coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM p LEFT JOIN pc USING (sale_id, d) LEFT JOIN pn USING (sale_id, d) LEFT JOIN pl USING (sale_id, d) LEFT JOIN y USING (sale_id)
"""

ORACLES: dict[str, str] = {"op1_nearest": OP1, "op5_quality_rules": OP5, "op9_near_duplicates": OP9, "op11_chat": OP11, "op12_point_in_time": OP12}
