"""Quality rules: a table of thresholds compiled into one Spark projection.

``RULES`` holds (name, metric, least, most). ``rule_columns`` turns each row into a Boolean expression over the
metrics, so adding a rule changes data and not code. All metrics are built-in functions; there are no user functions, no shuffle and no
Python on the executors.

Words are runs of characters outside space and U+0009 to U+000D. The base verdict rejects texts with fewer than 50 words, or with more than half of their words in
3-word windows that occur twice or more in the text.

Edge cases: a null or empty text has no words, all counts 0, and fails the base rule; ratios of texts without words are 0;
each row is judged on its own, so ties and repeated rows get equal verdicts; an empty table gives no rows; very
long texts cost n log n only if they repeat a window; other columns never clash, because all columns that this module makes start with ``_q_``
until they are selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "a an and are as at be by for from have in is it of on or that the this to was were with "
    "à au avec ce dans de des du en est et il la le les ne pas pour que qui se sur un une "
    "como con del el es esta las lo los más no para por su una y "
    "als auf das dem den der die ein eine er ist mit nicht sich sie und von zu"
).split()

#: name, metric, least and most allowed (None: open). Texts that a rule rejects are not kept.
RULES = (
    ("mean_word_length", "mean_word_length", 2.0, 24.0),
    ("symbols_per_word", "symbols_per_word", None, 0.1),
    ("stop_words", "n_stop_words", 2.0, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    ("exclamations_per_word", "exclamations_per_word", None, 0.3),
)


def metric_columns() -> dict[str, Column]:
    """Ratios over the counts that ``measured`` made."""
    words, lines = F.nullif(F.col("_q_words"), F.lit(0)), F.nullif(F.col("_q_lines"), F.lit(0))
    per = lambda count, of: F.coalesce(F.col(count) / of, F.lit(0.0))
    return {
        "mean_word_length": per("_q_word_chars", words),
        "symbols_per_word": per("_q_symbols", words),
        "n_stop_words": F.col("_q_stop").cast("double"),
        "dup_line_ratio": per("_q_dup_lines", lines),
        "bullet_line_ratio": per("_q_bullets", lines),
        "ellipsis_line_ratio": per("_q_ellipses", lines),
        "exclamations_per_word": per("_q_exclamations", words),
    }


def rule_columns(rules=RULES) -> dict[str, Column]:
    """For each rule whether a text passes it."""
    metrics, out = metric_columns(), {}
    for name, metric, least, most in rules:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (metrics[metric] >= F.lit(float(least)))
        if most is not None:
            ok = ok & (metrics[metric] <= F.lit(float(most)))
        out[name] = ok
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts ``_q_*``. Arrays are materialised by projections of their own, never inside a lambda."""
    t, w, g = F.col("_q_text"), F.col("_q_w"), F.col("_q_grams")
    n = F.size(w)
    d = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({"_q_w": F.array_remove(F.split(t, GAP), ""), "_q_l": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    d = d.withColumn("_q_grams", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<string>")))
    s = F.col("_q_sorted")
    # Only texts that repeat a window sort them, to see which positions are covered.
    d = d.withColumn("_q_sorted", F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    m = F.size(s)
    at = F.filter(
        F.transform(
            F.sequence(F.lit(0), m - 1),
            lambda j: F.when(((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["g"] == s[j]["g"])) | ((j < m - 1) & (s[F.least(j + 1, m - 1)]["g"] == s[j]["g"])), s[j]["i"]),
        ),
        lambda x: x.isNotNull(),
    )
    d = d.withColumn("_q_at", F.when(s.isNotNull(), F.sort_array(at)))
    p = F.col("_q_at")
    covered = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.when(k < F.size(p) - 1, F.least(F.lit(3), p[F.least(k + 1, F.size(p) - 1)] - p[k])).otherwise(F.lit(3)))
    lines = F.col("_q_l")
    return d.withColumns(
        {
            "_q_words": n.cast("long"),
            "_q_word_chars": F.length(F.array_join(w, "")).cast("long"),
            "_q_symbols": _count(t, "#*$%&|<>").cast("long"),
            "_q_exclamations": _count(t, "!"),
            "_q_lines": F.size(lines).cast("long"),
            "_q_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "_q_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
            "_q_ellipses": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
            "_q_stop": F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))),
            "_q_repeat": F.coalesce(covered, F.lit(0).cast("long")),
            # Keeps filters on the verdicts above this projection; pushed below it, they would repeat its arrays in every term.
            "_q_here": F.spark_partition_id(),
        }
    )


def base_failed() -> Column:
    return ((F.col("_q_words") < 50) | (100 * F.col("_q_repeat") > 50 * F.col("_q_words"))) & (F.col("_q_here") >= 0)


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and the rules failed."""
    passed = rule_columns(rules)
    failed = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in passed.items())), lambda x: x.isNotNull())
    out = measured(docs.select("doc_id", "text")).withColumn("_q_failed", F.array_join(failed, ","))
    return out.select(
        "doc_id",
        F.col("_q_words").alias("n_words"),
        F.col("_q_word_chars").alias("word_chars"),
        F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"),
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("_q_failed") == "")).alias("kept"),
        F.col("_q_failed").alias("failed_rules"),
    )


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs``, with its columns, that pass the base verdict and every rule."""
    passed = base_failed() == F.lit(False)
    for ok in rule_columns(rules).values():
        passed = passed & ok
    return measured(docs).filter(passed).select(*(F.col(f"`{c}`") for c in docs.columns))
