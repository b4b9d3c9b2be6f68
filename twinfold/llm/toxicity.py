"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts of the training fold, whatever their label, are unlabelled. The risk is
prior * E+[loss(1)] + max(0, Eu[loss(-1)] - prior * E+[loss(-1)]) with the sigmoid loss's smooth relative, the logistic loss; when the inner term is
negative only its gradient, reversed, is followed. The class prior is the share of toxic rows among the labelled training rows. The
classifier is linear over hashed words: binary features, weights found by Adam in numpy on the driver.

It is fitted on samples of at most ``POSITIVES`` and ``UNLABELLED`` texts, the first by a seeded hash of the doc_id; words are hashed into ``2 ** BITS`` slots
on the executors, so only slot numbers travel. Prior and labels come from all rows, and every whole text is scored. The weights sent to the executors have a fixed size.

Edge cases: a null or empty text has no features and gets the bias alone; without positives or unlabelled texts every score is the prior; null labels count as unlabelled; a document with several label rows
is positive if one of them is; null doc_ids are never trained on; repeated rows get equal scores; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bounded, claim, slices, texts, trimmed

BITS = 18
POSITIVES, UNLABELLED = 4000, 12000
MEMO = 400_000
#: Least log-likelihood ratio of a slot that is used. It is low, as a word of a small language occurs in few toxic texts; chosen by ``compared`` on training rows alone.
SURE = 6.0
#: Bytes of the texts that are worked on at once, one text at least.
GROUP = 2_000_000
_memo = Bounded(MEMO)
_EDGES = bytes(c for c in range(128) if not chr(c).isalnum())


def slots(text: str) -> np.ndarray:
    """The distinct slots of a text's words: ASCII lower case, punctuation around them cut off."""
    words = set(text.encode().lower().split())
    _memo.room(len(words))
    out = []
    for w in words:
        if (s := _memo.get(w)) is None:
            s = _memo[w] = zlib.crc32(w.strip(_EDGES)) >> (32 - BITS)
        out.append(s)
    return np.unique(np.array(out, np.int32))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float = SURE) -> np.ndarray:
    """The slots whose share of texts differs between the two samples by a log-likelihood ratio of ``least`` or more.

    Without this the many words that occur in a few texts each would let the classifier remember its examples.
    """
    size, n, m = 1 << BITS, len(positive), len(unlabelled)
    a = np.bincount(np.concatenate(positive), minlength=size).astype(float)
    b = np.bincount(np.concatenate(unlabelled), minlength=size).astype(float)

    def term(x: np.ndarray, total: np.ndarray, part: float) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(total * part, 1e-9)), 0)

    share = n / (n + m)
    ratio = 2 * (term(a, a + b, share) + term(b, a + b, 1 - share) + term(n - a, n + m - a - b, share) + term(m - b, n + m - a - b, 1 - share))
    return np.flatnonzero(ratio >= least)


def compared(rows: list[tuple[int, np.ndarray, bool]], candidates: tuple[float, ...], parts: int = 4) -> dict[float, tuple[float, float]]:
    """For each least ratio the share of toxic rows found, and of other rows taken for toxic, in parts of the training rows that the fit left out. ``rows``: part, slots, whether toxic.

    ``SURE`` was chosen by this; held-out rows had no say.
    """
    out = {}
    for least in candidates:
        hits = false = toxic = clean = 0
        for k in range(parts):
            mine = [(x, t) for part, x, t in rows if part != k]
            positive, every = [x for x, t in mine if t], [x for x, _ in mine]
            w = fit(positive, every, len(positive) / len(mine), least=least)
            for part, x, t in rows:
                if part == k:
                    found = w[x].sum() + w[-1] >= 0
                    hits, toxic, false, clean = hits + (t and found), toxic + t, false + (found and not t), clean + (not t)
        out[least] = (float(hits / max(1, toxic)), float(false / max(1, clean)))
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, least: float = SURE) -> np.ndarray:
    """Weights of the slots, the bias last.

    Each step takes the whole samples: on small batches the inner term is often negative by chance alone, and the steps back hold the weights
    of telling words so low that a text with one of them stays under 0.5.
    """
    kept = telling(positive, unlabelled, least)
    (fp, op, n_p), (fu, ou, n_u) = (_flattened(rows, kept) for rows in (positive, unlabelled))
    size = len(kept)
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = step_of(w, (fp, op, n_p), (fu, ou, n_u), prior)[1]
        g[:size] += decay * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros((1 << BITS) + 1)
    out[kept], out[-1] = w[:size], w[size]
    return out


def _flattened(rows: list[np.ndarray], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The places in ``kept`` of all rows' slots, the row of each, and the number of rows."""
    found = [np.searchsorted(kept, r[np.isin(r, kept)]) for r in rows]
    return np.concatenate(found).astype(np.int64), np.repeat(np.arange(len(found)), [len(r) for r in found]), len(found)


def step_of(w: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction to step against: its gradient, or where the inner term is negative that term's, reversed."""
    size = len(w) - 1
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def margins(flat: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        return w[size] + np.bincount(of, w[flat], n)

    def slope(flat: np.ndarray, of: np.ndarray, each: np.ndarray) -> np.ndarray:
        g = np.bincount(flat, each[of], size + 1).astype(float)  # no telling slots: integers
        g[size] = each.sum()
        return g

    (fp, op, n_p), (fu, ou, n_u) = positive, unlabelled
    zp, zu = margins(fp, op, n_p), margins(fu, ou, n_u)
    plus = slope(fp, op, -prior * sigmoid(-zp) / n_p)  # prior * E+ loss(+1)
    minus = slope(fu, ou, sigmoid(zu) / n_u) - slope(fp, op, prior * sigmoid(zp) / n_p)
    inner = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    risk = prior * np.logaddexp(0, -zp).mean() + max(0.0, inner)
    return risk, (plus + minus if inner >= 0 else -minus)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 11) -> tuple[np.ndarray | None, float]:
    """Weights (None without examples) and the class prior."""
    marks = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    prior = min(0.5, max(0.001, (n["p"] or 0) / n["n"])) if n["n"] else 0.01
    fold = texts(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)))
    order = lambda d: d.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    # The ids are chosen before any text is read: at most ``positives`` + ``unlabelled`` of them, so the broadcast below is bounded.
    confirmed = order(marks.filter("toxic = 1").select("doc_id")).orderBy("h", "doc_id").limit(positives)
    others = order(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)).select("doc_id")).orderBy("h", "doc_id").limit(unlabelled)
    chosen = confirmed.select("doc_id", F.lit(1).alias("kind")).unionByName(others.select("doc_id", F.lit(0).alias("kind"))).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _memo.clear)
        for b in slices(batches, "text", GROUP):
            yield pa.RecordBatch.from_arrays([b.column("kinds"), pa.array([slots(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["kinds", "slots"])

    rows = fold.join(F.broadcast(chosen), "doc_id")
    got = [(r["kinds"], np.frombuffer(r["slots"], np.int32)) for r in rows.select("doc_id", "kinds", "text").orderBy("doc_id").select("kinds", "text").mapInArrow(trimmed(featurise), "kinds array<int>, slots binary").toLocalIterator()]
    p, u = [x for k, x in got if 1 in k], [x for k, x in got if 0 in k]
    return (fit(p, u, prior) if p and u else None), prior


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; no shuffle of texts."""
    weights, prior = train(docs, labels, folds, **options)
    shared = docs.sparkSession.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))  # 2 ** BITS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _memo.clear)
        w = shared.value
        for b in slices(batches, "text", GROUP):
            z = [0.0 if w is None else float(w[slots(t)].sum(dtype=np.float64) + w[-1]) for t in b.column("text").to_pylist()]
            s = np.full(len(z), prior) if w is None else 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = texts(docs.withColumn("held_out", held_out(F.col("doc_id"), folds)), "held_out")
    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")
