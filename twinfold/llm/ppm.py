"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The pretrained model is a byte-context trie of order ``ORDER``, kept as a table of (context, symbol) counts: a key is the context's bytes followed by the symbol's, so the shorter
contexts are suffixes and their keys are masked ones. Byte 255 never occurs in UTF-8; it pads the start of a text and is the end symbol. A
context with T occurrences and D distinct symbols gives a seen symbol (2 count - 1) / 2T and escapes with D / 2T (estimator D); after an escape the symbols of the
longer context are excluded from the shorter one's counts, and a context that then has nothing new is passed over. After the empty context all symbols that are left are
equally likely. A text's score is the sum of the log10 probabilities of its bytes and its end.

Neither the model nor the words' counts are broadcast or collected, as they grow with the corpus. Documents are dealt to blocks by a hash; a block lists the keys and the
words (as 63-bit hashes) that it holds, the list is joined with the model, and its answers are brought together with the block's documents, the answers first, so that a task holds the distinct
keys of one block and streams its texts.

Edge cases: a null or empty text has the end alone; a null doc_id is learned from and not held out; repeated rows count again and score alike; with nothing to learn
from, all symbols are equally likely and N = V = 0; very long texts are scored whole, in pieces that keep their context; an empty table gives no rows;
columns besides ``doc_id`` and ``text`` are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, slices, stage, texts, trimmed

ORDER = 5
#: Bytes of text in a block, least number of blocks, and bytes that are worked on at once.
BLOCK, LEAST, PIECE = 48_000_000, 12, 1_000_000
#: Positions that are counted before their distinct keys are merged with those of the block.
PENDING = 4_000_000
#: Kinds of rows: contexts with a symbol, words, documents.
GRAM, WORD, TEXT = 0, 1, 2
EDGE = 255


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def keys_of(raws: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all positions of some texts, each with its end, and the number of positions of each text."""
    pad = bytes([EDGE])
    buf = np.frombuffer(b"".join(x for raw in raws for x in (pad * order, raw, pad)) or b"", np.uint8)
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    n = len(buf) - order
    if n <= 0:
        return np.empty(0, np.uint64), sizes
    key = buf[:n].astype(np.uint64)
    for k in range(1, order + 1):
        key <<= np.uint64(8)
        key |= buf[k : k + n]
    keep = np.ones(n, bool)  # positions whose symbol is padding at the start of the next text
    for k in range(order):
        ends = np.cumsum(sizes + order)[:-1] - order + k
        keep[ends] = False
    return key[keep], sizes


def words_of(raw: bytes) -> np.ndarray:
    """63-bit hashes of a text's words, ASCII lower case; bytes.split cuts at space and U+0009 to U+000D."""
    from xxhash import xxh3_64_intdigest

    words = raw.lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of two sorted runs, with the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first, dtype=np.int32) if len(first) else n


class _Tally:
    """Distinct keys of a block with their counts in training texts; the lowest bit marks keys from other texts. Counts are below the block's bytes, so 32 bits hold them."""

    def __init__(self):
        self.key, self.n = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, held: bool) -> None:
        self.pending.append((keys << np.uint64(1)) | np.uint64(held))
        self.held += len(keys)
        if self.held >= PENDING:
            self._merge()

    def _merge(self) -> None:
        pending, self.pending, self.held = np.concatenate([np.empty(0, np.uint64), *self.pending]), [], 0
        key, n = np.unique(pending, return_counts=True)
        del pending
        self.key, self.n = _summed(np.concatenate((self.key, key)), np.concatenate((self.n, n.astype(np.int32))))

    def rows(self, block: int, kind: int) -> Iterator[pa.RecordBatch]:
        self._merge()
        key, n = self.key, self.n
        if not len(key):
            return
        held, key = (key & np.uint64(1)).astype(bool), key >> np.uint64(1)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        c = np.add.reduceat(np.where(held, 0, n), first)
        key = key[first].astype(np.int64)
        for k in range(0, len(key), 50_000):
            m = len(key[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block, np.int32)), pa.array(np.full(m, kind, np.int32)), pa.array(key[k : k + m]), pa.array(c[k : k + m].astype(np.int64))], ["block", "kind", "key", "c"])


def gather(blocks: DataFrame, order: int) -> DataFrame:
    """``block, kind, key, c``: the keys and words of each block's documents, with their counts in its training texts (0: only in others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ppm")
        now, grams, words = None, _Tally(), _Tally()
        for batch in slices(batches, "text", PIECE):
            block, held = batch.column("block").to_pylist(), batch.column("held_out").to_pylist()
            raws = [t.encode() for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(raws):
                if block[at] != now:
                    yield from grams.rows(now, GRAM)
                    yield from words.rows(now, WORD)
                    now, grams, words = block[at], _Tally(), _Tally()
                end, size = at, 0
                parts: tuple[list, list] = ([], [])
                while end < len(raws) and block[end] == now and size < PIECE:
                    size += len(raws[end])
                    parts[held[end]].append(raws[end])
                    end += 1
                for flag, some in enumerate(parts):
                    if some:
                        grams.add(keys_of(some, order)[0], bool(flag))
                        words.add(np.concatenate([words_of(r) for r in some]), bool(flag))
                at = end
        yield from grams.rows(now, GRAM)
        yield from words.rows(now, WORD)

    return blocks.select("block", "held_out", "text").mapInArrow(trimmed(run), "block int, kind int, key long, c long")


def model(grams: DataFrame, order: int) -> DataFrame:
    """``gram, lp``: the log10 probability of each key's symbol in its context. ``grams``: gram, c; c = 0 for keys that training never saw.

    From the empty context up, ``rest`` is the probability of a symbol after an escape from the key's context.
    """
    tables = {order: stage(grams.groupBy("gram").agg(F.sum("c").alias("c")), "grams")}
    for j in range(order - 1, -1, -1):
        tables[j] = tables[j + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * (j + 1)) - 1).alias("gram")).agg(F.sum("c").alias("c"))
    now = None
    for j in range(order + 1):
        t = tables[j].withColumn("ctx", F.shiftright("gram", 8))
        if now is not None:
            t = t.withColumn("shorter", F.col("gram").bitwiseAND((1 << 8 * j) - 1))
            t = t.join(now.select(F.col("gram").alias("shorter"), F.col("c").alias("cp"), F.col("t").alias("tp"), F.col("d").alias("dp"), F.col("rest").alias("restp")), "shorter")
        own = Window.partitionBy("ctx")  # at most 256 rows
        seen = F.col("c") > 0
        t = t.withColumns({"t": F.sum("c").over(own), "d": F.sum(seen.cast("long")).over(own)} | ({} if now is None else {"gone": F.sum(F.when(seen, F.col("cp")).otherwise(0)).over(own)}))
        if now is None:
            t = t.withColumn("rest", F.lit(1.0) / F.greatest(F.lit(1), 256 - F.col("d")))
        else:
            left, new = F.col("tp") - F.col("gone"), F.col("dp") - F.col("d")
            t = t.withColumn("rest", F.when(new <= 0, F.col("restp")).when(F.col("cp") > 0, (2 * F.col("cp") - 1) / (2 * left)).otherwise(new / (2 * left) * F.col("restp")))
        now = t.select("gram", "c", "t", "d", "rest")
        if j < order:
            now = stage(now, f"order{j}")
    both = 2 * F.col("t")
    p = F.when(F.col("d") == 0, F.col("rest")).when(F.col("c") > 0, (2 * F.col("c") - 1) / both).otherwise(F.col("d") / both * F.col("rest"))
    return now.select("gram", F.log10(p).alias("lp"))


class Table:
    """Look-up of 64-bit keys: a slot with the place of most keys, binary search for those whose slot another key has.

    Of n keys and values it needs 16 n bytes, and 8 n to 16 n for the slots.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(8, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, which must be in the table."""
        at = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
        return self.values[at]


def score(docs: DataFrame, order: int = ORDER, folds: int = 7, fold: int = 2, block_bytes: int = BLOCK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text."""
    rows = texts(docs.withColumn("held_out", held_out(F.col("doc_id"), folds, fold)), "held_out")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum((~F.col("held_out")).cast("long")).alias("ends")).first()
    n_blocks, ends = max(LEAST, -(-(size["bytes"] or 0) // block_bytes)), size["ends"] or 0
    # One block a partition: its number is the partition's.
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    gathered = stage(gather(blocks.repartitionById(n_blocks, F.col("block")), order), "gathered")
    grams, words = gathered.filter(F.col("kind") == GRAM), gathered.filter(F.col("kind") == WORD)
    lp = stage(model(grams.select(F.col("key").alias("gram"), "c"), order), "model")
    # A common word has a row for each block: its count is a sum, and the join back is one that Spark splits where a word is hot.
    known = stage(words.groupBy("key").agg(F.sum("c").alias("n")), "words")
    total = known.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)
    answers = grams.select("block", F.col("key").alias("gram")).join(lp, "gram").select("block", F.lit(GRAM).alias("kind"), F.col("gram").alias("key"), F.col("lp").alias("value"))
    counts = words.select("block", "key").join(known, "key").select("block", F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value"))
    asked = blocks.select("block", F.lit(TEXT).alias("kind"), "doc_id", "held_out", "text")
    dealt = answers.unionByName(counts).unionByName(asked, allowMissingColumns=True).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ppm")
        now = None
        for batch in batches:
            at, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at[a] != now:
                    now, got, tables = at[a], {GRAM: [], WORD: []}, None
                part = batch.slice(a, b - a)
                if kinds[a] != TEXT:
                    got[kinds[a]].append((part.column("key").to_numpy(zero_copy_only=False).astype(np.uint64), part.column("value").to_numpy(zero_copy_only=False)))
                    continue
                if tables is None:
                    tables = [Table(np.concatenate([np.empty(0, np.uint64), *(x for x, _ in got[k])]), np.concatenate([np.empty(0), *(x for _, x in got[k])])) for k in (GRAM, WORD)]
                    got = {}
                for some in slices([part], "text", PIECE):
                    yield from _scored(some, *tables)

    def _scored(part: pa.RecordBatch, table: Table, counted: Table) -> Iterator[pa.RecordBatch]:
        raws = [t.encode() for t in part.column("text").to_pylist()]
        tokens, known, base_scores, scores = [], [], [], []
        group, held = [], 0
        scale = np.log10(n + v + 1)
        for i, raw in enumerate(raws):
            group.append(raw)
            held += len(raw)
            if held > PIECE or i + 1 == len(raws):
                keys, sizes = keys_of(group, order)
                scores += np.add.reduceat(table.get(keys), np.concatenate(([0], np.cumsum(sizes)[:-1]))).tolist()
                words = [np.append(words_of(r), np.uint64(0)) for r in group]  # the last stands for the end
                c = counted.get(np.concatenate(words)) if len(counted.keys) else np.zeros(sum(map(len, words)))
                m = np.array([len(w) for w in words])
                starts = np.concatenate(([0], np.cumsum(m)[:-1]))
                c[starts + m - 1] = ends
                tokens += m.tolist()
                known += np.add.reduceat((c > 0).astype(np.int64), starts).tolist()
                base_scores += np.add.reduceat(np.log10(c + 1) - scale, starts).tolist()
                group, held = [], 0
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * len(raws), pa.int64()), pa.array(base_scores, pa.float64()), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return dealt.mapInArrow(trimmed(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
