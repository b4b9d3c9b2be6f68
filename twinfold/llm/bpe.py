"""Byte-level BPE by DuckDB recursive queries, one in-memory database per worker.

Encoding: the pattern splits a text into words. Each word that is not yet known holds its tokens in a list: one if the word is a vocabulary entry, else its bytes. A
recursive query unnests the lists to token-position rows, joins adjacent tokens with the merge table (left, right, rank), contracts each word's leftmost pair of
minimum rank, and repeats until no word has a pair left. The minimum is a hash aggregate, so no step sorts. Merge ranks are those of the concatenated bytes, as for rank files.

Words of more than ``LONG`` bytes are contracted in windows of ``WINDOW`` bytes that overlap by half. Where two neighbouring windows have a token in common, the word's tokens are those of the one up to this
token and those of the other after it: a contraction of the whole word never crosses an end of that token, since, from one of its ends to the far side of a window, it takes the same steps
as that window's. Windows without a common token are joined to one; a word in which many have none, as a repeated character's, takes a query of its own.
That one contracts a word's minimum rank at all its places in a step, from left to right and without overlap, up to the first place where the new token makes a pair of a lower
rank with the token beside it, which then comes first. Its steps are about as many as the ranks merged, and it keeps the latest tokens only; its memory limit follows the word's length.

The same query decodes what it has encoded, by the ordered aggregation below, and a memo keeps both for a word.

Decoding: a query joins (sequence, position, token) rows with the vocabulary and aggregates the tokens' bytes in
order of position. A sequence of identifiers is first cut into parts at white space and punctuation (decoding is the concatenation of its
parts), so that each distinct part is decoded once while it stays in a bounded memo.

Edge cases: a null or empty text has no tokens and decodes to nothing; null identifiers lists decode to nothing; an unknown identifier raises; repeated rows are
encoded again; an empty table gives no rows; columns besides those named are ignored, or kept where stated.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import compress
from operator import itemgetter, not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, claim, slices, texts, trimmed, uncollected

#: Bytes of a word from which it is cut into windows, of a window at least, and of a window that is not joined with another any more.
LONG, WINDOW, WIDEST = 200, 192, 1500
#: Sum of the squared bytes of the windows in one query.
SQUARES = 20_000_000
#: Bytes of memory of the database, and of that for each byte of a word that is contracted whole.
MEMORY, MEMORY_OF_BYTE = 128_000_000, 1000
#: Entries of a generation of the two memos, and bytes of new words in one query.
ENCODED, DECODED, CHUNK = 500_000, 400_000, 100_000
#: Characters (or identifiers) of the rows that are worked on at once, one row at least.
GROUP = 1_000_000

_START = "SELECT word, CASE WHEN token IS NULL THEN tokens ELSE [token] END AS tokens FROM symbols LEFT JOIN vocabulary USING (raw)"

_RESULT = """
SELECT word, string_agg(digits, ' ' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex
FROM (SELECT word, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM step {where}) JOIN vocabulary USING (token)
GROUP BY word ORDER BY word
"""

_ENCODE = f"""
WITH RECURSIVE step(word, tokens, done) AS (
    SELECT *, len(tokens) = 1 FROM ({_START})
    UNION ALL
    SELECT
        word,
        CASE WHEN best IS NULL THEN tokens ELSE list_concat(tokens[:(best & 4294967295) - 1], [(best >> 32)::INTEGER], tokens[(best & 4294967295) + 2:]) END,
        best IS NULL
    FROM (SELECT * FROM step WHERE NOT done) LEFT JOIN (
        SELECT word, min((m.rank::BIGINT << 32) | s.pos) AS best
        FROM (SELECT word, unnest(range(1, len(tokens))) AS pos, unnest(tokens[:-2]) AS l, unnest(tokens[2:]) AS r FROM step WHERE NOT done) s
        JOIN merges m USING (l, r)
        GROUP BY word
    ) USING (word)
)
{_RESULT.format(where="WHERE done")}
"""

_ENCODE_LONG = f"""
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
    {_START}
    UNION
    SELECT word, list(token ORDER BY pos) FROM (
        WITH rows AS MATERIALIZED (
            SELECT word, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos,
                unnest(list_append(tokens[2:], NULL)) AS r, unnest(list_concat(tokens[3:], [NULL, NULL])) AS after, unnest(list_prepend(NULL, tokens[:-2])) AS before
            FROM step
        ),
        pairs AS MATERIALIZED (SELECT word, pos, after, before, rank FROM rows JOIN merges m ON m.l = token AND m.r = rows.r),
        least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
        hits AS (SELECT word, pos, rank, after, before, pos - row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM pairs JOIN least USING (word, rank)),
        every AS MATERIALIZED (
            SELECT word, pos, rank, after, CASE WHEN row_number() OVER (PARTITION BY word, run ORDER BY pos) > 1 THEN rank ELSE before END AS before
            FROM hits QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1
        ),
        stops AS (
            SELECT word, min(pos) AS last FROM (
                SELECT word, pos FROM every JOIN merges m ON m.l = every.rank AND m.r = after WHERE m.rank < every.rank
                UNION ALL SELECT word, pos FROM every JOIN merges m ON m.l = before AND m.r = every.rank WHERE m.rank < every.rank
            ) GROUP BY word
        ),
        taken AS MATERIALIZED (SELECT word, pos, rank FROM every LEFT JOIN stops USING (word) WHERE last IS NULL OR pos <= last)
        SELECT rows.word, rows.pos, coalesce(taken.rank, rows.token) AS token
        FROM rows JOIN least ON rows.word = least.word LEFT JOIN taken ON taken.word = rows.word AND taken.pos = rows.pos
        WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.word = rows.word AND t.pos = rows.pos - 1)
    ) GROUP BY word
)
{_RESULT.format(where="")}
"""

_DECODE = """
SELECT part, string_agg(hex, '' ORDER BY pos) AS hex
FROM (SELECT part, unnest(ids) AS token, generate_subscripts(ids, 1) AS pos FROM parts) JOIN vocabulary USING (token)
GROUP BY part ORDER BY part
"""


class Codec:
    """Encoder and decoder for a rank file; memos and database are bounded."""

    def __init__(self, path: str, pattern: str, encoded: int = ENCODED, decoded: int = DECODED):
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        #: A part is cut before a token that begins with white space, and on both sides of one without letters or digits.
        self.opens, self.closes = np.zeros((2, max(ranks.values()) + 1), bool)
        made: tuple[array, array, array] = array("i"), array("i"), array("i")
        self.lengths = {str(i).encode(): len(b) for b, i in ranks.items()}
        self.window = max(WINDOW, 2 * (max(map(len, ranks)) // 2 + 1))  # longer than any token, so that none stands for a window
        for b, i in ranks.items():
            self.opens[i], self.closes[i] = b[:1].isspace(), b.isascii() and not any(c.isalnum() for c in b.decode())
            for k in range(1, len(b)):
                if (left := ranks.get(b[:k])) is not None and (right := ranks.get(b[k:])) is not None:
                    for column, x in zip(made, (left, right, i), strict=True):
                        column.append(x)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}B", "max_temp_directory_size": "0KB"})
        merges = dict(zip(("l", "r", "rank"), (pa.array(np.frombuffer(x, np.int32)) for x in made), strict=True))
        vocabulary = {"token": pa.array(ranks.values(), pa.int32()), "raw": pa.array(ranks.keys(), pa.binary())}
        for name, columns, more in (("merges", merges, ""), ("vocabulary", vocabulary, ", token::VARCHAR AS digits, lower(hex(raw)) AS hex")):
            self.db.register("made", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT *{more} FROM made")
            self.db.unregister("made")
        self.encoded, self.decoded = Memo(encoded), Memo(decoded)

    def _query(self, name: str, rows: pa.Table, query: str) -> list[list[str]]:
        self.db.register(name, rows)
        try:
            return [c.to_pylist() for c in self.db.sql(query).to_arrow_table().columns[1:]]
        finally:
            self.db.unregister(name)

    def _contract(self, words: list[bytes], query: str = _ENCODE) -> tuple[list[str], list[str]]:
        """Identifiers in decimal, and decoded bytes in hexadecimal, of each word."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int32, len(words)))
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]))
        return self._query("symbols", pa.table({"word": pa.array(range(len(words)), pa.int32()), "raw": pa.array(words, pa.binary()), "tokens": tokens}), query)

    def _whole(self, word: bytes) -> bytes:
        """Identifiers of a word by the query for words of few ranks; the database may hold what the word needs."""
        need = MEMORY_OF_BYTE * len(word)
        if need > MEMORY:
            self.db.execute(f"SET memory_limit = '{need}B'")
        try:
            return self._contract([word], _ENCODE_LONG)[0][0].encode()
        finally:
            if need > MEMORY:
                self.db.execute(f"SET memory_limit = '{MEMORY}B'")

    def _windows(self, word: bytes, spans: list[tuple[int, int]]) -> list[list[tuple[int, int, bytes]]]:
        """``start, end, identifier`` of each token of parts of a word."""
        out, at, size = [], 0, 0
        for k, (a, b) in enumerate(spans):
            size += (b - a) ** 2  # the query keeps the tokens of all its steps
            if size > SQUARES or k + 1 == len(spans):
                for (start, _), ids in zip(spans[at : k + 1], self._contract([word[x:y] for x, y in spans[at : k + 1]])[0], strict=True):
                    tokens = ids.encode().split()
                    ends = np.cumsum([start, *map(self.lengths.__getitem__, tokens)]).tolist()
                    out.append(list(zip(ends[:-1], ends[1:], tokens, strict=True)))
                at, size = k + 1, 0
        return out

    def long_word(self, word: bytes) -> bytes:
        """Identifiers of a word of more than ``LONG`` bytes, in decimal."""
        if len(word) <= self.window:
            return self._whole(word)
        step = self.window // 2
        spans = [(k, k + self.window) for k in range(0, len(word) - self.window, step)] + [(len(word) - self.window, len(word))]
        tokens = self._windows(word, spans)
        while True:
            out: list[bytes] = []
            apart, at = [], 0  # windows that have no token in common with the next, and where the tokens of ``out`` end
            for k in range(len(spans) - 1):
                mine = {(a, b) for a, b, _ in tokens[k] if a >= at}
                common = next((b for a, b, _ in tokens[k + 1] if (a, b) in mine), None)
                if common is None:
                    apart.append(k)
                    common = spans[k + 1][0]
                out += [i for a, b, i in tokens[k] if at <= a and b <= common]
                at = common
            if not apart:
                return b" ".join(out + [i for a, _, i in tokens[-1] if a >= at])
            wide = max(b - a for a, b in spans)
            if wide > WIDEST or 8 * len(apart) > len(spans) > 8:
                return self._whole(word)
            joined, made, k = [], [], 0
            gone = set(apart)
            while k < len(spans):
                first = k
                while k in gone:
                    k += 1
                joined.append((spans[first][0], spans[k][1]))
                made.append(tokens[k] if first == k else None)
                k += 1
            fresh = iter(self._windows(word, [s for s, t in zip(joined, made, strict=True) if t is None]))
            spans, tokens = joined, [t if t is not None else next(fresh) for t in made]

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that the memo lacks."""
        memo = self.encoded.now
        chunk: list[tuple[str, bytes]] = []
        held = 0

        def flush() -> None:
            if chunk:
                for (w, _), ids, hex_ in zip(chunk, *self._contract([b for _, b in chunk]), strict=True):
                    memo[w] = ids.encode(), bytes.fromhex(hex_)
                chunk.clear()

        for w in words:
            b = w.encode()
            if len(b) > LONG:
                ids = self.long_word(b)
                memo[w] = ids, self.decode_parts([[ids]])[0]
                continue
            chunk.append((w, b))
            held += len(b)
            if held > CHUNK:
                flush()
                held = 0
        flush()

    @staticmethod
    def _looked_up(rows: list[list], memo: Memo, learn: Callable[[list], None]) -> list[list]:
        """The memo entries of each row's items; ``learn`` is called once with the items that the memo lacks."""
        found = [list(map(memo.now.get, row)) for row in rows]
        lacking = [list(compress(row, map(not_, values))) for row, values in zip(rows, found, strict=True)]
        missing = set().union(*lacking)
        memo.room(len(missing))  # the values found are held already
        again = {x: v for x in missing if (v := memo.old.get(x)) is not None}
        memo.now.update(again)
        learn([x for x in missing if x not in again])
        for values, some in zip(found, lacking, strict=True):
            at = -1
            for x in some:
                at = values.index(None, at + 1)
                values[at] = memo.now[x]
        return found

    def coded(self, batch: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """For each text the identifiers of each of its words, in decimal, joined by spaces, and the bytes that they decode to."""
        return self._looked_up([self.split(t) for t in batch], self.encoded, self.learn)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """The identifiers of each text."""
        return [np.array(b" ".join(map(itemgetter(0), words)).split(), np.int32) for words in self.coded(batch)]

    def _learn_parts(self, parts: list[bytes]) -> None:
        for k in range(0, len(parts), 50_000):
            some = parts[k : k + 50_000]
            ids = pa.array([list(map(int, x.split())) for x in some], pa.list_(pa.int32()))
            (out,) = self._query("parts", pa.table({"part": pa.array(range(len(some)), pa.int32()), "ids": ids}), _DECODE)
            if len(out) != len(some):
                raise ValueError("an identifier is not in the vocabulary")
            self.decoded.now.update(zip(some, map(bytes.fromhex, out), strict=True))

    def decode(self, batch: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of identifiers."""
        parts: list[list[bytes]] = []
        for ids in batch:
            alone = self.closes[ids]
            cuts = (np.flatnonzero(self.opens[ids[1:]] | alone[1:] | alone[:-1]) + 1).tolist()
            digits = list(map(str, ids.tolist()))
            parts.append([" ".join(digits[a:b]).encode() for a, b in zip([0, *cuts], [*cuts, len(digits)], strict=True)] if digits else [])
        return self.decode_parts(parts)

    def decode_parts(self, batch: list[list[bytes]]) -> list[bytes]:
        """The bytes of each sequence of identifiers that comes in parts, each in decimal."""
        return [b"".join(x) for x in self._looked_up(batch, self.decoded, self._learn_parts)]


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, memo: int = ENCODED) -> Codec:
    """One for each vocabulary and worker process."""
    claim("bpe", _codecs.clear)
    key = path, pattern, memo
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern, memo, memo * DECODED // ENCODED)
    return _codecs[key]


def encode(docs: DataFrame, path: str, pattern: str, memo: int = ENCODED) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int), of every whole text; no shuffle. The vocabulary file must exist on all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", GROUP):
            ids = codec(path, pattern, memo).encode(part.column("text").to_pylist())
            at = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, memo: int = ENCODED) -> DataFrame:
    """``doc_id`` and ``bytes`` of every ``ids`` list (null: empty); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", GROUP):
            out = codec(path, pattern, memo).decode([np.array(x or [], np.int32) for x in part.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, memo: int = ENCODED) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes in one pass, so identifiers never leave the worker.

    ``memo`` bounds the words that a worker keeps, which changes time and memory and never the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", GROUP):
            n, ids_sha, text_sha = [], [], []
            with uncollected():  # millions of small objects and no cycles among them
                c = codec(path, pattern, memo)
                for words in c.coded(part.column("text").to_pylist()):
                    ids = b" ".join(map(itemgetter(0), words))
                    n.append(ids.count(b" ") + bool(ids))
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(itemgetter(1), words))).hexdigest())
                del words, ids
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
