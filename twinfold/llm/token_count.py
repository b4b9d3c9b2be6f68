"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a segment form a doubly linked list; a heap holds the adjacent pairs that the vocabulary can
merge. The lowest-rank pair (highest score, then leftmost) is popped and merged until the heap is empty. The
count is the number of initial symbols less the merges; a symbol that stays unknown counts one token for each
UTF-8 byte. No identifiers are emitted.

Texts are cut before each run of word separators that follows another character, and around line feeds if no
piece of the vocabulary reaches across such a place (checked when the model is loaded), so the count of a text is the sum over
its segments and distinct segments are counted once while they stay in a bounded memo.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a repeated row is counted again; an empty table gives
no rows; a very long text without separators is one segment (n log n heap steps); columns besides ``doc_id`` and ``text`` are ignored
whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Bounded, claim, texts

SPACE = "▁"
MEMO = 600_000


def count_symbols(symbols: list[str], rank: dict[str, tuple]) -> tuple[int, list[str]]:
    """Merges made and the symbols left after merging adjacent pairs, lowest rank first, leftmost on ties."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    right[-1:] = [-1] * bool(n)
    part: list[str | None] = list(symbols)
    heap: list[tuple] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (r := rank.get(both := part[a] + part[b])) is not None:
            heapq.heappush(heap, (r, a, b, both))

    for i in range(n - 1):
        offer(i, i + 1)
    merges = 0
    while heap:
        _, a, b, both = heapq.heappop(heap)
        if part[a] is None or part[b] is None or right[a] != b or len(part[a]) + len(part[b]) != len(both):
            continue  # one of the two was merged in the meantime
        part[a], part[b], right[a] = both, None, right[b]
        if right[b] >= 0:
            left[right[b]] = a
        merges += 1
        offer(left[a], a)
        offer(a, right[a])
    return merges, [x for x in part if x is not None]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model's vocabulary."""

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = list(_fields(open(path, "rb").read()))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        spec = dict(_fields(next((v for k, v in model if k == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        kinds = [dict(_fields(v)).get(3, 1) for k, v in model if k == 1]
        if 4 in kinds or 5 in kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        #: no table of characters, a leading separator, separators kept, spaces escaped
        self.plain = not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1
        self.fallback = bool(trainer.get(35, 0))
        normal = [(sp.id_to_piece(i), sp.get_score(i)) for i, kind in enumerate(kinds) if kind == 1]
        self.rank = {piece: -score for piece, score in normal}
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in normal)
        self.lines = not any("\n" in piece for piece, _ in normal)
        self.memo = Bounded(memo)

    def segment(self, symbols: str) -> int:
        merges, rest = count_symbols(list(symbols), self.rank)
        unknown = sum(len(x.encode()) - 1 for x in rest if x not in self.rank) if self.fallback else 0
        return len(symbols) - merges + unknown

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo = self.memo
        if self.plain and self.cut and self.lines:
            spaced = text.replace("\n", " \n")  # a key that begins with a line feed has no separator before it
            if "  " not in spaced and SPACE not in spaced and text[0] != " ":
                keys = spaced.split(" ")
                try:
                    return sum(map(memo.__getitem__, keys))
                except KeyError:
                    missing = {k for k in keys if k not in memo}
                    if len(memo) + len(missing) > memo.most:
                        memo.clear()
                        missing = set(keys)
                    for k in missing:
                        memo[k] = 1 + self.segment(k[1:]) if k[:1] == "\n" else self.segment(SPACE + k)
                    return sum(map(memo.__getitem__, keys))
        norm = SPACE + text.replace(" ", SPACE) if self.plain else self.sp.normalize(text)
        if not self.cut:
            return self.segment(norm)
        parts = re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+", norm)
        return sum(map(self.segment, parts))


class ByteCounter:
    """Counts the tokens of a byte-level BPE vocabulary kept as a tokenizers file."""

    def __init__(self, path: str, memo: int = MEMO):
        import json

        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.whole = Tokenizer.from_file(path)
        import public_tokenizers

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.rank = {"".join(pair if isinstance(pair, list) else pair.split(" ")): i for i, pair in enumerate(spec["model"]["merges"])}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.of = {b: chr(b if b in plain else next(other)) for b in range(256)}
        self.memo = Bounded(memo)

    def count(self, text: str) -> int:
        for s in self.special:
            if s in text:
                parts = text.split(s)
                return len(parts) - 1 + sum(map(self.count, parts))
        words = self.split(text)
        missing = {w for w in words if w not in self.memo}
        if len(self.memo) + len(missing) > self.memo.most:
            self.memo.clear()
            missing = set(words)
        for w in missing:
            symbols = [self.of[b] for b in w.encode()]
            self.memo[w] = len(symbols) - count_symbols(symbols, self.rank)[0]
        return sum(map(self.memo.__getitem__, words))


_counters: dict[str, PieceCounter | ByteCounter] = {}


def counter(path: str) -> PieceCounter | ByteCounter:
    """The counter of a vocabulary file, one for each worker process."""
    claim("token_count", _counters.clear)
    if path not in _counters:
        _counters[path] = (PieceCounter if path.endswith(".model") else ByteCounter)(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text of ``docs``; no shuffle.

    ``path`` must name the vocabulary file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(path).count
            rows = batch.column("text").to_pylist()
            n = [count(t) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
