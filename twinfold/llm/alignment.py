r"""Alignment of two tokenizers' tokens: a merge of cumulative token ends.

A (byte-level BPE) encodes a space and the text, B (a sentencepiece model, which adds that space) the text. Both are cut at the same bytes, so their ends are merged like two
sorted lists: up to each end of either, the two tokens that lie there are linked, whose byte ranges overlap; where both end, a group closes. Neither vocabulary has tokens across a space or line feed that stands between two other characters (checked when the files are loaded; else texts stay whole), so a text is merged segment by segment, and each
distinct segment once while it stays in a bounded memo; many new segments are merged at a time, as arrays.

A pair's count is corpus-wide. A task numbers the distinct pairs of a block of its documents, the commonest first, and emits them with their counts beside the documents, whose links are
lists of these numbers. Spark adds up the counts by pair, takes the maxima by each side's identifier, joins both back to the blocks' pairs, and brings these
together with the block's documents, answers first. So rows grow with blocks times their distinct pairs, not with links, a pair that is in every document has a row for each block, and
nothing is collected. Maxima have a row for each identifier of a vocabulary, which bounds their broadcast.

Edge cases: texts that are null or empty, or that a tokenizer does not give back byte for byte (as U+2581, which B writes for a space), have no tokens: zeros and an empty digest; special
tokens' strings are plain text; repeated rows count again; a null doc_id is kept; very long texts are merged whole; an empty table gives no rows; columns besides ``doc_id`` and ``text``
are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress, pairwise
from operator import itemgetter, not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, claim, stage, texts, trimmed

#: Segments of a generation of the memo, characters of new segments encoded at once and of texts worked on at once, links of a block.
MEMO, CHUNK, PIECE, BLOCK = 120_000, 30_000, 1_000_000, 2_000_000
#: Kinds of rows: pairs of a block, its documents.
PAIRS, DOC = 0, 1
#: Pairs of a block in one row.
TOGETHER = 20_000
#: An entry of the memo: count of A's tokens, groups as text, pairs as an array's bytes. The counts of these two make a text's sum tell that it has such segments: one that is not
#: given back, one that cannot be cut off at its spaces.
LOSSY, ODD = (1 << 40, b"", b""), (1 << 80, b"", b"")

_MARKED = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_CLEAN = re.compile(r"[ \n]\S+")


class Aligner:
    """Both tokenizers with their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        of = {chr(b if b in plain else next(other)): b for b in range(256)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.raw_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw_a[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.raw_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(self.raw_b)
        self.pair = np.dtype(np.uint32 if len(self.raw_a) * self.size_b <= 1 << 32 else np.int64)
        self.written = [f"{i}{mark}" for i in range(max(len(self.raw_a), self.size_b)) for mark in ",|;"]
        self.width = np.array(list(map(len, self.written)))
        self.len_a, self.len_b = (np.array(list(map(len, raw))) for raw in (self.raw_a, self.raw_b))
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        self.cut = words and not any(re.search("[^▁]▁|\n", p) for i, p in enumerate(pieces) if not b.is_byte(i))
        self.memo = Memo(memo)

    def segments(self, text: str) -> list[str]:
        """The keys of a text's segments, mostly as if each space or line feed stood between two other characters; see ``literal``."""
        if not self.cut:
            return [f"  {text}"]
        return self.careful(text) if "  " in text or "\n\n" in text else text.replace("\n", " \n").split(" ")

    @staticmethod
    def careful(text: str) -> list[str]:
        """The keys of any text's segments."""
        return [(s if s[0] == "\n" else s[1:]) if _CLEAN.fullmatch(s) else f" {s}" for s in _CUT.split(f" {text}")]

    @staticmethod
    def literal(key: str) -> str:
        """A segment as it stands in the text: keys lack the space before it, or have one more if it holds other spaces."""
        return key[1:] if key[0] == " " else key if key[0] == "\n" else f" {key}"

    def encoded(self, text: str) -> tuple[list[int], list[int], bool]:
        """Both identifiers' lists of a text that begins with a space, and whether both give its bytes back."""
        ids_a, ids_b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:], num_threads=1)
        raw = text.encode()
        return ids_a, ids_b, b"".join(map(self.raw_a.__getitem__, ids_a)) == raw == b"".join(map(self.raw_b.__getitem__, ids_b))

    def merged(self, ids_a: list[int], ids_b: list[int], cuts: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """Memo entries of the segments that end at ``cuts``, at each of which both have a token's end."""
        a, b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = both[1:] == both[:-1]
        closing, ends = both[1:][twice], both[np.append(True, ~twice)]
        links = (a[ends_a.searchsorted(ends)] * self.size_b + b[ends_b.searchsorted(ends)]).astype(self.pair).tobytes()
        # a group's tokens of A come after all tokens of the groups before it, its tokens of B after those
        group_a, group_b = closing.searchsorted(ends_a), closing.searchsorted(ends_b)
        upto_a, upto_b = (np.append(0, x.searchsorted(closing, "right")) for x in (ends_a, ends_b))
        tokens = np.empty(len(a) + len(b), np.int64)
        tokens[np.arange(len(a)) + upto_b[group_a]] = 3 * a + (ends_a == closing[group_a])
        tokens[np.arange(len(b)) + upto_a[group_b + 1]] = 3 * b + 2 * (ends_b == closing[group_b])
        groups = "".join(map(self.written.__getitem__, tokens.tolist())).encode()
        n_a, n_b = ends_a.searchsorted(cuts, "right"), ends_b.searchsorted(cuts, "right")
        written = np.append(0, np.cumsum(self.width[tokens])[n_a + n_b - 1]).tolist()
        linked = np.append(0, ends.searchsorted(cuts, "right") * self.pair.itemsize).tolist()
        return list(zip(np.diff(n_a, prepend=0).tolist(), (groups[x : y - 1] for x, y in pairwise(written)), (links[x:y] for x, y in pairwise(linked)), strict=True))

    def _alone(self, literal: str) -> tuple:
        guard = "" if literal[0] == " " else " a"
        ids_a, ids_b, same = self.encoded(guard + literal)
        if not same:
            return LOSSY
        size = len(literal.encode())
        return self.merged(ids_a, ids_b, np.array([2, 2 + size] if guard else [size]))[-1]

    def _together(self, keys: list[str], literals: list[str]) -> None:
        """Merge segments side by side, as they would be in a text; in halves, if some of them are not given back."""
        if len(keys) == 1:
            self.memo.now[keys[0]] = self._alone(literals[0])
            return
        text = "".join(literals)
        ids_a, ids_b, same = self.encoded(f" a{text}")
        if same:
            sizes = map(len, literals if text.isascii() else map(str.encode, literals))
            self.memo.now.update(zip(keys, self.merged(ids_a, ids_b, np.cumsum([2, *sizes]))[1:], strict=True))
            return
        half = len(keys) // 2
        self._together(keys[:half], literals[:half])
        self._together(keys[half:], literals[half:])

    def learn(self, keys: list[str]) -> None:
        """Merge segments that the memo lacks."""
        words = [k[1:] if k[:1] == "\n" else k for k in keys]
        if " ".join(words).split() != words:  # there are some with spaces in them, or of nothing else
            plain = []
            for key, word in zip(keys, words, strict=True):
                if key[:1] != " " and (not word or _MARKED.search(word)):
                    self.memo.now[key] = ODD
                elif len(literal := self.literal(key)) > 1 and self.cut and not literal[1].isspace() and not literal[-1].isspace():
                    plain.append(key)
                else:  # at a text's beginning or end
                    self.memo.now[key] = self._alone(literal)
            keys = plain
        literals = list(map(self.literal, keys))
        ends = np.cumsum(np.fromiter(map(len, literals), np.int64, len(keys)))
        at = 0
        while at < len(keys):
            end = max(at + 1, int(ends.searchsorted(ends[at] + CHUNK)))
            self._together(keys[at:end], literals[at:end])
            at = end

    def entries(self, rows: list[list[str]]) -> list[list[tuple[int, bytes, bytes]]]:
        """Memo entries of each row's keys."""
        memo = self.memo
        found = [list(map(memo.now.get, row)) for row in rows]
        lacking = [list(compress(row, map(not_, values))) for row, values in zip(rows, found, strict=True)]
        missing = set().union(*lacking)
        memo.room(len(missing))
        again = {k: v for k in missing if (v := memo.old.get(k))}
        memo.now.update(again)
        self.learn([k for k in missing if k not in again])
        return [[v or memo.now[k] for k, v in zip(row, values, strict=True)] if some else values for row, values, some in zip(rows, found, lacking, strict=True)]

    def aligned(self, batch: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """``n_a, n_b, n_groups, groups_sha256`` and the pair of each link of each text."""
        rows = self.entries([self.segments(t) if t else [] for t in batch])
        sums = [sum(map(itemgetter(0), row)) for row in rows]
        odd = [k for k, n in enumerate(sums) if n >= ODD[0]]
        for k, row in zip(odd, self.entries([self.careful(batch[k]) for k in odd]), strict=True):
            rows[k], sums[k] = row, sum(map(itemgetter(0), row))
        out = []
        for row, n_a in zip(rows, sums, strict=True):
            if not row or n_a >= LOSSY[0]:
                out.append((0, 0, 0, "", np.empty(0, self.pair)))
                continue
            groups, links = b";".join(map(itemgetter(1), row)), np.frombuffer(b"".join(map(itemgetter(2), row)), self.pair)
            n_groups = groups.count(b"|")
            out.append((n_a, len(links) + n_groups - n_a, n_groups, hashlib.sha256(groups).hexdigest(), links))  # a group has one link less than tokens
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and worker process."""
    claim("alignment", _aligners.clear)
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


class _Block:
    """Documents of a task until they have ``BLOCK`` links."""

    COLUMNS = ("kind", "block", "doc_id", "no_id", "n_a", "n_b", "n_groups", "groups_sha256", "first", "pairs", "numbers")

    def __init__(self):
        self.docs: list[tuple] = []
        self.links: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: tuple, links: np.ndarray) -> None:
        self.docs.append(doc)
        self.links.append(links)
        self.held += len(links)

    def frames(self, block: int) -> Iterator[pd.DataFrame]:
        """Pairs by their numbers, each with how many links of the block it has, and documents with the differences of their links' sorted numbers."""
        pairs, inverse, counts = np.unique(np.concatenate(self.links) if self.links else np.empty(0, np.int64), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        pairs, counts, number = pairs[order].astype(np.int64), counts[order].astype(np.int32), rank[inverse]
        rows = [(PAIRS, block, 0, False, 0, 0, 0, "", k, pairs[k : k + TOGETHER], counts[k : k + TOGETHER]) for k in range(0, len(pairs), TOGETHER)]
        none, at = np.empty(0, np.int64), 0
        for doc, links in zip(self.docs, self.links, strict=True):
            mine = np.sort(number[at : at + len(links)])
            at += len(links)
            rows.append((DOC, block, *doc, 0, none, np.diff(mine, prepend=np.int32(0)).astype(np.int32)))
        for k in range(0, len(rows), 1000):
            yield pd.DataFrame(rows[k : k + 1000], columns=self.COLUMNS)
        self.__init__()


_MERGED = "kind int, block long, doc_id long, no_id boolean, n_a long, n_b long, n_groups long, groups_sha256 string, first int, pairs array<long>, numbers array<int>"


def merged(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK) -> DataFrame:
    """``_MERGED`` rows: the blocks' pairs and the documents; no shuffle. Both files must exist on all executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, at, held = TaskContext.get().partitionId() << 24, 0, _Block()
        for frame in frames:
            ids, gone, whole = frame["doc_id"].tolist(), frame["no_id"].tolist(), frame["text"].tolist()
            del frame
            while ids:
                n = size = 0
                while n < len(ids) and size < PIECE:
                    size += len(whole[n])
                    n += 1
                for i, no_id, (*head, links) in zip(ids[:n], gone[:n], aligner(path_a, path_b).aligned(whole[:n]), strict=True):
                    held.add((i, no_id, *head), links)
                    if held.held >= block_links:
                        yield from held.frames(block + at)
                        at += 1
                del ids[:n], gone[:n], whole[:n]
        yield from held.frames(block + at)

    rows = texts(docs).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    return rows.mapInPandas(trimmed(run), _MERGED)


def align(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a`` of every whole text.

    ``n_best``: links whose count is the highest of their B identifier; ``n_best_a``: of their A identifier.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = stage(merged(docs, path_a, path_b, block_links), "merged")
    pairs = rows.filter(F.col("kind") == PAIRS).select("block", "first", F.posexplode(F.arrays_zip("pairs", "numbers")).alias("at", "x"))
    pairs = pairs.select("block", (F.col("first") + F.col("at")).alias("number"), F.col("x.pairs").alias("pair"), F.col("x.numbers").alias("n"))
    counts = stage(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "counts").select("pair", "count", F.floor(F.col("pair") / size_b).alias("a"), (F.col("pair") % size_b).alias("b"))
    for side in ("a", "b"):  # a row for each identifier of a vocabulary
        counts = counts.join(F.broadcast(counts.groupBy(side).agg(F.max("count").alias(f"most_{side}"))), side)
    value = counts.select("pair", "count", (F.col("count") == F.col("most_b")).alias("best"), (F.col("count") == F.col("most_a")).alias("best_a"))
    answers = pairs.select("block", "number", "pair").join(value, "pair").select((2 * F.col("block")).alias("key"), "number", "count", (F.col("best").cast("int") + 2 * F.col("best_a").cast("int")).alias("marks"))
    told = rows.filter(F.col("kind") == DOC).select((2 * F.col("block") + 1).alias("key"), F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_a", "n_b", "n_groups", "groups_sha256", "numbers")
    both = answers.unionByName(told, allowMissingColumns=True)
    dealt = both.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, count, marks = None, None, None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part, block, is_doc = batch.slice(a, b - a), keys[a] >> 1, keys[a] & 1
                if block != now:
                    now, held, count = block, [], None
                if not is_doc:
                    held.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("number", "count", "marks")))
                    continue
                if count is None:
                    at, counted, marked = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), (), ())))
                    count, marks = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
                    count[at], marks[at] = counted, marked
                    held = []
                yield _told(part, count, marks)

    def _told(part: pa.RecordBatch, count: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        lists = part.column("numbers")
        sums = np.zeros((3, len(lists)), np.int64)
        n = np.zeros(len(lists), np.int64)
        for k, x in enumerate(lists):
            if len(x.values):
                number = np.cumsum(x.values.to_numpy())
                n[k], mark = len(number), marks[number]
                sums[:, k] = (mark & 1).sum(), count[number].sum(), (mark >> 1).sum()
        columns = [part.column("doc_id"), part.column("n_a"), part.column("n_b"), part.column("n_groups"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), part.column("groups_sha256"), pa.array(sums[2])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a"])

    return dealt.mapInArrow(trimmed(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long")
