"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

Layout of a block (little-endian): magic ``EFT1``; id width in bytes (2 or 4); low-bit count; documents n; ids N (64 bits);
ids of this file before the block (64 bits); then the ids; the packed low bits of the n + 1 boundaries; the bit vector of their high
parts in unary; and a select directory with the position of every 256th one. Boundaries cost about 2 + log2(N / n) bits each, and
``Boundaries.select`` finds one in a directory step and a short scan.

A dataset is a Parquet table of blocks (file, block, n_ids, doc_ids, payload) so that Spark's committer publishes it
atomically on any store, a lost executor's task is simply run again, and reading is a plain scan. File k holds the k-th range of
document identifiers, of about ``FILE`` bytes of text; blocks hold about ``BLOCK`` ids and are written as a stream.

Edge cases: null doc_ids come first; equal doc_ids are ordered by a hash of the text, then by the text, so that many of them are still dealt to several files; a null or empty text holds the
end id alone; a document of any length goes into one block; an empty table gives an empty dataset;
columns besides ``doc_id`` and ``text`` are ignored whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, claim, slices, texts, trimmed, uncollected

BLOCK = 1_000_000
#: Most bytes of text in a file, unless one document has more, and least before a file of its own is worth while.
FILE, SMALL = 128_000_000, 8_000_000
#: Bytes of text that are encoded at once, one document at least.
GROUP = 8_000_000
SAMPLE = 256
MAGIC = b"EFT1"
_HEAD = struct.Struct("<4sBBIQQ")
_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)
#: Place of the k-th one in a byte, at 8 * byte + k.
_PLACE = np.array([[*(i for i in range(8) if x >> i & 1), *[0] * 8][:8] for x in range(256)], np.uint8).ravel()
SCHEMA = "file int, block int, n_ids long, doc_ids array<long>, payload binary"


class Boundaries:
    """Ascending integers 0 = b[0] <= ... <= b[n] in Elias-Fano form."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, n: int):
        self.low_bits, self.low, self.high, self.samples, self.n = low_bits, low, high, samples, n

    @classmethod
    def of(cls, values: np.ndarray) -> Boundaries:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32), n)

    def _low(self, i: int) -> int:
        at, value = i * self.low_bits, 0
        for k in range(self.low_bits):
            value |= (int(self.low[(at + k) >> 3]) >> ((at + k) & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """The i-th value, by the directory and a scan of at most the bytes up to the next sampled one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, first = at >> 3, int(self.high[at >> 3]) >> (at & 7) << (at & 7)
        while left >= first.bit_count():
            left -= first.bit_count()
            byte += 1
            first = int(self.high[byte])
        for _ in range(left):
            first &= first - 1
        one = 8 * byte + ((first & -first).bit_length() - 1)
        return ((one - i) << self.low_bits) | self._low(i)

    def selects(self, first: int, last: int) -> np.ndarray:
        """The values ``first`` to ``last`` - 1: the directory gives the byte of the first one, counts of ones in bytes the others."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        i = np.arange(first, last)
        if not len(i):
            return i
        byte, skipped = int(self.samples[first // SAMPLE]) >> 3, first // SAMPLE * SAMPLE
        skipped -= int(_ONES[self.high[byte] & ((1 << (int(self.samples[first // SAMPLE]) & 7)) - 1)])  # ones before this byte
        after = -(-last // SAMPLE)
        end = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        run = self.high[byte:end]
        upto = skipped + np.cumsum(_ONES[run], dtype=np.int64)
        at = np.searchsorted(upto, i, "right")
        nth = i - (upto[at] - _ONES[run[at]])
        ones = 8 * (byte + at) + _PLACE[8 * run[at].astype(np.int64) + nth]
        out = (ones - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << k
        return out

    def pack(self) -> bytes:
        sizes = struct.pack("<III", len(self.low), len(self.high), len(self.samples))
        return sizes + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes, low_bits: int, n: int) -> Boundaries:
        a, b, c = struct.unpack_from("<III", data)
        low, high = np.frombuffer(data, np.uint8, a, 12), np.frombuffer(data, np.uint8, b, 12 + a)
        return cls(low_bits, low, high, np.frombuffer(data, "<u4", c, 12 + a + b), n)


def pack_block(ids: np.ndarray, sizes: np.ndarray, before: int, width: int) -> bytes:
    """A block of documents: their ids one after the other, and how many each has."""
    ef = Boundaries.of(np.concatenate(([0], np.cumsum(sizes))))
    return _HEAD.pack(MAGIC, width, ef.low_bits, len(sizes), len(ids), before) + ids.astype(f"<u{width}").tobytes() + ef.pack()


class Block:
    """Random access to the documents of a packed block."""

    def __init__(self, data: bytes):
        magic, width, low_bits, self.n, total, self.before = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id block")
        self.ids = np.frombuffer(data, f"<u{width}", total, _HEAD.size)
        self.boundaries = Boundaries.unpack(data[_HEAD.size + width * total :], low_bits, self.n + 1)

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """Ids of the file before document i, and its ids."""
        a, b = self.boundaries.select(i), self.boundaries.select(i + 1)
        return self.before + a, self.ids[a:b]


class LibraryEncoder:
    """Encodes with the tokenizers library, distinct pieces of text once while they stay in a bounded memo.

    A byte-level pre-tokenizer never joins white space to a character before it that is none, so a text may be cut before each run of white space. Texts
    whose white space is single blanks and line feeds between other characters are cut by Arrow's kernels, which also find the distinct pieces of many texts; other texts are
    cut by an expression. Missing pieces are encoded in one call: those that begin with white space and end without it stand side by side, others are kept apart by the vocabulary's special
    token; the tokens' lengths in bytes tell where a piece ends. Texts that hold the special token itself, or a character that expressions do not agree to be white
    space, are encoded whole.
    """

    #: Unicode's white space, and characters that some engines take for it.
    SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    UNSURE = "\x00\x1c-\x1f\u180e\u200b\ufeff"

    def __init__(self, path: str, memo: int = 600_000):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        special = [x for x in spec["added_tokens"] if x["special"] and not (x["lstrip"] or x["rstrip"] or x["single_word"])]
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and len(special) == len(spec["added_tokens"]) == 1
        self.mark, mark_id = (special[0]["content"], special[0]["id"]) if self.cut else ("", -1)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self.library.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # the byte-level alphabet has a character for each byte
            self.length[i] = len(self.mark.encode()) if i == mark_id else len(token)
        self.whole = f"[{self.UNSURE}]" + (f"|{re.escape(self.mark)}" if self.mark else "")
        others = self.SPACE.replace(" ", "").replace("\n", "")
        self.odd = rf"^[ \n]|[ \n][ \n]|[{others}]|{self.whole}"
        self.pieces = re.compile(f"[{self.SPACE}]+[^{self.SPACE}]*|^[^{self.SPACE}]+").findall
        self.joins = re.compile(f"(?s)[{self.SPACE}].*[^{self.SPACE}]").fullmatch
        self.memo = Memo(memo)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, keys: list[str]) -> None:
        for k in range(0, len(keys), 20_000):
            joined: tuple[list, list] = ([], [])
            for x in keys[k : k + 20_000]:
                piece = x if x[:1] == "\n" else x[1:] if x[:1] == "\0" else " " + x
                joined[not self.joins(piece)].append((x, piece))
            parts = [p for _, p in joined[0]] + [y for _, p in joined[1] for y in (self.mark, p)]
            ids = self._library("".join(parts))
            ends = np.cumsum(self.length[ids])
            upto = np.cumsum(np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)))
            cuts = np.searchsorted(ends, upto) + 1
            if len(ids) != cuts[-1] or (ends[cuts - 1] != upto).any():
                raise ValueError("the tokens do not spell the text")
            raw, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
            n = len(joined[0])
            self.memo.now.update((x, raw[cuts[i] : cuts[i + 1]]) for i, (x, _) in enumerate(joined[0]))
            self.memo.now.update((x, raw[cuts[n + 2 * i + 1] : cuts[n + 2 * i + 2]]) for i, (x, _) in enumerate(joined[1]))

    def _values(self, keys: list[str]) -> list[bytes]:
        memo = self.memo
        found = list(map(memo.now.get, keys))
        missing = [i for i, v in enumerate(found) if v is None]
        memo.room(len(missing))
        for i in missing:
            if (v := memo.old.get(keys[i])) is not None:
                memo.now[keys[i]] = found[i] = v
        missing = [i for i in missing if found[i] is None]
        self._learn([keys[i] for i in missing])
        for i in missing:
            found[i] = memo.now[keys[i]]
        return found

    def _cut(self, rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The keys of the pieces of all texts, and how many each text has. All texts that are not cut by kernels have keys that begin with a zero byte."""
        odd = pc.match_substring_regex(rows, self.odd)
        if not pc.any(odd).as_py():
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\0", rows, ""), "\n", " \n"), " ")
            return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        plain, sizes, keys = pc.invert(odd), np.zeros(len(rows), np.int64), []
        for some, cut in ((plain, None), (odd, self.pieces)):
            texts_ = rows.filter(some)
            if cut is None:
                flat, n = self._cut(texts_) if len(texts_) else (pa.array([], rows.type), np.empty(0, np.int64))
            else:
                lists = [["\0" + p for p in cut(t)] for t in texts_.to_pylist()]
                flat, n = pa.array([p for x in lists for p in x], rows.type), np.array([len(x) for x in lists], np.int64)
            sizes[some.to_numpy(zero_copy_only=False)] = n
            keys.append((flat, n))
        where = np.concatenate([np.flatnonzero(some.to_numpy(zero_copy_only=False)) for some in (plain, odd)])
        starts = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in keys]))[:-1]))
        first = np.empty(len(rows), np.int64)
        first[where] = starts
        order = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return pa.concat_arrays([flat for flat, _ in keys]).take(pa.array(order)), sizes

    def encode(self, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not self.cut:
            return self._apart(rows)
        whole = pc.match_substring_regex(rows, self.whole)
        if pc.any(whole).as_py():
            return self._apart(rows, whole)
        flat, sizes = self._cut(rows)
        coded = flat.dictionary_encode()
        values = self._values(coded.dictionary.to_pylist())
        n = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.frombuffer(b"".join(values), np.uint32)))
        indices = coded.indices
        per_piece = np.concatenate(([0], np.cumsum(n[indices.to_numpy()])))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return lists.take(indices).flatten().to_numpy(), np.diff(per_piece[ends])

    def _apart(self, rows: pa.Array, whole: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Text by text: those marked ``whole`` (by default all) by the library as they are, the others cut."""
        ids = [self._library(t.as_py()) if whole is None or w.as_py() else self.encode(rows.slice(i, 1))[0] for i, (t, w) in enumerate(zip(rows, whole if whole is not None else rows, strict=True))]
        return np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.uint32), np.array([len(x) for x in ids], np.int64)


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    claim("token_file", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def token_blocks(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """The blocks of a token-id dataset: one range shuffle by ``doc_id``, then a streamed encoding of each range.

    The vocabulary file must exist on every executor.
    """
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SMALL))
    parts = max(1, least, -(-size // FILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file = encoder(path), TaskContext.get().partitionId()
        names, ids, sizes, held, before, block = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = pack_block(np.concatenate(ids), np.concatenate(sizes), before, enc.width)
            owners = pa.concat_arrays(names)
            listed = pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), listed, pa.array([payload], pa.binary())], ["file", "block", "n_ids", "doc_ids", "payload"])

        for part in slices(batches, "text", GROUP):
            with uncollected():  # many small objects and no cycles among them
                flat, n = enc.encode(part.column("text"))
            flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
            at, done = np.concatenate(([0], np.cumsum(n))), 0
            while done < len(n):  # to the document that fills the block
                upto = min(len(n), max(done + 1, int(np.searchsorted(at, at[done] + BLOCK - held))))
                names.append(part.column("doc_id").slice(done, upto - done))
                ids.append(flat[at[done] : at[upto]])
                sizes.append(n[done:upto])
                held += int(at[upto] - at[done])
                done = upto
                if held >= BLOCK:
                    yield flush()
                    names, ids, sizes, before, block, held = [], [], [], before + held, block + 1, 0
        if names:
            yield flush()

    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return ordered.mapInArrow(trimmed(run), SCHEMA)


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 0) -> None:
    """Write the dataset at ``out``, a folder that all executors share."""
    token_blocks(docs, path, end_id).write.parquet(out)


def _starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each file. The driver sums ids by file: as many numbers as there are files of up to ``FILE`` bytes of text."""
    starts, total = {}, 0
    for r in sorted(blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()):
        starts[r["file"]] = total
        total += r["n"]
    return starts


def read_token_files(spark: SparkSession, where: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` of each document, by selects on the blocks' boundaries.

    ``start`` counts the ids of all documents before.
    """
    blocks = spark.read.schema(SCHEMA).parquet(where)
    starts = _starts(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, names, payload in zip(*(batch.column(c) for c in ("file", "doc_ids", "payload")), strict=True):
                block = Block(payload.as_py())
                at, wide = block.boundaries.selects(0, block.n + 1), block.ids.astype("<u4")
                cuts = at.tolist()
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [names.values, pa.array(at[:-1] + (starts[file.as_py()] + block.before), pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.select("file", "doc_ids", "payload").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_documents(spark: SparkSession, where: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of the documents whose ``doc_id`` is in ``wanted``: random access by two selects a document.

    A document that is not there gives no row, repeated ones a row each; null doc_ids are never wanted.
    """
    blocks = spark.read.schema(SCHEMA).parquet(where)
    starts = _starts(blocks)
    places = blocks.select("file", "block", F.posexplode("doc_ids").alias("place", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = places.groupBy("file", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most the documents of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, names, payload, some in zip(*(batch.column(c) for c in ("file", "doc_ids", "payload", "places")), strict=True):
                block, some = Block(payload.as_py()), some.as_py()
                found = [block.document(i) for i in some]
                columns = [names.values.take(pa.array(some)), pa.array([starts[file.as_py()] + a for a, _ in found], pa.int64()), pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    return blocks.join(asked, ["file", "block"]).select("file", "doc_ids", "payload", "places").mapInArrow(trimmed(run), "doc_id long, start long, ids array<int>")
