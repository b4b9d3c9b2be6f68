r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before it as context and only that reply trainable.

The template writes a turn between two marks of its role (other roles are written out in a third mark). Control strings inside texts, the marks themselves, get a backslash in front of
them, and of the backslashes before them; a mark of the template never has one before it, so ``parsed`` gets the turns back exactly.

An example is a row: its text ends with the target's closing mark, and ``mask_start`` and ``mask_end`` bound the target's escaped text in code points. Turns after a section's last
reply, or of a conversation without replies, come in a row with an empty mask, so no turn is lost.

A conversation's turns are dealt out by sections of ``SECTION`` turn numbers, so that a very long one is the work of several tasks. A section gets the turns of all sections before it,
too, and each of its examples begins with them: ``text`` holds the whole context however long the conversation is, and ``context_chars`` says how much of it stands before the
section. The last row of a section (``closes``) is written whether or not it is a reply. Rows grow with the square of a conversation's turns, as the method has it; a conversation has
to fit into a row.

Edge cases: a null text or role is an empty one; null turns come first, all in one section; rows of equal turn are kept, ordered by role and text; a null conv_id is a conversation of
its own; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

#: Turn numbers of a section; characters of rows that go to Spark together.
SECTION, CHARS = 64, 1_000_000
TARGET = "assistant"
#: The opening and closing marks of roles; other roles stand in ``OTHER``, before the text.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), TARGET: ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")

_role_of = {opening: role for role, (opening, _) in MARKS.items()}
_any = "|".join(re.escape(m) for m in (*(m for pair in MARKS.values() for m in pair), *OTHER))
_controls, _escaped, _marks = re.compile(rf"\\*(?:{_any})"), re.compile(rf"\\(\\*(?:{_any}))"), re.compile(rf"(?<!\\)(?:{_any})")

EXAMPLES = "conv_id long, section long, part int, example int, n_turns int, closes boolean, text string, context_chars long, mask_start long, mask_end long"


def escaped(text: str) -> str:
    return _controls.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _escaped.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text begins and ends."""
    opening, closing = MARKS.get(role) or (f"{OTHER[0]} {escaped(role)} {OTHER[1]}", OTHER[2])
    body = escaped(text)
    return f"{opening} {body} {closing}", len(opening) + 1, len(opening) + 1 + len(body)


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    marks = _marks.finditer(text)
    for opening in marks:
        if opening[0] in _role_of:
            role, at = _role_of[opening[0]], opening.end()
        else:
            middle = next(marks)
            role, at = unescaped(text[opening.end() + 1 : middle.start() - 1]), middle.end()
        yield role, unescaped(text[at + 1 : next(marks).start() - 1])


def _section_of(section: int, turns: Iterator[tuple[int, str, str]]) -> Iterator[tuple]:
    """``part, example, n_turns, closes, text, context_chars, mask_start, mask_end`` of a section, whose turns come after those of all sections before it; holds their text."""
    example = size = context = 0
    pieces: list[str] = []
    earlier: set[int] = set()
    turn = next(turns, None)
    while turn is not None:
        (own, role, text), turn = turn, next(turns, None)
        piece, start, end = formatted(role, text)
        pieces.append(piece)
        if own != section:
            earlier.add(own)
            context += len(piece)
        else:
            if role == TARGET:
                yield len(earlier), example, len(pieces), turn is None, "".join(pieces), context, size + start, size + end
            elif turn is None:
                yield len(earlier), example, len(pieces), True, "".join(pieces), context, 0, 0
            example += 1
        size += len(piece)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows of about ``most`` characters in column ``text``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) + 100
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)


_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("section", pa.int64()), ("part", pa.int32()), ("example", pa.int32()), ("n_turns", pa.int32()), ("closes", pa.bool_()), ("text", pa.string()), ("context_chars", pa.int64()), ("mask_start", pa.int64()), ("mask_end", pa.int64())])
_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def examples(conversations: DataFrame, section: int = SECTION, chars: int = CHARS) -> DataFrame:
    """``EXAMPLES`` rows of ``conversations`` (conv_id, turn, role, text), each with its whole context; ``part`` numbers a conversation's sections.

    Turns of conversations of several sections are repeated for the later ones; all are then dealt out by conversation and section.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_rows(batches), key=lambda r: r[:2])
        rows = ((*key, *row) for key, turns in groups for row in _section_of(key[1], (t[2:] for t in turns)))
        yield from _batches(rows, _EXAMPLES, 6, chars)

    turns = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / section), F.lit(-(1 << 62))).cast("long").alias("own"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")),
    )
    long = turns.groupBy(F.col("conv_id").alias("c")).agg(F.collect_set("own").alias("sections")).filter(F.size("sections") > 1)
    asking = F.coalesce(F.filter("sections", lambda s: s >= F.col("own")), F.array("own"))
    told = turns.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", F.explode(asking).alias("section"), "own", "turn", "role", "text")
    order = ("conv_id", "section", "own", F.col("turn").asc_nulls_first(), "role", "text")
    dealt = told.repartition("conv_id", "section").sortWithinPartitions(*order).select("conv_id", "section", "own", "role", "text")
    return dealt.mapInArrow(trimmed(run), EXAMPLES)


def whole_text(rows: DataFrame) -> DataFrame:
    """``conv_id, section, part, example, text`` of the rows of ``examples``."""
    return rows.select("conv_id", "section", "part", "example", "text")


def read_back(rows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, from the rows of ``examples``.

    Turns come from the rows that close a section, losses from all rows; a row sends on its target, and its section's text where it closes. ``formatted_chars`` counts each
    text from its section on. A conversation's digests run over its rows in order, so they go through one task, which holds one row at a time.
    """

    def digests(groups) -> Iterator[tuple]:
        for conv, group in groups:
            turns, losses = hashlib.sha256(), hashlib.sha256()
            n = chars = size = 0
            for _, text, target, length in group:
                size += length
                target = unescaped(target)
                chars += len(target)
                losses.update(target.encode())
                for role, said in parsed(text or ""):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
            yield conv, n, turns.hexdigest(), chars, losses.hexdigest(), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(digests(groupby(_rows(b.select(["conv_id", "text", "target", "chars"]) for b in batches), key=lambda r: r[0])), _BACK, 2, CHARS)

    narrow = rows.select("conv_id", "section", "part", "example", F.when(F.col("closes"), F.expr("substring(text, cast(context_chars AS int) + 1)")).alias("text"), F.expr("substring(text, cast(mask_start AS int) + 1, cast(mask_end - mask_start AS int))").alias("target"), (F.length("text") - F.col("context_chars")).alias("chars"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "section", "part", "example")
    return dealt.mapInArrow(trimmed(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
