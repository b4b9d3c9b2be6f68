"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust their score.

Base kinds, each leftmost and non-overlapping within its kind, failing matches dropped without a retry: ``email``;
``ip`` (four parts of at most 255); ``card`` (13 to 19 digits, Luhn); ``phone`` (plus sign, 9 to 15 digits). Base spans always
stay. Further kinds are kept when their score reaches ``THRESHOLD``: ``iban`` (mod-97 confirmed) and ``ssn`` (dashed, has no
checksum, so only a context word nearby lifts it over the threshold).

Offsets are code points, end exclusive. Edge cases: a null or empty text has no spans; every row, repeated or not, gets its own result; an
empty table gives no rows; all expressions run in time linear in the text, so very long texts are fine;
columns besides those used are carried or dropped as the function states, whatever their names.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, slices, texts, trim, trimmed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.6
#: Bytes of the texts that are worked on at once, one text at least.
GROUP = 2_000_000
#: Code points looked at on either side of a span.
NEAR = 48
#: Score of a proposed span, and of one that a checksum or range check confirmed.
PROPOSED, CONFIRMED = {"ssn": 0.4}, {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.9}
WORDS = {
    "email": "email mail contact reply",
    "ip": "ip address host server client",
    "card": "card credit visa debit payment",
    "phone": "phone tel call mobile fax cell",
    "iban": "iban account bank transfer",
    "ssn": "ssn social security taxpayer",
}
AGAINST = re.compile(r"\b(?:example|sample|version|order|invoice|isbn|part)\b", re.I)
CONTEXT = {k: re.compile(rf"\b(?:{'|'.join(v.split())})\b", re.I) for k, v in WORDS.items()}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start within a run of digits fails whenever the start of the run does, so the runs' starts suffice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    rest = 0
    for c in s[4:] + s[:4]:
        rest = int(str(rest) + str(int(c, 36))) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the whole run before the at sign that no earlier match has taken."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        found["email"] = list(_emails(text))
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].translate(_DIGITS)) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(_DIGITS)) <= 15]
    return found


def score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    near = text[max(0, start - NEAR) : start] + " \n " + text[end : end + NEAR]
    s = CONFIRMED[kind] if confirmed else PROPOSED[kind]
    s += 0.25 * bool(CONTEXT[kind].search(near)) - 0.15 * bool(AGAINST.search(near))
    return min(1.0, max(0.0, s))


def _iban(text: str, m: re.Match) -> tuple[int, int] | None:
    """The longest prefix of the proposed span, at a gap or its end, that passes mod-97."""
    s = m[0]
    for cut in [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] == " ")]:
        if 15 <= len(s[:cut].replace(" ", "")) <= 34 and mod97(s[:cut]):
            return m.start(), m.start() + cut
    return None


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """Every kept span as (kind, start, end, score), by kind as listed, then by start."""
    out = [(k, a, b, score(k, text, a, b, True)) for k, found in base_spans(text).items() for a, b in found]
    out += [("iban", *x, score("iban", text, *x, True)) for m in _IBAN.finditer(text) if (x := _iban(text, m))]
    out += [("ssn", *m.span(), s) for m in _SSN.finditer(text) if (s := score("ssn", text, *m.span(), False)) >= THRESHOLD]
    return [x for x in out if x[0] in BASE or x[3] >= THRESHOLD]


def redacted(text: str) -> str:
    """The text with each group of overlapping spans replaced by the kind of its first one, in angle brackets."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b, _ in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join(out) + text[done:] if merged else text


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores`` of every text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for batch in slices(batches, "text", GROUP):
            counts, digests, joined, scores = [[] for _ in BASE], [], [], []
            for t in batch.column("text").to_pylist():
                found = spans(t)
                for k, n in zip(BASE, counts, strict=True):
                    n.append(sum(x[0] == k for x in found))
                base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found if k in BASE)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                joined.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
                scores.append([x[3] for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(scores, pa.list_(pa.float64()))],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"],
            )

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars``, if there, recounted; nulls stay null. All columns are kept."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # vectorised: only this column goes to the workers
        claim("pii")
        for s in batches:
            rows = pa.RecordBatch.from_arrays([s], ["text"])
            parts = [pa.array((None if t is None else redacted(t) for t in x.column(0).to_pylist()), pa.string()) for x in slices([rows], "text", GROUP)]
            yield pa.concat_arrays(parts) if parts else s
            del s, rows, parts
            trim()

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out
