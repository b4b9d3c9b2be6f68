"""Paths and their rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(raw: bytes) -> str:
    """A path as text: a byte that is not UTF-8 becomes a zero byte, which no path holds, and its two hex digits."""
    return re.sub("[\udc80-\udcff]", lambda m: f"\0{ord(m[0]) - 0xDC00:02x}", raw.decode("utf-8", "surrogateescape"))


def raw_of(text: str) -> bytes:
    """The path that ``text_of`` gave."""
    return re.sub("\0(..)", lambda m: chr(0xDC00 + int(m[1], 16)), text).encode("utf-8", "surrogateescape")


def hidden(relative: Column) -> Column:
    """Whether a name below the root begins with a dot; such a directory hides all below it."""
    return F.concat(F.lit("/"), relative).contains("/.")


def under(path: Column, prefix: str) -> Column:
    """Whether a path lies at or below a directory; whole components count."""
    top = prefix.rstrip("/")
    return (path == top) | path.startswith(top + "/")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    """The directory of an absolute path; that of an entry of the root is the root."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when((up == "") & path.startswith("/"), "/").otherwise(up)


def cut(path: Column, prefix: str | None) -> Column:
    """Without a leading literal ``prefix``; other paths stay whole."""
    return path if not prefix else F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def csv_quoted(path: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('""')), F.lit('"'))


def shell_quoted(path: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def duration(ms: Column) -> Column:
    """Milliseconds as text: seconds from 10 s on."""
    return F.when(ms <= 10000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(F.floor(ms / 1000).cast("string"), F.lit("s")))
