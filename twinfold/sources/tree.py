"""Directory trees as a Spark data source.

Roots are split level by level until there are ``SPLIT`` directories to walk or ``LEVELS`` levels are split: a directory that is split gives its own files, one that is not
is walked whole, and both are dealt to at most ``PARTS`` input partitions. Symbolic links are never followed. Entries that cannot be read, or vanish meanwhile, come as rows of kind
``error``. Names that are not UTF-8 are kept without loss, see ``text_of``.

Filters on name, path, directory, kind and size are pushed down to the reader: directories in which no path can pass are not listed, entries whose names do not pass are not looked at, and only
rows that pass leave it. Filters that it does not know are given back to Spark.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from twinfold.functions.paths import text_of
from twinfold.model import FILES, SEPARATOR, Options


def checked_roots(roots: list[str] | None) -> list[str]:
    """Resolved roots (default: the working directory); each a directory, none within another."""
    out = [os.path.realpath(r) for r in (roots or [os.getcwd()])]
    for r in out:
        if not os.path.isdir(r):
            raise ValueError(f"not a directory: {r}")
    for i, a in enumerate(out):
        for b in out[i + 1 :]:
            if os.path.commonpath([a, b]) in (a, b):
                raise ValueError(f"roots overlap: {a} and {b}")
    return out


SPLIT, LEVELS, PARTS = 64, 4, 1024


class _Part(InputPartition):
    """Directories to walk: (root, directory, whether with all below it), as bytes."""

    def __init__(self, tops: list[tuple[bytes, bytes, bool]]):
        self.tops = tops


#: How a filter's value is compared with a column's.
_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}
_COLUMNS = {"root": 0, "path": 1, "dir": 2, "name": 3, "kind": 4, "size": 5}


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.tests: list[tuple[int, type, object]] = []  # column, kind of filter, value
        self.roots = [os.fsencode(r) for r in json.loads(options["roots"])]
        self.hidden = options.get("hidden", "false") == "true"
        self.one_device = options.get("one_file_system", "false") == "true"

    def _entries(self, top: bytes) -> list[os.DirEntry] | None:
        try:
            with os.scandir(top) as it:
                return [e for e in it if self.hidden or not e.name.startswith(b".")]
        except OSError:
            return None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull) and column in _COLUMNS:
                if column == "size":  # errors have none; the others are never null
                    self.tests.append((_COLUMNS[column], GreaterThanOrEqual, 0))
            elif type(f) in _TESTS and column in _COLUMNS and (f.value is not None):
                self.tests.append((_COLUMNS[column], type(f), f.value))
            else:
                yield f

    def _passes(self, row: tuple, *columns: int) -> bool:
        """Whether a row passes the tests (on some columns); a missing value passes none."""
        return all(row[c] is not None and _TESTS[kind](row[c], value) for c, kind, value in self.tests if not columns or c in columns)

    def _may_hold(self, top: bytes) -> bool:
        """Whether a path below a directory may pass the tests on paths."""
        here = text_of(top).rstrip("/") + "/"
        for c, kind, value in self.tests:
            for v in value if kind is In else (value,):
                if c == 1 and kind in (EqualTo, In):
                    ok = v.startswith(here)
                elif c == 2 and kind in (EqualTo, In):
                    ok = (v.rstrip("/") + "/").startswith(here)
                elif c in (1, 2) and kind is StringStartsWith:
                    ok = v.startswith(here) or here.startswith(v) or here[:-1].startswith(v) or (v + "/").startswith(here)
                else:
                    ok = True
                if ok:
                    break
            else:
                return False
        return True

    def partitions(self):
        own, level = [], [(r, r) for r in self.roots if self._may_hold(r)]
        for _ in range(LEVELS):
            if len(level) >= SPLIT:
                break
            own += level
            level = [(root, e.path) for root, top in level for e in self._entries(top) or [] if e.is_dir(follow_symlinks=False) and self._may_hold(e.path)]
        tops = [(*x, False) for x in own] + [(*x, True) for x in level]
        n = max(1, min(len(tops), PARTS))
        return [_Part(tops[k::n]) for k in range(n)]

    def _row(self, root: bytes, path: bytes, kind: str, s: os.stat_result | None) -> tuple:
        dir_, name = os.path.split(path)
        return (*map(text_of, (root, path, dir_, name)), kind, *((s.st_size, s.st_ino, s.st_dev, int(s.st_ctime)) if s else (None,) * 4))

    @staticmethod
    def _stat(path: bytes) -> os.stat_result | None:
        try:
            return os.lstat(path)
        except OSError:
            return None

    def _elsewhere(self, root: os.stat_result | None, s: os.stat_result | None) -> bool:
        """Whether a directory is left out as it lies on another device than its root."""
        return self.one_device and root is not None and s is not None and s.st_dev != root.st_dev

    def read(self, partition: _Part) -> Iterator[tuple]:
        for root, first, deep in partition.tops:
            at_root = self._stat(root)
            if self._elsewhere(at_root, self._stat(first)):
                continue
            todo = [first]
            while todo:
                top = todo.pop()
                entries = self._entries(top)
                if entries is None:
                    if self._passes(row := self._row(root, top, "error", None)):
                        yield row
                    continue
                for e in entries:
                    if self.tests and not self._named(root, top, e, deep):
                        continue
                    s = self._stat(e.path)
                    if s is not None and stat.S_ISDIR(s.st_mode):
                        if deep and not self._elsewhere(at_root, s) and self._may_hold(e.path):
                            todo.append(e.path)
                        continue
                    row = self._row(root, e.path, "error" if s is None else "file" if stat.S_ISREG(s.st_mode) else "other", s)
                    if self._passes(row):
                        yield row

    def _named(self, root: bytes, top: bytes, e: os.DirEntry, deep: bool) -> bool:
        """Whether an entry is to be looked at: a directory that may hold something, or an entry whose name and path pass."""
        try:
            if e.is_dir(follow_symlinks=False):
                return deep and self._may_hold(e.path)
        except OSError:
            return True
        return self._passes(tuple(map(text_of, (root, e.path, top, e.name))), 0, 1, 2, 3)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def tree(spark: SparkSession, roots: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """All entries but directories, as rows of FILES with kinds file, other and error. Push-down to Python sources is switched on for the session."""
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("filetree").option("roots", json.dumps(checked_roots(roots)))
    out = reader.option("hidden", str(options.hidden).lower()).option("one_file_system", str(options.one_file_system).lower()).load()
    return out if not options.skip_separator else out.withColumn("kind", F.when(F.col("name").contains(SEPARATOR), "badsep").otherwise(F.col("kind")))
