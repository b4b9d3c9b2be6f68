"""Schemas and options.

FILES is the table that everything starts from; a tree source and a corpus adapter make it.
"""

from __future__ import annotations

from dataclasses import dataclass

FILES = "root string, path string, dir string, name string, kind string, size long, inode long, dev long, ctime long"
DUPLICATES = "id long, count int, each_size long, paths array<string>"
MEMBERS = "id long, each_size long, path string"
META = "hidden boolean, version string, dbtime long, hardlinks string, buckets int"
CACHE = "path string, size long, ctime long, alg string, hash binary"

#: Digest algorithms with their codes and widths in bytes.
ALGORITHMS = {"md5": (1, 16), "sha1": (2, 20), "sha512": (3, 64), "xxhash": (4, 8)}
#: Verification statuses as they are printed.
STATUS = {"duplicate": "DUP", "hardlink": "HL", "exclude": "xxx", "not_duplicate": "---"}
#: The byte that joins members in exported sets.
SEPARATOR = "\x1c"
VERSION = "1"


@dataclass(frozen=True)
class Options:
    """Scan options. Sizes below ``min_size`` (1 at least) never take part."""

    alg: str = "xxhash"
    min_size: int = 1
    hidden: bool = False
    one_file_system: bool = False
    hardlink_is_unique: bool = False
    skip_separator: bool = True
    #: Bytes of the prefix stages before the full digest; empty: none. They are for files on disk; ``column_rounds`` makes them for contents in a column too, which are then read twice.
    prefixes: tuple[int, ...] = (65536,)
    column_rounds: bool = False
    use_cache: bool = True
    cache_min_size: int = 524288

    def __post_init__(self):
        if self.alg not in ALGORITHMS:
            raise ValueError(f"unknown hash function {self.alg!r}; one of {', '.join(ALGORITHMS)}")
        object.__setattr__(self, "min_size", max(1, self.min_size))
