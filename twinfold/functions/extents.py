"""Hole maps of sparse files, and digests of byte ranges that read data only.

A hole's zeros are fed to the digest from memory, so a digest is that of the whole bytes while only data is read. Where the file system does not tell holes, all is data.
"""

from __future__ import annotations

import errno
import hashlib
import os
from collections.abc import Iterator

from twinfold.functions.paths import raw_of

READ = 1 << 20
ZEROS = bytes(READ)


def hasher(alg: str):
    if alg == "xxhash":
        import xxhash

        return xxhash.xxh64(seed=1)
    return hashlib.new(alg)


def finished(h, alg: str) -> bytes:
    """The digest in memory order."""
    return h.digest()[::-1] if alg == "xxhash" else h.digest()


def extents(fd: int, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """``start, length, whether data`` of what lies between two offsets of an open file, in order and without gaps."""
    at = start
    while at < end:
        try:
            data = min(end, os.lseek(fd, at, os.SEEK_DATA))
        except OSError as e:
            if e.errno != errno.ENXIO:  # no hole maps here
                yield at, end - at, True
                return
            data = end  # no data any more
        if data > at:
            yield at, data - at, False
        if data < end:
            at = min(end, os.lseek(fd, data, os.SEEK_HOLE))
            yield data, at - data, True
        else:
            at = end


def is_sparse(fd: int) -> bool:
    s = os.fstat(fd)
    return s.st_blocks * 512 < s.st_size


def read_range(path: str, alg: str, start: int = 0, length: int | None = None) -> tuple[bytes | None, int, int]:
    """Digest, bytes covered and bytes read of a range of a file (default: to its end); no digest if it cannot be read."""
    h, covered, read = hasher(alg), 0, 0
    try:
        with open(raw_of(path), "rb", buffering=0) as f:
            fd = f.fileno()
            size = os.fstat(fd).st_size
            end = size if length is None else min(size, start + length)
            parts = extents(fd, start, end) if is_sparse(fd) else iter([(start, end - start, True)] if end > start else [])
            for at, n, data in parts:
                if not data:
                    for k in range(0, n, READ):
                        h.update(ZEROS if n - k >= READ else memoryview(ZEROS)[: n - k])
                    covered += n
                    continue
                f.seek(at)
                while n > 0:
                    piece = f.read(min(READ, n))
                    if not piece:  # the file was cut meanwhile
                        return finished(h, alg), covered, read
                    h.update(piece)
                    n -= len(piece)
                    covered += len(piece)
                    read += len(piece)
    except OSError:
        return None, covered, read
    return finished(h, alg), covered, read


def hole_map(path: str) -> list[tuple[int, int, bool]] | None:
    """All extents of a file; None if it cannot be read."""
    try:
        with open(raw_of(path), "rb", buffering=0) as f:
            return list(extents(f.fileno(), 0, os.fstat(f.fileno()).st_size))
    except OSError:
        return None
