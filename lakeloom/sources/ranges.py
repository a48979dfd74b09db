"""Reads of parts of files, wherever they are: a seek and as many bytes as are asked for.

Tasks open files by pyarrow's file systems, which take local paths and the usual
object stores; a caller may give another opener.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

Opener = Callable[[str], object]


def open_file(path: str):
    """A file with ``seek``, ``read`` and ``size``, of a path or a URI."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


class Ranges:
    """Reads ranges of one file and counts the bytes; a range beyond the file's end is a ValueError."""

    def __init__(self, file, size: int):
        self.file, self.size, self.bytes_read = file, size, 0

    def __call__(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("cut off")
        self.file.seek(offset)
        out = self.file.read(length)
        self.bytes_read += len(out)
        if len(out) < length:
            raise ValueError("cut off")
        return out


@contextmanager
def ranges_of(path: str, opener: Opener = open_file):
    file = opener(path)
    try:
        file.seek(0, 2)
        yield Ranges(file, file.tell())
    finally:
        file.close()


def coalesced(spans: Iterable[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Spans (offset, length) in order, joined where no more than ``gap`` bytes lie between them."""
    out: list[tuple[int, int]] = []
    for offset, length in sorted(spans):
        if out and offset <= out[-1][0] + out[-1][1] + gap:
            start, before = out[-1]
            out[-1] = (start, max(before, offset + length - start))
        else:
            out.append((offset, length))
    return out
