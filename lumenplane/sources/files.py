"""Files read by ranges: what a parser or decoder asks for, and no more."""

from __future__ import annotations

import io
import os
import re
from collections import OrderedDict

#: Bytes read at once for small requests, and how many such blocks are kept.
BLOCK, KEPT = 1 << 16, 32


class RangedFile:
    """A file that is cut like bytes; small cuts come from blocks that are kept for the next ones.

    Local paths (plain or file:) are read by position; other addresses by pyarrow's file systems.
    """

    def __init__(self, path: str):
        self.path, self.blocks, self.read_bytes = path, OrderedDict(), 0
        local = re.sub(r"^file:/+", "/", path)
        if "://" in local:
            from pyarrow import fs

            where, inner = fs.FileSystem.from_uri(path)
            self.stream, self.handle = where.open_input_file(inner), None
            self.size = self.stream.size()
        else:
            self.stream, self.handle = None, os.open(local, os.O_RDONLY)
            self.size = os.fstat(self.handle).st_size

    def close(self) -> None:
        if self.handle is not None:
            os.close(self.handle)
            self.handle = None
        elif self.stream is not None:
            self.stream.close()

    def __len__(self) -> int:
        return self.size

    def _read(self, start: int, stop: int) -> bytes:
        self.read_bytes += stop - start
        if self.handle is None:
            return self.stream.read_at(stop - start, start)
        out = b""
        while len(out) < stop - start:
            more = os.pread(self.handle, stop - start - len(out), start + len(out))
            if not more:
                break
            out += more
        return out

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self._read(k * BLOCK, min(self.size, (k + 1) * BLOCK))
            if len(self.blocks) > KEPT:
                self.blocks.popitem(last=False)
        else:
            self.blocks.move_to_end(k)
        return self.blocks[k]

    def __getitem__(self, part):
        if not isinstance(part, slice):
            return self[part : part + 1][0]
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        first, last = start // BLOCK, (stop - 1) // BLOCK
        if last - first > 1:
            return self._read(start, stop)
        return b"".join(self._block(k) for k in range(first, last + 1))[start - first * BLOCK : stop - first * BLOCK]

    def startswith(self, mark: bytes) -> bool:
        return self[: len(mark)] == mark

    def find(self, mark: bytes, start: int = 0) -> int:
        while start < self.size:
            at = self[start : start + BLOCK + len(mark) - 1].find(mark)
            if at >= 0:
                return start + at
            start += BLOCK
        return -1

    def cursor(self) -> io.BufferedReader:
        """A file object over the same blocks, with a place of its own."""
        return io.BufferedReader(_Cursor(self), BLOCK)


class _Cursor(io.RawIOBase):
    def __init__(self, file: RangedFile):
        self.file, self.place = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        place = offset + (0, self.place, len(self.file))[whence]
        if place < 0:
            raise ValueError("a place in front of the file")
        self.place = place
        return place

    def tell(self) -> int:
        return self.place

    def readinto(self, buffer) -> int:
        got = self.file[self.place : self.place + len(buffer)]
        buffer[: len(got)] = got
        self.place += len(got)
        return len(got)
