"""Files in shared storage, as tasks open them piece by piece."""

from __future__ import annotations

import bisect
import re
import zlib
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Path schemes that ``store`` opens in a task; a path without one is in a mounted folder.
OPENED = ("file", "s3", "s3a", "gs")
#: How a member of a gzip file begins.
GZIP = b"\x1f"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme not in OPENED:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


_OPENED_PATH = f"^(({'|'.join(OPENED)}):)?/"


def is_opened(path: Column) -> Column:
    """Whether tasks can open the path themselves."""
    return F.rlike(path, F.lit(_OPENED_PATH))


def opened_path(spark: SparkSession, path: str) -> str | None:
    """The path with its scheme, or None if tasks cannot open it themselves."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return whole if re.match(_OPENED_PATH, whole) else None


def open_file(path: str) -> BinaryIO:
    """A file to be read from any place; one packed with gzip as what it holds."""
    files, place = store(path)
    file = files.open_input_file(place)
    return Unpacked(file) if place.endswith(".gz") else file


class Unpacked:
    """A gzip file, of any number of members, read as what it holds.

    Places on the way are remembered, so going back unpacks some MB anew at most.
    """

    def __init__(self, file: BinaryIO, step: int = 4 * 1024 * 1024, chunk: int = 32 * 1024) -> None:
        self._file, self._step, self._chunk = file, step, chunk
        # of each place: where it is in the file and, within a member, the state there
        self._places, self._marks = [0], [(0, None)]
        self._go(0)

    def __enter__(self) -> Unpacked:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def _go(self, i: int) -> None:
        self._done, (self._at, state) = self._places[i], self._marks[i]
        self._file.seek(self._at)
        self._state = state and state.copy()
        self._packed = self._held = b""

    def _next(self) -> bytes:
        """The bytes that come next, none at the end."""
        while True:
            if not self._packed:
                self._packed = self._file.read(self._chunk)
                self._at += len(self._packed)
            # what follows the last member is no part of it
            if not self._packed or (self._state is None and self._packed[:1] != GZIP):
                return b""
            if self._state is None:
                if self._done - self._places[-1] >= self._step:
                    self._mark(self._at - len(self._packed), None)
                self._state = zlib.decompressobj(31)
            data = self._state.decompress(self._packed)
            self._packed = self._state.unused_data
            self._done += len(data)
            if self._state.eof:
                self._state = None
            elif self._done - self._places[-1] >= 16 * self._step:  # a state takes memory, the start of a member none
                self._mark(self._at, self._state.copy())
            if data:
                return data

    def _mark(self, at: int, state: object) -> None:
        self._places.append(self._done)
        self._marks.append((at, state))

    def tell(self) -> int:
        return self._done - len(self._held)

    def read(self, size: int = -1) -> bytes:
        parts, length = [self._held], len(self._held)
        while (size < 0 or length < size) and (data := self._next()):
            parts.append(data)
            length += len(data)
        whole = b"".join(parts)
        end = len(whole) if size < 0 else size
        self._held = whole[end:]
        return whole[:end]

    def seek(self, place: int) -> int:
        i = bisect.bisect_right(self._places, place) - 1
        if place < self.tell() or self._places[i] > self.tell():
            self._go(i)
        while self.tell() < place and self.read(min(place - self.tell(), self._step)):
            pass
        return self.tell()
