"""Lines of zstd files of many frames, and of gzip files whatever their names, as a data source that streams.

A zstd file is dealt out by byte ranges: a partition reads the frames that begin in its range. Frames are told by
their magic number and by walking their block headers to the next frame, so nothing is decoded to find them. Lines may
run across frames: a partition drops what precedes its first newline (its predecessor has read it) and goes on past its
range to the end of its last line. Memory is one decoding buffer, whatever the file's size, and no file bytes are
shuffled. A file of one frame, or a gzip file, is one partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
GZIP_MAGIC = b"\x1f\x8b"
RANGE = 64 << 20
BATCH_LINES = 20_000
_CHUNK = 1 << 20


def open_file(path: str):
    """A readable, seekable file of any file system that Arrow knows, and its size."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(inner), where.get_file_info(inner).size


def kind_of(path: str) -> str:
    """zstd, gzip or text, by the first bytes."""
    file, _ = open_file(path)
    with file:
        head = file.read(4)
    return "zstd" if head == ZSTD_MAGIC else "gzip" if head[:2] == GZIP_MAGIC else "text"


def frame_end(file, at: int, size: int) -> int | None:
    """Where the frame at ``at`` ends; None if there is no frame. Reads headers only."""
    file.seek(at)
    head = file.read(18)
    if len(head) < 8:
        return None
    number = int.from_bytes(head[:4], "little")
    if 0x184D2A50 <= number <= 0x184D2A5F:  # a skippable frame
        end = at + 8 + int.from_bytes(head[4:8], "little")
        return end if end <= size else None
    if head[:4] != ZSTD_MAGIC:
        return None
    flags = head[4]
    if flags & 0x08:  # reserved
        return None
    single = flags >> 5 & 1
    content = (1 if single else 0, 2, 4, 8)[flags >> 6]
    place = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        file.seek(place)
        header = file.read(3)
        if len(header) < 3:
            return None
        block = int.from_bytes(header, "little")
        last, kind, length = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            return None
        place += 3 + (1 if kind == 1 else length)
        if last:
            break
    place += 4 if flags & 0x04 else 0
    return place if place <= size else None


def next_frame(file, at: int, stop: int, size: int) -> int | None:
    """The first frame that begins at ``at`` or later, before ``stop``. What looks like a frame must be followed by one or by the end."""
    if at == 0:
        return 0
    keep = b""
    while at < stop:
        file.seek(at)
        data = keep + file.read(min(_CHUNK, size - at))
        base = at - len(keep)
        found = data.find(ZSTD_MAGIC)
        while found >= 0 and base + found < stop:
            end = frame_end(file, base + found, size)
            if end is not None and (end == size or frame_end(file, end, size) is not None):
                return base + found
            found = data.find(ZSTD_MAGIC, found + 1)
        at, keep = base + len(data), data[-3:]
        if len(data) <= 3 or at >= size:
            break
    return None


def _zstd_lines(path: str, start: int, stop: int) -> Iterator[bytes]:
    import zstandard

    file, size = open_file(path)
    with file:
        at = next_frame(file, start, min(stop, size), size)
        if at is None:
            return
        # the first piece up to a newline belongs to the partition before, unless a line ends with the frame before
        first, rest = at > 0, b""
        while at < size:
            end = frame_end(file, at, size)
            if end is None:
                raise ValueError(f"{path}: no whole zstd frame at byte {at}")
            past = at >= stop
            file.seek(at)
            decode, left = zstandard.ZstdDecompressor().decompressobj(), end - at
            skip = left if file.read(4) != ZSTD_MAGIC else 0
            file.seek(at)
            while left > skip:
                data = file.read(min(_CHUNK, left))
                left -= len(data)
                lines = (rest + decode.decompress(data)).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if first:
                        first = False
                    else:
                        yield line
                    if past:
                        return
            at = end
        if rest and not first:
            yield rest


def _gzip_lines(path: str) -> Iterator[bytes]:
    file, _ = open_file(path)
    with file:
        rest, decode = b"", zlib.decompressobj(31)
        while data := file.read(_CHUNK):
            while data:
                lines = (rest + decode.decompress(data)).split(b"\n")
                rest = lines.pop()
                yield from lines
                data = decode.unused_data if decode.eof else b""
                if decode.eof:
                    decode = zlib.decompressobj(31)
        if rest:
            yield rest


class Part(InputPartition):
    def __init__(self, path: str, kind: str, start: int, stop: int) -> None:
        self.path, self.kind, self.start, self.stop = path, kind, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["paths"].split("\n")
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            kind = kind_of(path)
            if kind == "gzip":
                out.append(Part(path, kind, 0, 0))
                continue
            file, size = open_file(path)
            file.close()
            out += [Part(path, kind, at, at + self.range) for at in range(0, max(1, size), self.range)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        lines = _gzip_lines(partition.path) if partition.kind == "gzip" else _zstd_lines(partition.path, partition.start, partition.stop)
        batch: list[str] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(batch)), pa.array(batch, pa.string())], names=["path", "value"])

        for line in lines:
            batch.append(line.decode("utf-8", "replace"))
            if len(batch) == BATCH_LINES:
                yield made()
                batch = []
        if batch:
            yield made()


class CompressedLines(DataSource):
    """``spark.read.format("codonspark_lines").option("paths", newline-separated paths)``: (path, value)."""

    @classmethod
    def name(cls) -> str:
        return "codonspark_lines"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
