"""FASTA files in byte ranges, plain or in blocked gzip, as a data source of its own.

`sequences(spark, path)` lists a file or a folder on the driver and deals each file in ranges: of bytes for plain text, of compressed bytes for blocked
gzip (members of at most 64 KB that carry their own size, as sequence tools write them). A plain gzip file cannot be entered in its middle
and stays one range. A task owns the records whose preceding line end lies in its range (the first record: the file's beginning) and reads on behind its
end to finish the last one, so each record is read once, whatever the ranges. No index and no walk over a file is needed: a task finds the first
block of its range by the block header, whose size must lead to another header or to the file's end.

A record is a header after ">" at a line's beginning and lines of sequence; white space is left out of these. The gene is the header's first word; records
with an empty header are left out, and so is what precedes the first header. Bytes that are no UTF-8 become the replacement character. Names that begin with
"_" or "." are not read, an empty file has no record, a missing path raises FileNotFoundError. A task holds one record and one batch."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

COLUMNS = ("gene", "header", "seq")
RANGE = 64 << 20  # bytes
READ = 1 << 20
BATCH = 4 << 20  # bytes of text, about, of a batch of rows
MAGIC = b"\x1f\x8b\x08\x04"  # fixed value: gzip, deflate, with extra fields
FIELD = b"BC\x02\x00"  # fixed value: the extra field that holds a block's size less one, in two bytes behind it
HEAD = 18  # bytes of a block's header


@dataclass
class Range(InputPartition):
    path: str
    kind: str  # plain, blocks or whole
    start: int
    end: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _block_size(head: bytes) -> int:
    """The size of the block that begins with head, 0 if none does."""
    return int.from_bytes(head[16:18], "little") + 1 if len(head) >= HEAD and head[:4] == MAGIC and head[12:16] == FIELD else 0


def _first_block(file, start: int, size: int) -> int:
    """Where the first block at or behind start begins; size if there is none."""
    at = start
    while at < size:
        file.seek(at)
        part = file.read(READ)
        found = part.find(MAGIC)
        while found >= 0:
            file.seek(at + found)
            step = _block_size(file.read(HEAD))
            if step:
                file.seek(at + found + step)
                if at + found + step == size or _block_size(file.read(HEAD)):
                    return at + found
            found = part.find(MAGIC, found + 1)
        at += max(1, len(part) - len(MAGIC) + 1)
    return size


def _chunks(file, part: Range, size: int) -> Iterator[tuple[bool, bytes]]:
    """Text from the range on to the file's end, each piece with whether it lies in the range."""
    if part.kind == "plain":
        file.seek(part.start)
        at = part.start
        while data := file.read(min(READ, part.end - at) if at < part.end else READ):
            yield at < part.end, data
            at += len(data)
    elif part.kind == "blocks":
        at = _first_block(file, part.start, size)
        while at < size:
            file.seek(at)
            block = file.read(1 << 16)
            step = _block_size(block)
            if not step or step > len(block):
                raise ValueError(f"{part.path}: no whole block at byte {at}")
            unpacked = zlib.decompressobj(31)
            data = unpacked.decompress(block[:step])
            if not unpacked.eof:
                raise ValueError(f"{part.path}: the block at byte {at} is damaged")
            yield at < part.end, data
            at += step
    else:
        unpacked, data, ended = zlib.decompressobj(31), b"", True
        while data := data or file.read(READ):
            yield True, unpacked.decompress(data, READ)
            ended = unpacked.eof
            data = unpacked.unused_data if ended else unpacked.unconsumed_tail
            if ended:  # another member may follow
                unpacked = zlib.decompressobj(31)
        if not ended:
            yield True, unpacked.flush()
            if not unpacked.eof:
                raise ValueError(f"{part.path}: damaged, its end is missing")


def _records(chunks: Iterator[tuple[bool, bytes]], first: bool, whole: bool) -> Iterator[bytes]:
    """The text behind ">" of each record that the range owns; of its header alone, and what comes with it, unless whole.

    A line end at the end of a piece is held back, since the next piece tells whether a record follows it."""
    held, held_inside, now = (b"\n", True, None) if first else (b"", False, None)
    for inside, data in chunks:
        if not data:
            continue
        if now is None and not inside and not held_inside:
            return
        owner, data = (held_inside if held else inside), held + data
        held, held_inside = (b"\n", inside) if data.endswith(b"\n") else (b"", False)
        parts = (data[:-1] if held else data).split(b"\n>")
        for i, text in enumerate(parts):
            if i:
                if now is not None:
                    yield b"".join(now)
                if not (owner if i == 1 and not parts[0] else inside):
                    return
                now = [text]
            elif now is not None and (whole or b"\n" not in now[-1]):
                now.append(text)
        if held and now is not None and not whole and b"\n" not in now[-1]:
            now.append(b"\n")  # the header is complete
    if now is not None:
        yield b"".join(now)


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names
        if set(self.names) - set(COLUMNS):
            raise ValueError(f"columns are {', '.join(COLUMNS)}; not {', '.join(self.names)}")

    def partitions(self) -> list[Range]:
        system, path = _system(self.options["path"])
        info, span, parts = system.get_file_info(path), int(self.options.get("range", RANGE)), []
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        for f in sorted((f for f in files if f.is_file and f.size and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            with system.open_input_file(f.path) as file:
                head = file.read(HEAD)
            kind = "blocks" if _block_size(head) else "whole" if head[:2] == MAGIC[:2] else "plain"
            bounds = [0, f.size] if kind == "whole" else [*range(0, f.size, span), f.size]
            parts += [Range(f.path, kind, a, b) for a, b in zip(bounds, bounds[1:])]
        return parts or [Range("", "plain", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _system(self.options["path"])
        rows, size = [], 0
        with system.open_input_file(part.path) as file:
            for text in _records(_chunks(file, part, file.size()), part.start == 0, "seq" in self.names):
                head, _, body = text.partition(b"\n")
                header = head.decode("utf-8", "replace").strip()
                if header:
                    row = {"gene": header.split()[0], "header": header}
                    if "seq" in self.names:
                        row["seq"] = body.translate(None, b" \t\r\n\v\f").decode("utf-8", "replace")
                    rows.append(row)
                    size += len(text)
                if size >= BATCH:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in self.names], self.names)


class Sequences(DataSource):
    """Format "sequences". Options: path, range (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)


def sequences(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS, span: int = RANGE) -> DataFrame:
    """The given columns of (gene, header, seq). Without seq the lines of sequence are passed over and never kept."""
    spark.dataSource.register(Sequences)
    return spark.read.format("sequences").schema(", ".join(f"{c} string" for c in columns)).option("range", span).load(path)
