"""Lines of block-compressed text (as of bgzip), read by as many tasks as the files have splits, and written.

A block is a gzip member of at most 64 KB that states its own length in an extra field, so a task can
start at any byte: it looks for the next header that is followed by another block.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the format: the first bytes of a block, the most bytes of a block, the usual text of one, the block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
MOST, TEXT = 1 << 16, 65280
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes looked at for a header.
HEAD = 256
#: Characters of a batch of lines.
BATCH = 4 << 20
#: Compressed bytes of a split.
SPLIT = 32 << 20
#: Splits up to which each has a task; of more, neighbours share one, up to `SPLIT` bytes.
TASKS = 256


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, of those that Arrow knows (local, hdfs, s3, gs)."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{'/' if scheme == 'file' else ''}{rest.lstrip('/')}")


def block(text: bytes) -> bytes:
    """One block of at most `TEXT` bytes of text."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(text) + squeeze.flush()
    size = len(body) + 25  # a header of 18 bytes and a tail of 8, less one
    return MAGIC + bytes.fromhex("0000000000ff060042430200") + size.to_bytes(2, "little") + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def block_size(head: bytes) -> int:
    """Bytes of the block that starts so; 0 if none does."""
    if len(head) < 18 or not head.startswith(MAGIC):
        return 0
    extra = head[12 : 12 + int.from_bytes(head[10:12], "little")]
    while len(extra) >= 4:
        n = int.from_bytes(extra[2:4], "little")
        if extra[:2] == b"BC" and n == 2:
            return int.from_bytes(extra[4:6], "little") + 1
        extra = extra[4 + n :]
    return 0


def first_block(f, start: int, size: int) -> int:
    """Place of the first block at or after a byte; the file's size if there is none."""
    if start == 0:
        return 0
    f.seek(start)
    near = f.read(2 * MOST + HEAD)
    at = near.find(MAGIC)
    while at >= 0:
        n = block_size(near[at : at + HEAD])
        # One that goes beyond the file is taken too: reading it is an error, not a silent end.
        if n and (start + at + n >= size or block_size(near[at + n : at + n + HEAD])):
            return start + at
        at = near.find(MAGIC, at + 1)
    return size


def texts(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the blocks from a place on."""
    while at < size:
        f.seek(at)
        raw = f.read(MOST)
        n = block_size(raw[:HEAD])
        if not n or len(raw) < n:
            raise ValueError(f"no whole block at byte {at}")
        yield at, zlib.decompress(raw[:n], 31)
        at += n


def members(f) -> Iterator[bytes]:
    """Text of a gzip file that has no blocks, in pieces."""
    f.seek(0)
    inflate, raw = zlib.decompressobj(31), f.read(1 << 20)
    while raw:
        piece = inflate.decompress(raw, BATCH)
        if piece:
            yield piece
        raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        raw = raw or f.read(1 << 20)


def whole_lines(pieces: Iterator[tuple[bool, bytes]], skip: bool) -> Iterator[bytes]:
    """Runs of whole lines, without the last line feed. Pieces are told to be the split's own or those after it.

    A line belongs to the split that holds the byte before it, and the first to the first split, so
    what comes before the first line feed is left out (skip), and the last line is read to its end.
    """
    held: list[bytes] = []
    for own, text in pieces:
        if not own and skip:
            return
        if skip:
            at = text.find(b"\n")
            if at < 0:
                continue
            skip, text = False, text[at + 1 :]
        at = text.rfind(b"\n") if own else text.find(b"\n")
        if at < 0:
            held.append(text)
            continue
        yield b"".join([*held, text[:at]])
        if not own:
            return
        held = [text[at + 1 :]]
    last = b"".join(held)
    if last:
        yield last


def split_lines(uri: str, start: int, end: int) -> Iterator[list[str]]:
    """Lines of one split in batches; of a file without blocks, all at its first split."""
    system, path = opened(uri)
    size = system.get_file_info(path).size
    with system.open_input_file(path) as f:
        if block_size(f.read(HEAD)):
            first = first_block(f, start, size)
            if first >= end:
                return
            runs = whole_lines(((at < end, text) for at, text in texts(f, first, size)), start > 0)
        elif start == 0:
            runs = whole_lines(((True, text) for text in members(f)), False)
        else:
            return
        batch, held = [], 0
        for run in runs:
            batch += [line.removesuffix("\r") for line in run.decode("utf-8", "replace").split("\n")]
            held += len(run)
            if held >= BATCH:
                yield batch
                batch, held = [], 0
        if batch:
            yield batch


@dataclass
class Split:
    file: str
    start: int
    end: int


@dataclass
class Run(InputPartition):
    """Neighbouring splits that a task reads one after the other."""

    splits: list[Split]


def runs(splits: list[Split], split: int) -> list[list[Split]]:
    """Splits of `split` bytes as the tasks read them, in their order."""
    n = max(1, min(SPLIT // max(1, split), -(-len(splits) // TASKS)))
    return [splits[i : i + n] for i in range(0, len(splits), n)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files, self.split = json.loads(options["files"]), int(options["split"])

    def partitions(self) -> list[Run]:
        found = []
        for file in sorted(self.files):
            system, path = opened(file)
            found += [Split(file, a, a + self.split) for a in range(0, system.get_file_info(path).size or 0, self.split)]
        return [Run(own) for own in runs(found, self.split)] or [Run([])]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        for split in run.splits:
            for lines in split_lines(split.file, split.start, split.end):
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([split.file] * n, pa.string()), pa.array([split.start] * n, pa.int64())], ["value", "file", "start"])


@dataclass
class _Part(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    """A file per task under a name of its own; only files of tasks that were committed get their last names."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.text, self.run, self.overwrite = options["path"], int(options.get("text", TEXT)), uuid.uuid4().hex, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        system, root = opened(self.path)
        system.create_dir(f"{root}/_temporary", recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{self.run}-{uuid.uuid4().hex}.gz"
        with system.open_output_stream(f"{root}/_temporary/{name}", compression=None) as out:
            held = b""
            for batch in batches:
                held += "".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode()
                cut = len(held) - len(held) % self.text
                for a in range(0, cut, self.text):
                    out.write(block(held[a : a + self.text]))
                held = held[cut:]
            if held:
                out.write(block(held))
            out.write(END)
        return _Part(name)

    def commit(self, parts: list) -> None:
        system, root = opened(self.path)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.is_file:
                    system.delete_file(old.path)
        for part in parts:
            if part is not None:
                at = part.name.index(self.run) + len(self.run)
                system.move(f"{root}/_temporary/{part.name}", f"{root}/{part.name[:at]}.gz")
        system.delete_dir(f"{root}/_temporary")

    def abort(self, parts: list) -> None:
        system, root = opened(self.path)
        for part in parts:
            if part is not None:
                system.delete_file(f"{root}/_temporary/{part.name}")


class BlockLines(DataSource):
    """Format `block_lines`: lines of block-compressed files, each with its file and the start of its split."""

    @classmethod
    def name(cls) -> str:
        return "block_lines"

    def schema(self) -> str:
        return "value string, file string, start long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def is_compressed(files: list[str]) -> bool:
    """Whether all are gzip by name, in file systems that tasks can open."""
    return bool(files) and all(f.endswith((".gz", ".bgz")) for f in files) and can_open(files[0])


def can_open(uri: str) -> bool:
    """Whether Arrow knows the file system of a URI."""
    try:
        opened(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def has_blocks(file: str) -> bool:
    """Whether a file starts with a block."""
    system, path = opened(file)
    with system.open_input_file(path) as f:
        return block_size(f.read(HEAD)) > 0


def read_lines(spark: SparkSession, files: list[str], split: int = SPLIT) -> DataFrame:
    """value, file, start (of the split), a task for each split of a file, or, of more than `TASKS`, for some that follow
    each other, so that small splits don't cost a start of a worker each. Gzip without blocks is one split a file.

    Lines end with a line feed, or a carriage return and one. No files or empty ones: no rows. A file
    that ends inside a block raises an error.
    """
    spark.dataSource.register(BlockLines)
    return spark.read.format("block_lines").options(files=json.dumps(files), split=split).load()


def write_lines(lines: DataFrame, path: str, text: int = TEXT) -> None:
    """Writes lines (value) as a folder of block-compressed files, a file per task, named in the order of the tasks.

    `text` is the text of a block in bytes. Null counts as an empty line. Files that are there are replaced.
    """
    lines.sparkSession.dataSource.register(BlockLines)
    lines.selectExpr("coalesce(value, '') as value").write.format("block_lines").mode("overwrite").options(path=path, text=text).save()
