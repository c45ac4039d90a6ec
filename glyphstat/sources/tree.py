"""Folder trees as tables: every file is listed, hidden and empty ones too.

Spark's own file sources leave out names that begin with ``.`` or ``_`` and files of zero bytes. Here a folder is a row;
one round lists all folders of one depth, each in the task it is dealt to, and the folders found are the rows of the next
round. What a round finds is stored, so a lost executor lists its folders again. Links to folders are not followed.

The tree has to be in a store that Python workers reach: a path all machines share, or one that Arrow has a file system for.
"""

import fnmatch
import os
import re
import zlib
from collections.abc import Iterator
from datetime import UTC

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstat.sources.scratch import materialize

_ENTRY = "relative string, modificationTime timestamp, length long, is_folder boolean"
_ENTRY_ARROW = pa.schema([
    ("relative", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("is_folder", pa.bool_()),
])
# Rows, and bytes of content, that a task hands over at a time.
_ROWS, _BYTES = 1_000, 4_000_000
# Stored bytes whose lines a task reads, about.
_TASK_BYTES = 8_000_000
# The highest levels of gzip take four times as long for two hundredths of the room.
_GZIP_LEVEL = 4


def opened(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a root and the path of the root in it."""
    if re.match(r"^(?:file:)?/", root):
        return pyarrow.fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", root).strip("/")
    return pyarrow.fs.FileSystem.from_uri(root.rstrip("/"))


def readable_folder(root: str) -> str | None:
    """The root as Spark's file sources spell it, if it is a folder in a store that Python workers reach."""
    try:
        store, base = opened(root)
        if store.get_file_info(base).type != pyarrow.fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    return os.path.normpath(base) if isinstance(store, pyarrow.fs.LocalFileSystem) else root.rstrip("/")


def _entries(store: pyarrow.fs.FileSystem, base: str, folder: str) -> Iterator[dict]:
    local = isinstance(store, pyarrow.fs.LocalFileSystem)
    for info in store.get_file_info(pyarrow.fs.FileSelector(f"{base}/{folder}".rstrip("/") or "/")):
        is_folder = info.type == pyarrow.fs.FileType.Directory
        if is_folder and local and os.path.islink(info.path):
            continue
        if is_folder or info.type == pyarrow.fs.FileType.File:
            yield {
                "relative": f"{folder}/{info.base_name}".lstrip("/"), "modificationTime": info.mtime.astimezone(UTC) if info.mtime else None,
                "length": 0 if is_folder else info.size, "is_folder": is_folder,
            }


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) of all files below ``root`` whose name fits the pattern."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            made = []
            for folder in batch.column("relative").to_pylist():
                for entry in _entries(store, base, folder):
                    made.append(entry)
                    if len(made) == _ROWS:
                        yield pa.RecordBatch.from_pylist(made, schema=_ENTRY_ARROW)
                        made = []
            yield pa.RecordBatch.from_pylist(made, schema=_ENTRY_ARROW)

    folders = spark.createDataFrame([("",)], "relative string")
    found = []
    while True:
        entries = materialize(folders.repartition("relative").mapInArrow(listed, _ENTRY), "listing")
        found.append(entries.filter("NOT is_folder"))
        folders = entries.filter("is_folder").select("relative")
        if folders.isEmpty():
            break
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    name = F.element_at(F.split("relative", "/"), -1)
    fits = re.sub(r"\\[zZ]$", r"\\z", fnmatch.translate(pattern))
    return files.filter(name.rlike(fits)).select(
        F.concat(F.lit(root.rstrip("/") + "/"), "relative").alias("path"), "modificationTime", "length"
    )


def contents(files: DataFrame, root: str) -> DataFrame:
    """Add the ``content`` of listed files; files are dealt out by their path."""
    fields = "path string, modificationTime timestamp, length long, content binary"
    schema = pa.schema([*(pa.field(n, t) for n, t in (
        ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()),
    ))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            made, size = [], 0
            for row in batch.to_pylist():
                with store.open_input_stream(base + "/" + row["path"][len(root.rstrip("/")) + 1 :]) as stream:
                    made.append(row | {"content": stream.read()})
                size += len(made[-1]["content"])
                if len(made) == _ROWS or size >= _BYTES:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made, size = [], 0
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return files.repartition("path").mapInArrow(read, fields)


def _line_blocks(stream: pa.NativeFile) -> Iterator[bytes]:
    """Runs of whole lines, one break between two of them. Lines end as in Spark's text source: at a line feed, a carriage return or both."""
    rest, begun = b"", False
    while block := stream.read(_BYTES):
        text, begun = rest + (block if begun else block.removeprefix(b"\xef\xbb\xbf")), True
        # A carriage return at the end may be the first half of a break.
        half = text[len(text.removesuffix(b"\r")) :]
        text = text.removesuffix(b"\r")
        if b"\r" in text:
            text = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        whole, ended, rest = text.rpartition(b"\n")
        rest += half
        if ended:
            yield whole
    if rest:
        yield rest.removesuffix(b"\r")


def lines(files: DataFrame, root: str) -> DataFrame:
    """(path, value): the lines of listed files, which the ending of their names tells how to decompress.

    Files are dealt out by their path over as many tasks as their bytes ask for, however many they are. A file is read in one task, a block at a time.
    """
    schema = pa.schema([("path", pa.string()), ("values", pa.list_(pa.string()))])

    def batch_of(paths: list[str], blocks: list[bytes]) -> pa.RecordBatch:
        values = pc.split_pattern(pa.array(blocks, pa.binary()).view(pa.string()), "\n")
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), values], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            paths, blocks, size = [], [], 0
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(base + "/" + path[len(root.rstrip("/")) + 1 :]) as stream:
                    for block in _line_blocks(stream):
                        paths.append(path)
                        blocks.append(block)
                        size += len(block)
                        if size >= _BYTES:
                            yield batch_of(paths, blocks)
                            paths, blocks, size = [], [], 0
            yield batch_of(paths, blocks)

    n_bytes = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = files.select("path").repartition(1 + n_bytes // _TASK_BYTES, "path")
    return dealt.mapInArrow(read, "path string, values array<string>").select("path", F.explode("values").alias("value"))


def _gzipped(content: pa.Buffer) -> Iterator[bytes]:
    packer, view = zlib.compressobj(_GZIP_LEVEL, zlib.DEFLATED, 16 + zlib.MAX_WBITS), memoryview(content)
    for at in range(0, len(view), _BYTES):
        yield packer.compress(view[at : at + _BYTES])
    yield packer.flush()


def write(files: DataFrame, root: str, compression: str | None = None) -> int:
    """Write ``files(relative, content)`` one by one below ``root`` and return how many.

    A file is written aside and moved, so a task that runs twice leaves whole files.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for batch in batches:
            # One content at a time, and no copy of it.
            for relative, content in zip(batch.column("relative").to_pylist(), batch.column("content")):
                folder, _, name = f"{base}/{relative}".rpartition("/")
                store.create_dir(folder, recursive=True)
                aside = f"{folder}/{name}.{os.getpid()}.part"
                body = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                with store.open_output_stream(aside, compression=None if compression == "gzip" else compression) as stream:
                    for piece in _gzipped(body) if compression == "gzip" else (body,):
                        stream.write(piece)
                store.move(aside, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = files.select("relative", F.col("content").cast("binary")).mapInArrow(written, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
