"""Lines of text files, every one of them: blank lines count and are returned, so numbers are those of the file.

Encodings whose bytes Spark's own text reader can split (UTF-8, ASCII, Latin-1) are read by it, from any store it reaches, and decoded as columns. All
others go through a data source that splits files by byte ranges itself: a range begins behind the first line end at or after its first byte
(less one unit of the encoding), so each line is read once, by the range in which it begins; units of two or four bytes keep
their alignment, and a byte order mark at the file's start holds for all its ranges.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

#: Encodings that Spark reads and decodes itself, by Python's names for them.
NATIVE = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1"}
SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20
#: Encodings with a mark of the byte order: marks and what they stand for; the first without one.
MARKS = {
    "utf-16": ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")),
    "utf-32": ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be")),
    "utf-8-sig": ((codecs.BOM_UTF8, "utf-8"),),
}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what a path there begins with as a URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file://"
    system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else "file://"


def resolved(start: bytes, encoding: str) -> tuple[str, int]:
    """The encoding without a mark, and the bytes of the mark, of a file that begins with these bytes."""
    name = codecs.lookup(encoding).name
    for mark, plain in MARKS.get(name, ()):
        if start.startswith(mark):
            return plain, len(mark)
    return (MARKS[name][0][1] if name in MARKS else name), 0


def _ends(data: bytes, unit: bytes, last: bool = False) -> int:
    """Behind the first (or last) aligned line end in data; -1 without one."""
    if len(unit) == 1:
        at = data.rfind(unit) if last else data.find(unit)
        return at + 1 if at >= 0 else -1
    rows = np.frombuffer(data[: len(data) // len(unit) * len(unit)], np.uint8).reshape(-1, len(unit))
    hits = np.flatnonzero((rows == np.frombuffer(unit, np.uint8)).all(1))
    return (int(hits[-1 if last else 0]) + 1) * len(unit) if len(hits) else -1


def lines_of(file: pa.NativeFile, start: int, stop: int, encoding: str) -> Iterator[list[str]]:
    """The lines that begin in [start, stop), in lists; line ends are \\n, \\r\\n and \\r, and ranges part at \\n only."""
    encoding, mark = resolved(file.read(4), encoding)
    unit = "\n".encode(encoding)
    width = len(unit)
    start, stop = -(-start // width) * width, -(-stop // width) * width
    at = mark
    if start > mark:  # behind the first line end from one unit before the range
        at = start - width
        file.seek(at)
        while True:
            data = file.read(CHUNK_BYTES // width * width)
            end = _ends(data, unit)
            if end >= 0:
                at += end
                break
            at += len(data)
            if not data:
                return
    if at >= stop:
        return
    file.seek(at)
    held: list[bytes] = []  # of a line that isn't over yet
    while True:
        data = file.read(CHUNK_BYTES // width * width)
        over = not data
        if at + len(data) >= stop:  # the last line of the range is over at the first line end from one unit before its end
            skip = max(0, stop - width - at)
            end = _ends(data[skip:], unit)
            if end >= 0:
                data, over = data[: skip + end], True
        at += len(data)
        end = len(data) if over else max(0, _ends(data, unit, last=True))
        text = b"".join([*held, data[:end]]) if end or over else b""
        held = [data[end:]] if end or over else [*held, data]
        if text:
            made = text.decode(encoding).replace("\r\n", "\n").replace("\r", "\n").split("\n")
            yield made[:-1] if made[-1] == "" else made
        if over:
            return


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.encoding, self.split = json.loads(options["paths"]), options["encoding"], int(options["split"])

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            system, inner, scheme = located(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
            for f in sorted(found, key=lambda f: f.path):
                inside = f.path[len(inner) :].split("/")
                if f.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in inside if x):
                    out += [Range(scheme + f.path, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, inner, _ = located(partition.path)
        k = 0
        with system.open_input_file(inner) as file:
            for lines in lines_of(file, partition.start, partition.stop, self.encoding):
                for a in range(0, len(lines), 10_000):
                    some = lines[a : a + 10_000]
                    n = len(some)
                    columns = [pa.array([partition.path] * n), pa.array([partition.start] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array(some, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "k", "line"])
                    k += n


class Lines(DataSource):
    """Options: paths (JSON list of files and folders), encoding (any of Python's), split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "voltlake_lines"

    def schema(self) -> str:
        return "file string, block long, k long, line string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def numbered_lines(spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8", split: int = SPLIT_BYTES) -> DataFrame:
    """file, n, line: all lines of text files or folders of such, numbered from 0 in each file.

    In two levels: lines are numbered inside the blocks in which a file is read, and a prefix over the blocks' counts does the rest, so a
    large file isn't one task. ``split``: bytes of a block where Spark's own reader doesn't choose them.
    """
    paths = [path] if isinstance(path, str) else list(path)
    native = NATIVE.get(codecs.lookup(encoding).name)
    if native:
        lines = spark.read.option("recursiveFileLookup", True).text(paths)
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m"))
        line = F.col("value") if native == "UTF-8" else F.decode(F.col("value").cast("binary"), native)
        k = F.row_number().over(Window.partitionBy("file", "block").orderBy("_m")) - 1
        lines = lines.select("file", "block", k.cast("long").alias("k"), line.alias("line"))
    else:
        spark.dataSource.register(Lines)
        lines = spark.read.format("voltlake_lines").option("paths", json.dumps(paths)).option("encoding", encoding).option("split", str(split)).load()
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("_before") + F.col("k")).alias("n"), "line")
