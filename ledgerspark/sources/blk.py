"""Block files as a Spark source.

``spark.read.format("blk").load(folder)`` yields one row per framed block:
file_no, offset, header and raw payload. A partition is one file; the scan takes
``blk00000.dat``, ``blk00001.dat``, ... and ends at the first number missing.
Files are listed and read through Hadoop's file system when given a URI scheme
(``read_blocks``), or directly by the Python data source on mounted paths."""

from __future__ import annotations

import os
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: the marker before each block.
MAGIC = bytes.fromhex("f9beb4d9")
FRAMES = "file_no int, offset long, raw binary, last_in_file boolean, trailing_bytes boolean, parse_error string"
FILE_NAME = "blk%05d.dat"


class FramingError(ValueError):
    """``Invalid`` or ``Eof``, where a file's framing breaks."""


def frames(data: bytes, permissive: bool = False):
    """(offset, payload, last, trailing bytes, error) of each block of a file.

    Zero bytes before a block are padding. A wrong marker is Invalid, a short or
    undersized block Eof; both end the file: raised, or as a row with the error."""
    at, size, waiting = 0, len(data), None
    while True:
        padded = at
        while at < size and data[at] == 0:
            at += 1
        if at >= size:
            if waiting:
                yield (*waiting, True, padded < size, None)
            return
        error, length = None, 0
        if size - at < 8:
            error = "Eof"
        elif data[at : at + 4] != MAGIC:
            error = "Invalid"
        else:
            length = struct.unpack_from("<I", data, at + 4)[0]
            if length < 80 or at + 8 + length > size:
                error = "Eof"
        if waiting:
            yield (*waiting, False, False, None)
            waiting = None
        if error:
            if not permissive:
                raise FramingError(f"{error} at byte {at}")
            yield at, None, True, False, error
            return
        waiting = (at, data[at + 8 : at + 8 + length])
        at += 8 + length


def consecutive(names) -> list[tuple[int, str]]:
    """(number, name) from 0 until the first missing number."""
    numbered = {int(m[1]): n for n in names if (m := re.search(r"blk(\d{5})\.dat$", n))}
    out = []
    while len(out) in numbered:
        out.append((len(out), numbered[len(out)]))
    return out


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.permissive = options["path"], options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self):
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return [_File(n, os.path.join(self.folder, x)) for n, x in consecutive(names)] or [_File(-1, "")]

    def read(self, part):
        if part.number < 0:
            return
        with open(part.path, "rb") as f:
            data = f.read()
        for offset, raw, last, trailing, error in frames(data, self.permissive):
            yield part.number, offset, raw, last, trailing, error


class BlockFiles(DataSource):
    """Options: path, mode (FAILFAST or PERMISSIVE)."""

    @classmethod
    def name(cls):
        return "blk"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockFiles)


#: Bytes of payloads that one Arrow batch holds, about.
BATCH_BYTES = 16 << 20
FRAME_COLUMNS = ["file_no", "offset", "raw", "last_in_file", "trailing_bytes", "parse_error"]


def framed_batches(batches, number, permissive: bool, most: int | None = None):
    """Arrow batches of ``FRAMES`` rows from batches of (path, content), a few blocks at a time.

    number: path -> file number; most: bytes of a payload that are kept, all if None."""
    import pyarrow as pa

    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FRAME_COLUMNS)
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            rows, size = [], 0
            for frame in frames(content, permissive):
                raw = frame[1] and frame[1][:most]
                rows.append((number(path), frame[0], raw, *frame[2:]))
                size += len(raw or b"")
                if size >= BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)


def numbered_files(spark: SparkSession, folder: str):
    """(path, content of the files that are read; path -> file number, for executors)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "blk*.dat").load(folder)
    names = [r["path"] for r in files.select("path").collect()]  # one short row per file
    wanted = {name: n for n, name in consecutive(names)}
    chosen = files if len(wanted) == len(names) else files.where(F.col("path").isin(list(wanted)))
    return chosen.select("path", "content"), wanted.get


def read_blocks(spark: SparkSession, folder: str, mode: str = "FAILFAST", most: int | None = None) -> DataFrame:
    """The same rows through Spark's own file reader, for paths only Spark can open.

    most: bytes of a payload that are kept, all if None."""
    permissive = mode.upper() == "PERMISSIVE"
    files, number = numbered_files(spark, folder)

    def run(batches):
        yield from framed_batches(batches, number, permissive, most)

    return files.mapInArrow(run, FRAMES)


def write_blocks(blocks: DataFrame, folder: str, files: int | None = None) -> None:
    """Write rows (file_no, offset, raw) as block files: per file, framed payloads in the order of offsets.

    A file is one task's work, as in reading, and a task has some files where there
    are many; files: how many there are, counted if not given. ``folder`` is a path
    or URI that executors can write to. A file appears under its name when it is whole. Null
    payloads are zero padding of one byte."""
    uri = folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        now, out, name = None, None, None

        def close():
            if out is not None:
                out.close()
                fs.move(name + ".part", name)

        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                raw = payload.as_py()
                if number != now:
                    close()
                    now, name = number, f"{base}/{FILE_NAME % number}"
                    out = fs.open_output_stream(name + ".part")
                out.write(b"\0" if raw is None else MAGIC + struct.pack("<I", len(raw)) + raw)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["n"])

    if files is None:
        files = blocks.agg(F.countDistinct("file_no")).first()[0]
    n = max(1, min(files, 2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = blocks.select("file_no", "offset", "raw").repartition(n, "file_no").sortWithinPartitions("file_no", "offset")
    dealt.mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()


def le_int(col, start: int, size: int):
    """Unsigned little-endian integer of ``size`` bytes from byte ``start``, as long."""
    pairs = [F.substring(F.hex(F.substring(col, start + 1 + i, 1)), 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def headers(blocks: DataFrame) -> DataFrame:
    """Header fields of framed blocks, decoded in the JVM; unused ones are pruned."""
    from ledgerspark.functions.codec import dsha256

    raw = F.col("raw")
    version = le_int(raw, 0, 4)
    return blocks.where("parse_error IS NULL").select(
        "file_no", "offset", "last_in_file", "trailing_bytes",
        F.when(version >= 1 << 31, version - (1 << 32)).otherwise(version).cast("int").alias("version"),
        F.substring(raw, 5, 32).alias("prev_hash"), F.substring(raw, 37, 32).alias("merkle_root"),
        le_int(raw, 68, 4).alias("timestamp"), le_int(raw, 72, 4).alias("bits"), le_int(raw, 76, 4).alias("nonce"),
        dsha256(F.substring(raw, 1, 80)).alias("block_hash"), "raw",
    )
