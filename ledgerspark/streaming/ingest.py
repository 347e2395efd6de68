"""Incremental ingest: block files that arrive in a folder, as a stream.

The file source tracks which files it has read; each is framed and parsed as in
batch. Heights come from the batch resolver once a run of files is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.sources import blk, transactions


def framed_stream(spark: SparkSession, folder: str, permissive: bool = True) -> DataFrame:
    """Streaming rows of framed blocks, as ``read_blocks`` has them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "blk*.dat").load(folder)

    def run(batches):
        yield from blk.framed_batches(batches, lambda path: int(path[-9:-4]), permissive)

    return files.select("path", "content").mapInArrow(run, blk.FRAMES)


def block_stream(spark: SparkSession, folder: str, permissive: bool = True) -> DataFrame:
    """Streaming headers of framed blocks: file, offset and header fields."""
    return blk.headers(framed_stream(spark, folder, permissive)).drop("raw")


def output_stream(spark: SparkSession, folder: str, permissive: bool = True) -> DataFrame:
    """Streaming outputs of all blocks that arrive, on the main chain or not, without height.

    Columns place (file number * 2^32 + offset), tx_idx, txid, vout, value, script, timestamp."""
    rows = blk.headers(framed_stream(spark, folder, permissive))
    # The parser carries heights; here a block is named by its place among the files.
    place = (F.col("file_no").cast("long") * (1 << 32) + F.col("offset")).alias("height")
    txs = transactions.transactions(rows.select(place, "timestamp", "raw"), permissive)
    return transactions.outputs(txs).withColumnRenamed("height", "place")
