"""From a folder of block files to normalized tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.operators.chain import resolve
from ledgerspark.shared import stored
from ledgerspark.sources import blk, transactions

log = logging.getLogger("ledgerspark")
#: Blocks whose place and height, two numbers each, may be broadcast: 100 MB or so.
MOST_BROADCAST = 2_000_000


def load(spark: SparkSession, folder: str, profile: str = "reference", mode: str = "FAILFAST") -> dict[str, DataFrame]:
    """blocks, txs, inputs, outputs of the main chain.

    Headers are read, without payloads, and resolved first. Payloads are read once
    more and parsed where they are framed: parsed transactions are written to the
    shared folder, and all tables read that. They meet their heights by broadcast, so
    nothing large is shuffled, unless there are too many blocks for that."""
    permissive = mode.upper() == "PERMISSIVE"
    headers = stored(blk.headers(blk.read_blocks(spark, folder, mode, most=80)).drop("raw"), "headers")
    main = stored(resolve(headers, profile), "main-chain")
    report(headers, main)
    # Of blocks that are in the files twice, the first copy counts.
    others = [c for c in headers.columns if c not in ("file_no", "offset", "block_hash")]
    first = headers.groupBy("block_hash").agg(F.min(F.struct("file_no", "offset", *others)).alias("at")).select("block_hash", "at.*")
    blocks = stored(first.join(main, "block_hash"), "main-blocks")
    places = blocks.select(transactions.place(F.col("file_no").cast("long"), F.col("offset")).alias("place"), "height")
    found = transactions.read_transactions(spark, folder, mode).join(F.broadcast(places) if main.count() <= MOST_BROADCAST else places, "place").drop("place")
    if not permissive:
        found = found.withColumn("parse_error", F.when(F.col("parse_error").isNotNull(), F.raise_error(F.concat(F.lit("a block can't be parsed: "), "parse_error")).cast("string")))
    txs = stored(found, "transactions")
    count = txs.groupBy("height").agg(F.first("n_tx").alias("n_tx"))
    return {
        "blocks": blocks.join(count, "height", "left"),
        "txs": txs,
        "inputs": transactions.inputs(txs),
        "outputs": transactions.outputs(txs),
    }


def report(headers: DataFrame, main: DataFrame) -> None:
    """Log a line for each file, and at debug level one for each block of the main chain."""
    if log.isEnabledFor(logging.INFO):
        files = headers.join(main, "block_hash", "left").groupBy("file_no").agg(F.count("*").alias("n"), F.count("height").alias("walked"))
        for r in files.orderBy("file_no").toLocalIterator():
            log.info("%s: %d blocks, %d on the main chain", blk.FILE_NAME % r["file_no"], r["n"], r["walked"])
    if log.isEnabledFor(logging.DEBUG):
        for r in main.orderBy("height").toLocalIterator():
            log.debug("block %d %s", r["height"], bytes(r["block_hash"])[::-1].hex())
