"""Token-ID output: Parquet list columns that allow selective reads.

File format: one Parquet table, rows in ascending ``doc_id`` order (null first;
equal ids by text hash), columns ``doc_id long, shard int, shard_start long,
n_tokens int, ids list<int>``. ``ids`` is dictionary-encoded (a vocabulary of
tens of thousands fits one dictionary page, so ids cost their bit width at most,
less after zstd); the integer metadata columns are delta-encoded. Row groups and
pages have set sizes, and column and offset indexes are written, so a reader of
a ``doc_id`` range or of metadata alone skips the token pages of all others.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import new_path, partitions, released, small_arrow_batches
from ledgerspark.llm.encode import encoder, portions

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000
FILE_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"


def parquet_options() -> dict[str, str]:
    """Writer settings of the format: encodings, row groups, pages and indexes."""
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.page.write-checksum.enabled": "true",
        "parquet.enable.dictionary": "true",
    }
    return options | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "shard_start", "n_tokens")}


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every whole text of ``docs`` and write the token files to ``path``.

    A null or empty text has the end id alone. Rows with equal ``doc_id`` are
    all written, ordered by the hash of their texts. Columns other than
    ``doc_id`` and ``text`` are not carried. An empty table gives empty files."""
    small_arrow_batches(docs.sparkSession)

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, at = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in portions(texts):
                got = enc.encode(texts[a:b])
                n = np.fromiter(map(len, got), np.int64, b - a) + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                last = np.array([end_id], "<u4")
                flat = pa.array(np.concatenate([x for ids in got for x in (ids, last)]).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).cast(pa.int64()),
                        pa.array(np.full(b - a, shard, np.int32)),
                        pa.array(at + ends[:-1]),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat),
                    ],
                    ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                at += int(ends[-1])
        released(vocabulary)

    # Rows of one id are parted by text hash and place too, so no id makes a task grow.
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("rid"))
    keys = ["doc_id", "h", "rid"]
    ordered = narrow.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").mapInArrow(encode, FILE_SCHEMA).write.options(**parquet_options()).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files as a DataFrame; filters and columns reach the scan."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in file order. A shard
    is one file, so the table of shard offsets has as many rows as files."""

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
            )

    files = read_tokens(spark, path)
    rows = files.select("doc_id", "shard", "shard_start", "ids").mapInArrow(digest, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    sizes = files.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    offsets = spark.sql("SELECT shard, sum(n) OVER (ORDER BY shard) - n AS shard_offset FROM {sizes}", sizes=sizes)
    joined = rows.join(F.broadcast(offsets), "shard")  # one row for each file
    return joined.select("doc_id", (F.col("shard_offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_file_query(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents in the format, read the files back, return their digest."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_tokens(docs, path, vocabulary, end_id)
    return token_digest(spark, path)
