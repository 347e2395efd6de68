"""Merkle folds: per block, pairs of hashes are hashed until one is left; the last
of an odd row is paired with itself."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def root(leaves: list[bytes]) -> bytes | None:
    row = list(leaves)
    if not row:
        return None
    while len(row) > 1:
        row += row[-1:] * (len(row) % 2)
        row = [hashlib.sha256(hashlib.sha256(a + b).digest()).digest() for a, b in zip(row[::2], row[1::2], strict=True)]
    return row[0]


def roots(txs: DataFrame, leaf: str = "wtxid", by: str = "height") -> DataFrame:
    """by, root. A block's leaves (a few thousand at most) are one group."""
    leaves = txs.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("tx_idx", F.col(leaf).alias("h")))), lambda x: x.h).alias("leaves"))

    def fold(values):
        import pyarrow as pa

        return pa.array([None if v is None else root(v) for v in values.to_pylist()], pa.binary())

    import pyarrow as pa

    fold.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return leaves.select(by, F.arrow_udf(fold, "binary")("leaves").alias("root"))


def check(blocks: DataFrame, txs: DataFrame, profile: str = "reference") -> DataFrame:
    """height, root, merkle_root, ok. Leaves are whole-transaction hashes, or txids in ``standard``."""
    made = roots(txs, "txid" if profile == "standard" else "wtxid")
    return blocks.select("height", "merkle_root").join(made, "height", "left").withColumn("ok", F.col("root").eqNullSafe(F.col("merkle_root")))
