"""Unspent-output resolution as joins.

``resolve``/``unspent`` are the fast forms for unique outpoints: one equality
join on (txid, vout). ``timeline`` is the exact form: creations and spends of an
outpoint in chain order, a spend matching the event before it if that is a
creation; it covers double spends, re-created outpoints and spends that come
before their output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(inputs: DataFrame, outputs: DataFrame, items: list[str]) -> DataFrame:
    """inputs with the items of the output that each spends; null where there is none."""
    made = outputs.select(F.col("txid").alias("prev_txid"), F.col("vout").cast("long").alias("prev_vout"), *items)
    return inputs.join(made, ["prev_txid", "prev_vout"], "left")


def unspent(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs that no input spends."""
    spent = inputs.select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"))
    return outputs.join(spent, ["txid", "vout"], "left_anti")


def events(inputs: DataFrame, outputs: DataFrame, items: list[str]) -> DataFrame:
    """One row per creation or spend: txid, vout, height, tx_idx, phase (0 spend, 1 creation), n, items."""
    made = outputs.select("txid", F.col("vout").cast("long").alias("vout"), "height", "tx_idx", F.lit(1).alias("phase"), F.col("vout").cast("long").alias("n"), F.lit(None).cast(dict(inputs.dtypes)["txid"]).alias("by"), *items)
    kinds = dict(outputs.dtypes)
    gone = inputs.select(F.col("prev_txid").alias("txid"), F.col("prev_vout").alias("vout"), "height", "tx_idx", F.lit(0).alias("phase"), F.col("vin").cast("long").alias("n"), F.col("txid").alias("by"), *[F.lit(None).cast(kinds[c]).alias(c) for c in items])
    return made.unionByName(gone)


def timeline(inputs: DataFrame, outputs: DataFrame, items: list[str]) -> tuple[DataFrame, DataFrame]:
    """(spends with matched and the matched items; creations still unspent at the end)."""
    order = Window.partitionBy("txid", "vout").orderBy("height", "tx_idx", "phase", "n")
    seen = events(inputs, outputs, items).withColumns({"_last": F.lag(F.struct("phase", *items)).over(order), "_next": F.lead("phase").over(order)})
    spends = seen.where("phase = 0").select("txid", "vout", "height", "tx_idx", "n", "by", (F.coalesce(F.col("_last.phase"), F.lit(0)) == 1).alias("matched"), *[F.when(F.col("_last.phase") == 1, F.col(f"_last.{c}")).alias(c) for c in items])
    return spends, seen.where("phase = 1 AND _next IS NULL").select("txid", "vout", "height", "tx_idx", *items)
