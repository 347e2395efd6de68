"""The analyses, as plans over normalized tables.

Tables have the columns of ``sources``: txs, inputs(height, tx_idx, txid, vin,
prev_txid, prev_vout), outputs(height, tx_idx, txid, vout, value, script,
timestamp). Grouping and joins use compact address keys; address text is made in
the last projection only. ``Analysis`` is the general form: what an output is
worth keeping as, what happens where it is spent, and how all that is finished."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.codec import address, coin_text, hash160, hash_pretty, lossy_text
from ledgerspark.functions.script import ADDRESS_KINDS, with_class
from ledgerspark.operators import utxo
from ledgerspark.operators.cluster import components
from ledgerspark.shared import parts, stored


@dataclass
class Analysis:
    """item: columns kept of an output (``where`` prunes before the join);
    on_spend: spends with items -> rows; finish: (rows, unspent items) -> result."""

    item: dict[str, Column]
    where: Column
    on_spend: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame, DataFrame], DataFrame]
    exact: bool = True


def run(analysis: Analysis, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    items = list(analysis.item)
    kept = outputs.withColumns(analysis.item)
    if analysis.exact:
        # All creations take part, so one without an item hides an earlier one; those carry no item.
        kept = kept.withColumn("_keep", F.coalesce(analysis.where, F.lit(False)))
        kept = kept.withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in items})
        spends, left = utxo.timeline(real_inputs(inputs), kept, ["_keep", *items])
        return analysis.finish(analysis.on_spend(spends.where("matched AND _keep").drop("matched", "_keep")), left.where("_keep").drop("_keep"))
    kept = kept.where(analysis.where)
    joined = utxo.resolve(real_inputs(inputs), kept.withColumn("_keep", F.lit(True)), ["_keep", *items])
    return analysis.finish(analysis.on_spend(joined.where("_keep").drop("_keep").withColumnRenamed("txid", "by")), utxo.unspent(kept, inputs))


def real_inputs(inputs: DataFrame) -> DataFrame:
    """Without coinbase inputs: those whose previous hash is all zeros."""
    if dict(inputs.dtypes)["prev_txid"] == "binary":
        return inputs.where(F.col("prev_txid") != F.lit(bytes(32)))
    return inputs.where("prev_txid <> 0")


def address_key(kind: str, c: str = "c", hashed: bool = True) -> Column:
    """Version byte and hash of a classified output; null where the analysis has no address.

    With ``hashed=False`` a public key stands for its hash."""
    of = F.col(c)
    payload = of["payload"]
    cases = []
    for name, version in ADDRESS_KINDS[kind].items():
        if name == "PayToMultisig":
            continue
        body = hash160(F.when(of["kind"] == name, payload)) if hashed and name == "PayToPubkey" else payload
        cases.append(F.when(of["kind"] == name, F.concat(F.lit(bytes([version])), body)))
    return F.coalesce(*cases)


def cluster_edges(per_tx: DataFrame, by: str = "by", key: str = "key") -> DataFrame:
    """Star edges (a, b) of the distinct keys each transaction spends from, two or more."""
    least = F.min(key).over(Window.partitionBy(by))
    return per_tx.where(F.col(by).isNotNull()).select(least.alias("a"), F.col(key).alias("b")).where("a <> b").distinct()


def input_keys(inputs: DataFrame, outputs: DataFrame, profile: str = "reference") -> DataFrame:
    """by, key: the address keys that each transaction's inputs spend from."""
    a = Analysis({"key": address_key("clusters")}, F.col("key").isNotNull(), lambda s: s.select("by", "key"), lambda s, _: s)
    return run(a, inputs, with_class(outputs, profile))


def input_key_sets(inputs: DataFrame, outputs: DataFrame, profile: str = "reference") -> DataFrame:
    """by, n_keys, first_key of transactions that spend from two or more keys."""
    sets = input_keys(inputs, outputs, profile).groupBy("by").agg(F.countDistinct("key").alias("n_keys"), F.min("key").alias("first_key"))
    return sets.where("n_keys > 1")


def cluster_keys(inputs: DataFrame, outputs: DataFrame, profile: str = "reference") -> DataFrame:
    """node, component: address keys that were spent together, by their smallest key."""
    return components(cluster_edges(input_keys(inputs, outputs, profile)))


def clusters(inputs: DataFrame, outputs: DataFrame, profile: str = "reference") -> DataFrame:
    """address, cluster: ``cluster_keys`` as texts."""
    return cluster_keys(inputs, outputs, profile).select(address(F.col("node")).alias("address"), address(F.col("component")).alias("cluster"))


def cluster_tags(found: DataFrame) -> DataFrame:
    """address, tag of ``cluster_keys`` rows: clusters numbered from 0 by their smallest key.

    Numbers go by counts of ranges first, so no task holds all clusters."""
    names = found.select("component").distinct()
    ranged = stored(names.repartitionByRange(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component").select("component", F.spark_partition_id().alias("p")), "cluster-names")
    before = found.sparkSession.sql("SELECT p, sum(n) OVER (ORDER BY p) - n AS before FROM (SELECT p, count(*) AS n FROM {t} GROUP BY p)", t=ranged)  # one row a partition
    nr = F.row_number().over(Window.partitionBy("p").orderBy("component"))
    tags = ranged.withColumn("nr", nr).join(F.broadcast(before), "p").select("component", (F.col("before") + F.col("nr") - 1).alias("tag"))
    return found.join(tags, "component").select(address(F.col("node")).alias("address"), "tag")


def largest_clusters(found: DataFrame, k: int = 10) -> DataFrame:
    """cluster, n_addresses of the k largest clusters of ``cluster_keys`` rows; ties by key."""
    return found.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n_addresses")).orderBy(F.desc("n_addresses"), "cluster").limit(k)


def balance_sums(inputs: DataFrame, outputs: DataFrame, profile: str = "reference", hashed: bool = True) -> DataFrame:
    """key, sum of address keys whose balance is not 0."""
    rows = with_class(outputs, profile).withColumn("key", address_key("balances", hashed=hashed))
    a = Analysis({"key": F.col("key"), "worth": F.col("value")}, F.col("key").isNotNull(), lambda s: s, lambda _, left: left.groupBy("key").agg(F.sum("worth").alias("sum")).where("sum <> 0"))
    return run(a, inputs, rows)


def richest(sums: DataFrame, k: int = 10) -> DataFrame:
    """key, balance (text) of the k largest of ``balance_sums`` rows; ties by key."""
    return sums.orderBy(F.desc("sum"), "key").limit(k).select("key", coin_text(F.col("sum")).alias("balance"))


def balances(inputs: DataFrame, outputs: DataFrame, profile: str = "reference") -> DataFrame:
    """balance (text, 8 places), hash160, address of keys whose balance is not 0."""
    sums = balance_sums(inputs, outputs, profile)
    witness = F.substring("key", 1, 1) == F.lit(b"\xf0")
    h = F.when(witness, F.lit("0" * 40)).otherwise(F.lower(F.hex(F.substring("key", 2, 20))))
    return sums.select(coin_text(F.col("sum")).alias("balance"), h.alias("hash160"), address(F.col("key")).alias("address"))


def output_addresses(outputs: DataFrame, profile: str = "reference") -> DataFrame:
    """height, tx_idx, vout, pos, version, payload, is_key: every address of every output, in one pass.

    is_key tells that the payload is a public key, whose hash the address has."""
    c = F.col("c")
    versions = ADDRESS_KINDS["addresses"]
    version = F.coalesce(*[F.when(c["kind"] == k, F.lit(v)) for k, v in versions.items()])
    one = F.array(F.struct(F.lit(0).alias("pos"), c["payload"].alias("payload")))
    many = F.transform(c["pushes"], lambda x, i: F.struct(i.alias("pos"), x.alias("payload")))
    rows = with_class(outputs, profile).where(c["kind"].isin(*versions))
    multi = c["kind"] == "PayToMultisig"
    rows = rows.select("height", "tx_idx", "vout", version.alias("version"), multi.alias("is_key"), F.explode(F.when(multi, many).otherwise(one)).alias("a"))
    return rows.select("height", "tx_idx", "vout", "a.pos", "version", "a.payload", "is_key")


def addresses(outputs: DataFrame, profile: str = "reference") -> DataFrame:
    """height, tx_idx, vout, pos, address: every address of every output, in chain order.

    Outputs are put in order before their addresses are made, which each keep their
    place: sampling for the order would make all of them once more."""
    found = output_addresses(outputs.select("height", "tx_idx", "vout", "script", "timestamp").orderBy("height", "tx_idx", "vout"), profile)
    body = F.coalesce(hash160(F.when(F.col("is_key"), F.col("payload"))), F.col("payload"))
    version = F.unhex(F.lpad(F.hex("version"), 2, "0"))
    return found.select("height", "tx_idx", "vout", "pos", address(F.concat(version, body)).alias("address"))


def tx_hash_lines(txs: DataFrame, above: int = 480000, each: int = 1000) -> DataFrame:
    """height, ord, line: a line per chosen block, then one per transaction of it."""
    some = txs.where((F.col("height") > above) & (F.col("height") % each == 0))
    block = some.groupBy("height").agg(F.count("*").alias("n")).select("height", F.lit(-1).alias("ord"), F.format_string("Block %d - %d transactions", "height", "n").alias("line"))
    tx = some.select("height", F.col("tx_idx").alias("ord"), F.concat(F.lit("Transaction "), hash_pretty(F.col("txid"))).alias("line"))
    return block.unionByName(tx).orderBy("height", "ord")


def data_payloads(inputs: DataFrame, outputs: DataFrame, include_spent: bool = False) -> DataFrame:
    """txid, vout, data embedded in outputs still unspent (or in all)."""
    rows = with_class(outputs).withColumn("data", F.when(F.col("c.kind") == "DataOutput", F.col("c.payload")))
    if include_spent:
        return rows.where("data IS NOT NULL").select("txid", "vout", "data")
    return run(Analysis({"data": F.col("data")}, F.col("data").isNotNull(), lambda s: s, lambda _, left: left.select("txid", "vout", "data")), inputs, rows)


def data_outputs(inputs: DataFrame, outputs: DataFrame, include_spent: bool = False) -> DataFrame:
    """txid, vout, text of embedded data still unspent (or all)."""
    return data_payloads(inputs, outputs, include_spent).select("txid", "vout", lossy_text(F.col("data")).alias("text"))


def donations(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """txid, vout, value of unspent outputs with a value that anyone may spend, or unknown ones."""
    where = F.col("c.kind").isin("Donation", "Unknown") & (F.col("value") > 0)
    return run(Analysis({"worth": F.col("value")}, where, lambda s: s, lambda _, left: left.select("txid", "vout", F.col("worth").alias("value"))), inputs, with_class(outputs))


def live_keys(inputs: DataFrame, outputs: DataFrame, key: str = "addr") -> DataFrame:
    """One row: n_keys, keys held at the end: with a balance, or last seen credited."""
    items = outputs.withColumn("_k", F.col(key))
    n = parts(inputs, outputs)
    seen = utxo.events(inputs, items, ["_k", "value"]).select("txid", "vout", "height", "tx_idx", "phase", "n", "_k", "value").repartition(n, "txid", "vout")
    # A spend's key and value are those of the output it spends.
    same = Window.partitionBy("txid", "vout")
    moves = seen.select("height", "tx_idx", "phase", "n", F.max("_k").over(same).alias("k"), F.max("value").over(same).alias("v"))
    moves = moves.withColumn("delta", F.when(F.col("phase") == 1, F.col("v")).otherwise(-F.col("v"))).repartition(n, "k")
    ends = moves.groupBy("k").agg(F.sum("delta").alias("sum"), F.max_by("phase", F.struct("height", "tx_idx", "phase", "n")).alias("last"))
    return ends.agg(F.count_if((F.col("sum") != 0) | (F.col("last") == 1)).alias("n_keys"))
