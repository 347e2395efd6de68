"""A ledger derived from the order tables, so analyses can be checked by SQL.

Transactions are orders, outputs are order lines, and transaction k spends outputs
of transaction floor(k / 2) whose number has k's parity, so each outpoint is spent
at most once. Output scripts follow one of 16 templates. The same SQL text defines
the tables for Spark and for the oracle."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.shared import new_path
from ledgerspark.sources.blk import write_blocks

TX = """
SELECT o_orderkey AS txid, CAST(floor(o_orderkey / 50) AS BIGINT) AS height, CAST(o_orderkey % 50 AS INT) AS tx_idx,
       1231006505 + (CAST(floor(o_orderkey / 50) AS BIGINT) * 7919 % 300) * 1000000 AS timestamp
FROM orders"""
OUTS = """
SELECT l.l_orderkey AS txid,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS BIGINT) AS vout,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS value, l_partkey * 100000 + l_suppkey AS addr,
       CAST((l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 16 AS INT) AS template, t.height, t.tx_idx, t.timestamp
FROM lineitem l JOIN tx t ON l.l_orderkey = t.txid"""
INS = """
SELECT t.txid, t.height, t.tx_idx, o.txid AS prev_txid, o.vout AS prev_vout,
       CAST(row_number() OVER (PARTITION BY t.txid ORDER BY o.vout) - 1 AS BIGINT) AS vin
FROM tx t JOIN outs o ON o.txid = CAST(floor(t.txid / 2) AS BIGINT) AND o.vout % 2 = t.txid % 2 WHERE t.txid > 1"""
#: {h}: lower-case hex of SHA-256 of the address number.
SCRIPT = """
CASE template WHEN 0 THEN concat('76a914', substring({h}, 1, 40), '88ac') WHEN 1 THEN concat('a914', substring({h}, 1, 40), '87')
  WHEN 2 THEN concat('a914', substring({h}, 1, 40), '876161') WHEN 3 THEN concat('0014', substring({h}, 1, 40)) WHEN 4 THEN concat('0020', {h})
  WHEN 5 THEN concat('2102', {h}, 'ac') WHEN 6 THEN concat('6a20', {h}) WHEN 7 THEN concat('76a914', substring({h}, 1, 40), '88ac61')
  WHEN 8 THEN concat('512102', {h}, '2103', {h}, '52ae') WHEN 9 THEN concat('a820', {h}, '87') WHEN 10 THEN '' WHEN 11 THEN '51' WHEN 12 THEN '6a'
  WHEN 13 THEN concat('5120', {h}) WHEN 14 THEN concat('a614', substring({h}, 1, 40), '87') ELSE concat('4104', {h}, {h}, 'ac') END"""
SPARK_HASH = "sha2(CAST(addr AS STRING), 256)"
DUCK_HASH = "sha256(CAST(addr AS VARCHAR))"

#: What each template is, for the oracle.
KIND = """
CASE template WHEN 0 THEN 'PayToPubkeyHash' WHEN 1 THEN {p2sh23} WHEN 2 THEN CASE WHEN timestamp >= 1333238400 THEN 'PayToScriptHash' ELSE 'Unknown' END
  WHEN 3 THEN CASE WHEN timestamp >= 1503539857 THEN 'PayToWitnessPubkeyHash' ELSE 'Donation' END
  WHEN 4 THEN CASE WHEN timestamp >= 1503539857 THEN 'PayToWitnessScriptHash' ELSE 'Donation' END
  WHEN 5 THEN 'PayToPubkey' WHEN 6 THEN 'DataOutput' WHEN 7 THEN 'PayToPubkeyHash' WHEN 8 THEN 'PayToMultisig' WHEN 9 THEN 'Challenge'
  WHEN 10 THEN 'Donation' WHEN 11 THEN 'Donation' WHEN 12 THEN 'Invalid' WHEN 13 THEN 'Donation' WHEN 14 THEN 'Challenge' ELSE 'PayToPubkey' END"""
KIND_REFERENCE = KIND.format(p2sh23="'Challenge'")
KIND_STANDARD = KIND.format(p2sh23="CASE WHEN timestamp >= 1333238400 THEN 'PayToScriptHash' ELSE 'Challenge' END")

ORACLE_WITH = f"WITH RECURSIVE tx AS ({TX}), outs AS ({OUTS}), ins AS ({INS})"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """tx, outs (with script binary) and ins."""
    orders, lineitem = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem"))
    tx = spark.sql(TX.replace("FROM orders", "FROM {orders}"), orders=orders)
    outs = spark.sql(OUTS.replace("FROM lineitem l JOIN tx t", "FROM {lineitem} l JOIN {tx} t"), lineitem=lineitem, tx=tx)
    ins = spark.sql(INS.replace("FROM tx t JOIN outs o", "FROM {tx} t JOIN {outs} o"), tx=tx, outs=outs)
    # Scripts are made above the window: what is shuffled is small, and outs and ins share it.
    return {"tx": tx, "outs": outs.withColumn("script", F.expr(f"unhex({SCRIPT.format(h=SPARK_HASH)})")), "ins": ins}



# Block files of the ledger: the same transactions as raw bytes. Every input's script
# and sequence are fixed, every transaction begins with a coinbase-like input (which
# spends nothing), every third has witnesses. An input names the SHA-256 of the number
# of the transaction it spends from.
COINBASE = "00" * 32 + "ffffffff" + "0151" + "ffffffff"
WITNESS = "0203aabbcc00"


def le_hex(value: str, size: int) -> str:
    """DuckDB's SQL of ``size`` little-endian bytes of a number, as hex."""
    return f"array_to_string(list_reverse(regexp_extract_all(lpad(lower(to_hex({value})), {2 * size}, '0'), '..')), '')"


def le_bytes(value: str, size: int) -> str:
    """Spark's SQL of the same as binary, by shifts."""
    v = f"CAST({value} AS BIGINT)"
    turned = " | ".join(f"(({v} >> {8 * i}) & 255) << {8 * (size - 1 - i)}" for i in range(size))
    return f"unhex(lpad(hex({turned if size > 1 else v}), {2 * size}, '0'))"


def raw_sql() -> dict[str, str]:
    """DuckDB's SQL of hex: of an input, an output, a whole transaction and without its witness, a block's header."""
    le = le_hex
    number = lambda v: f"sha256(CAST({v} AS VARCHAR))"
    cut = f"concat(ins_hex, {le('n_out', 1)}, outs_hex)"
    many = f"concat({le('n_in', 1)}, {cut})"
    header = f"concat('01000000', prev, {number('height + 1000000')}, {le('1231006505 + height * 600', 4)}, 'ffff001d', {le('height', 4)})"
    return {
        "input": f"concat({number('prev_txid')}, {le('prev_vout', 4)}, '0151', 'ffffffff')",
        "output": f"concat({le('value', 8)}, {le('octet_length(script)', 1)}, lower(hex(script)))",
        "core": f"concat('01000000', {many}, '00000000')",
        "whole": f"CASE WHEN txid % 3 = 0 THEN concat('01000000', '0001', {many}, repeat('{WITNESS}', CAST(n_in AS INT)), '00000000') ELSE concat('01000000', {many}, '00000000') END",
        "header": header,
    }


DUCK_RAW = raw_sql()
#: outs with scripts, raw transactions and the header chain, for the oracle.
RAW_WITH = f"""{ORACLE_WITH}, scripted AS (SELECT *, unhex({SCRIPT.format(h=DUCK_HASH)}) AS script FROM outs),
 in_parts AS (SELECT txid, string_agg({DUCK_RAW['input']}, '' ORDER BY vin) AS h, count(*) AS n FROM ins GROUP BY txid),
 out_parts AS (SELECT txid, string_agg({DUCK_RAW['output']}, '' ORDER BY vout) AS h, count(*) AS n FROM scripted GROUP BY txid),
 parts AS (SELECT t.*, concat('{COINBASE}', coalesce(i.h, '')) AS ins_hex, 1 + coalesce(i.n, 0) AS n_in, coalesce(o.h, '') AS outs_hex, coalesce(o.n, 0) AS n_out
   FROM tx t LEFT JOIN in_parts i ON t.txid = i.txid LEFT JOIN out_parts o ON t.txid = o.txid),
 raws AS (SELECT *, sha256(unhex(sha256(unhex({DUCK_RAW['core']})))) AS id, sha256(unhex(sha256(unhex({DUCK_RAW['whole']})))) AS wid FROM parts),
 heads(height, prev, hash) AS (
   SELECT h, p, sha256(unhex(sha256(unhex(header)))) FROM (SELECT height AS h, prev AS p, {DUCK_RAW['header']} AS header FROM (SELECT CAST(0 AS BIGINT) AS height, repeat('00', 32) AS prev))
   UNION ALL SELECT h, p, sha256(unhex(sha256(unhex(header)))) FROM (SELECT height AS h, prev AS p, {DUCK_RAW['header']} AS header FROM (SELECT height + 1 AS height, hash AS prev FROM heads WHERE height < (SELECT max(height) FROM tx)))),
 main AS (SELECT * FROM heads WHERE height < (SELECT max(height) FROM tx))"""


def header_columns(n: int) -> tuple[list[int], list[bytes]]:
    """(heights, headers) of n blocks, each on the one before; a few dozen bytes a block."""
    out, prev, sha = [], bytes(32), hashlib.sha256
    times, nonce = struct.Struct("<I4sI").pack, bytes.fromhex("ffff001d")
    for height in range(n):
        header = b"\1\0\0\0" + prev + sha(str(height + 1000000).encode()).digest() + times(1231006505 + height * 600, nonce, height)
        out.append(header)
        prev = sha(sha(header).digest()).digest()
    return list(range(n)), out


def raw_blocks(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    """file_no, offset, raw: the ledger's blocks, 100 heights a file.

    Of each ten blocks the third and fourth change places, and the sixth comes after
    a sibling without children."""
    import pyarrow as pa

    joined = lambda df, key, of, name: df.groupBy("txid").agg(F.expr(f"listagg({of}) WITHIN GROUP (ORDER BY {key})").alias(f"{name}_raw"), F.count("*").alias(f"n_{name}"))
    ins = joined(t["ins"], "vin", f"concat(unhex(sha2(CAST(prev_txid AS STRING), 256)), {le_bytes('prev_vout', 4)}, X'0151ffffffff')", "ins")
    outs = joined(t["outs"], "vout", f"concat({le_bytes('value', 8)}, {le_bytes('octet_length(script)', 1)}, script)", "outs")
    parts = t["tx"].join(ins, "txid", "left").join(outs, "txid", "left").selectExpr("txid", "height", "tx_idx", "1 + coalesce(n_ins, 0) AS n_in", "coalesce(ins_raw, X'') AS ins_raw", "coalesce(n_outs, 0) AS n_out", "coalesce(outs_raw, X'') AS outs_raw")
    many = f"{le_bytes('n_in', 1)}, X'{COINBASE}', ins_raw, {le_bytes('n_out', 1)}, outs_raw"
    whole = f"concat(X'01000000', IF(txid % 3 = 0, X'0001', X''), {many}, IF(txid % 3 = 0, unhex(repeat('{WITNESS}', CAST(n_in AS INT))), X''), X'00000000')"
    # A block has fifty transactions at most.
    bodies = parts.selectExpr("height", "tx_idx", f"{whole} AS x").groupBy("height").agg(F.expr("listagg(x) WITHIN GROUP (ORDER BY tx_idx)").alias("x"), F.count("*").alias("n")).selectExpr("height", f"concat({le_bytes('n', 1)}, x) AS body")
    n = t["tx"].agg(F.max("height")).first()[0] + 1
    heights, headers = header_columns(n)
    heads = spark.createDataFrame(pa.table({"height": pa.array(heights, pa.int64()), "header": pa.array(headers, pa.binary())}))
    file_no = F.floor(F.col("height") / 100).cast("int").alias("file_no")
    place = F.when(F.col("height") % 10 == 2, F.col("height") + 1).when(F.col("height") % 10 == 3, F.col("height") - 1).otherwise(F.col("height")) * 3
    # A task's share of the headers is looked up beside its blocks; neither side is sorted.
    main = bodies.join(heads.hint("shuffle_hash"), "height").select(file_no, place.alias("offset"), F.concat("header", "body").alias("raw"))
    known = t["tx"].select("height").distinct()
    sibling = F.expr(f"concat(substring(header, 1, 76), {le_bytes('height + 5000000', 4)}, X'010100000001{COINBASE}0000000000')")
    side = known.where("height % 10 = 5").join(heads, "height").select(file_no, (place - 1).alias("offset"), sibling.alias("raw"))
    zero = known.where("height % 10 = 7").select(file_no, (place - 1).alias("offset"), F.lit(None).cast("binary").alias("raw"))
    return main.unionByName(side).unionByName(zero)


def block_files(spark: SparkSession, t: dict[str, DataFrame]) -> str:
    """Folder with the ledger's block files, written to the shared folder."""
    folder = new_path(spark, "blk")
    files = t["tx"].agg(F.countDistinct(F.floor(F.col("height") / 100))).first()[0]
    write_blocks(raw_blocks(spark, t), folder, files)
    return folder
