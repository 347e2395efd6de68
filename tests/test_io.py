"""Sinks, command line, streams, error modes, and transactions with witnesses."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from ledgerspark import cli
from ledgerspark.functions import codec
from ledgerspark.operators.merkle import check
from ledgerspark.plans import analyses
from ledgerspark.plans.chain_tables import load
from ledgerspark.plans.ledger import raw_blocks, tables
from ledgerspark.sources import blk, sinks
from ledgerspark.sources.transactions import Cursor, ParseError, parse_block, parse_transaction
from ledgerspark.streaming import ingest
from tests.test_chain import TX, block, framed, tx

PAY = [bytes.fromhex("76a914") + bytes([c]) * 20 + bytes.fromhex("88ac") for c in range(6)]


@pytest.fixture
def folder(tmp_path):
    """Two clusters of addresses, data, a donation; the last block is the tip."""
    coin, coin_id = tx([(bytes(32), 0xFFFFFFFF)], [(50, PAY[1]), (30, PAY[2]), (20, PAY[3]), (10, PAY[4]), (7, b"\x6a\x02hi"), (5, b"\x51")])
    spend, spend_id = tx([(coin_id, 0), (coin_id, 1)], [(80, PAY[5])])
    other, _ = tx([(coin_id, 2), (coin_id, 3), (spend_id, 0)], [(9, PAY[0])])
    raws, prev = [], bytes(32)
    for n, txs in enumerate([[coin], [spend], [other], [tx([(bytes(32), 1)], [(9, PAY[4])])[0]]]):
        raw, prev = block(prev, txs, n)
        raws.append(raw)
    blocks = tmp_path / "blocks"
    blocks.mkdir()
    (blocks / "blk00000.dat").write_bytes(b"".join(map(framed, raws[:2])))
    (blocks / "blk00001.dat").write_bytes(b"".join(map(framed, raws[2:])))
    return blocks


def test_witness_transaction():
    body = TX[4:-4]
    items = [b"\xaa" * 3, b"", b"\xbb" * 300]
    stack = bytes([3, 3]) + items[0] + b"\0" + b"\xfd" + struct.pack("<H", 300) + items[2]
    raw = TX[:4] + b"\0\1" + body + stack + TX[-4:]
    t = parse_transaction(Cursor(raw))
    double = lambda x: hashlib.sha256(hashlib.sha256(x).digest()).digest()
    assert t["txid"] == double(TX) and t["wtxid"] == double(raw) and t["lock_time"] == 0
    for cut in (raw[:5], raw[:-3], TX[:40]):
        with pytest.raises(ParseError):
            parse_transaction(Cursor(cut))


def test_block_payload_is_used_up():
    raw = bytes(80) + b"\1" + TX
    assert parse_block(raw)[0] == 1
    with pytest.raises(ParseError, match="Trailing"):
        parse_block(raw + b"\0")


def test_cursor_numbers():
    c = Cursor(b"\xfc\xfd\x01\x02\xfe\x01\0\0\0\xff\x02\0\0\0\0\0\0\0")
    assert [c.varint() for _ in range(4)] == [0xFC, 0x201, 1, 2]
    with pytest.raises(ParseError):
        c.number(1)


def test_text_of_hashes(spark):
    row = spark.createDataFrame([(bytes(range(20)),)], "h binary").select(codec.hash160_pretty(F.col("h")).alias("p"), "h")
    got = row.select("p", codec.hash160_from_pretty(F.col("p")).alias("back")).first()
    assert got["p"] == bytes(range(20)).hex() and bytes(got["back"]) == bytes(range(20))[::-1]


def test_permissive_modes(spark, folder):
    with open(folder / "blk00001.dat", "ab") as f:
        f.write(b"garbage!")
    with pytest.raises(Exception, match="Invalid"):
        blk.read_blocks(spark, str(folder)).collect()
    rows = blk.read_blocks(spark, str(folder), "PERMISSIVE").collect()
    assert sorted(r["parse_error"] or "" for r in rows) == ["", "", "", "", "Invalid"]
    t = load(spark, str(folder), mode="PERMISSIVE")
    assert t["blocks"].count() == 3 and t["txs"].where("parse_error IS NOT NULL").count() == 0


def test_unreadable_transactions(spark, folder):
    raw, _ = block(bytes(32), [TX], 0)
    (folder / "blk00000.dat").write_bytes(framed(raw + b"\0"))
    (folder / "blk00001.dat").unlink()
    with pytest.raises(Exception, match="Trailing"):
        load(spark, str(folder), "standard")
    t = load(spark, str(folder), "standard", "PERMISSIVE")
    assert [r["parse_error"] for r in t["txs"].collect()] == ["Trailing"] and t["outputs"].count() == 0


def test_a_block_twice_counts_once(spark, folder):
    data = (folder / "blk00000.dat").read_bytes()
    (folder / "blk00002.dat").write_bytes(data)
    t = load(spark, str(folder), "standard")
    assert t["blocks"].count() == 4 and t["txs"].count() == 4


def test_write_and_read_blocks(spark, tmp_path):
    rows = [(0, 5, b"b" * 90), (0, 2, b"a" * 80), (0, 3, None), (1, 0, b"c" * 100)]
    blk.write_blocks(spark.createDataFrame(rows, "file_no int, offset long, raw binary"), str(tmp_path / "out"))
    got = blk.read_blocks(spark, str(tmp_path / "out")).orderBy("file_no", "offset").collect()
    assert [bytes(r["raw"]) for r in got] == [b"a" * 80, b"b" * 90, b"c" * 100]


def test_command_line(spark, folder, tmp_path, capsys):
    out = tmp_path / "clusters.csv"
    cli.main(["-b", str(folder), "-o", str(out)])
    lines = out.read_text().splitlines()
    of = {a: int(tag) for a, tag in (x.split(",") for x in lines)}
    assert len(of) == 5 and sorted(of.values()) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])
    assert [int(x.split(",")[1]) for x in lines] == sorted(of.values())
    cli.main(["-b", str(folder), "-o", "-", "--analysis", "addresses"])
    printed = capsys.readouterr().out.splitlines()
    key = lambda c: codec.base58check_text(b"\0" + bytes([c]) * 20)
    assert printed == [key(c) for c in (1, 2, 3, 4, 5, 0)]
    for name, want in (("balances", ["0.00000009"]), ("data-outputs", ["hi"]), ("donations", ["5", "5"]), ("merkle", ["true"] * 3), ("largest-clusters", ["3", "2"]), ("richest", ["0.00000009"])):
        cli.main(["-b", str(folder), "-o", "-", "--analysis", name])
        printed = capsys.readouterr().out.splitlines()
        assert sorted(x for line in printed for x in line.split(",") if x in want) == sorted(want), name


def test_sink_order(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "500 - id AS back").repartition(5)
    sinks.write_lines(df, str(tmp_path / "x.csv"), "id", "back", order=["id"], one_file=True)
    assert (tmp_path / "x.csv").read_text().splitlines() == [f"{i},{500 - i}" for i in range(500)]
    sinks.write_lines(df, str(tmp_path / "folder"))
    assert spark.read.text(str(tmp_path / "folder")).count() == 500


def test_progress_lines(spark, folder, caplog):
    with caplog.at_level("DEBUG", logger="ledgerspark"):
        load(spark, str(folder))
    said = [r.getMessage() for r in caplog.records]
    assert "blk00000.dat: 2 blocks, 2 on the main chain" in said and "blk00001.dat: 2 blocks, 1 on the main chain" in said
    assert sum(x.startswith("block ") for x in said) == 3


def test_streams(spark, folder, tmp_path):
    def drained(stream, name):
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start(str(tmp_path / name))
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / name))

    assert drained(ingest.block_stream(spark, str(folder)), "headers").count() == 4
    outs = drained(ingest.output_stream(spark, str(folder)), "outs")
    assert outs.count() == 9
    # Files that come later are read alone.
    raw, _ = block(bytes(32), [TX], 7)
    (folder / "blk00002.dat").write_bytes(framed(raw))
    assert drained(ingest.block_stream(spark, str(folder)), "headers").count() == 5


def test_recreated_outputs(spark):
    """A later creation of an outpoint counts, whatever became of the first."""
    schema = "txid binary, vout long, height long, tx_idx int, value long, script binary, timestamp long"
    one, two = b"\1" * 32, b"\2" * 32
    outs = spark.createDataFrame([(one, 0, 0, 0, 4, b"\x51", 0), (one, 0, 2, 0, 6, b"\x51", 0), (two, 0, 0, 1, 9, b"\x6a\x02hi", 0), (two, 0, 3, 0, 9, b"\x51", 0)], schema)
    ins = spark.createDataFrame([(b"\3" * 32, 1, 0, one, 0, 0)], "txid binary, height long, tx_idx int, prev_txid binary, prev_vout long, vin long")
    assert sorted(r["value"] for r in analyses.donations(ins, outs).collect()) == [6, 9]
    # Data that a later creation hides is gone.
    assert analyses.data_outputs(ins, outs).count() == 0


def test_merkle_mismatch(spark, folder):
    t = load(spark, str(folder))
    wrong = t["blocks"].withColumn("merkle_root", F.when(F.col("height") == 1, F.lit(bytes(32))).otherwise(F.col("merkle_root")))
    assert {r["height"]: r["ok"] for r in check(wrong, t["txs"]).collect()} == {0: True, 1: False, 2: True}


def test_one_scan_of_outputs(spark):
    """Dumping addresses reads the outputs once and shuffles no scripts for their class."""
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    found = analyses.output_addresses(tables(spark, sf)["outs"])
    assert raw_blocks(spark, tables(spark, sf)).count() > 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The derived outputs join order lines with orders.
    assert plan.count("FileScan parquet") == 2 and plan.count("ArrowEvalPython") == 1
