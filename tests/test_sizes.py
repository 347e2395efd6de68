"""What only shows in larger tables: wide numbers, many rows at once, bounded batches."""

import os
import random
import re
import time
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerspark import shared
from ledgerspark.functions import codec, opcodes, script
from ledgerspark.operators import cluster
from ledgerspark.plans import analyses
from ledgerspark.plans.ledger import tables
from ledgerspark.sources import blk, transactions

SF = "/root/testdata/sf0.001"


def test_header_fields_beyond_32_bits(spark, tmp_path):
    from ledgerspark.plans.queries import ORACLES, QUERIES

    keys = [0, 6, 5_106_601, 5_106_602, 8_999_999, 486_604_799, 486_604_800, 2_211_730_402, 2_211_730_403, 2**40]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["header_decode"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(ORACLES["header_decode"]).fetchall())


def _keys():
    r = random.Random(5)
    out = [None, b"", b"\0", bytes(25), b"\0" * 5 + b"a", b"\xf0"]
    for n in (1, 2, 5, 20, 21, 25, 32, 33, 40, 64, 65, 90):
        out += [r.randbytes(n) for _ in range(20)] + [b"\xf0" + r.randbytes(n - 1), bytes(n), b"\xff" * n, bytes(n - 1) + b"\1", bytes(n // 2) + r.randbytes(n - n // 2)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("name", ["bech32", "base58check", "address"])
def test_texts_of_a_batch_are_those_of_each(name):
    one, many = getattr(codec, f"{name}_text"), getattr(codec, f"{name}_texts")
    keys = _keys()
    want = [None if k is None else one(k) for k in keys]
    assert many(pa.array(keys, pa.binary())).to_pylist() == want
    assert many(pa.array(keys, pa.binary())[7:200]).to_pylist() == want[7:200]
    assert many(pa.array([], pa.binary())).to_pylist() == [] and many(pa.array([None], pa.binary())).to_pylist() == [None]


def test_a_batch_of_texts_takes_few_microseconds_each():
    programs = pa.array([i.to_bytes(20, "big") for i in range(100_000)], pa.binary())
    codec.bech32_texts(programs[:9])
    began = time.process_time()
    codec.bech32_texts(programs)
    assert time.process_time() - began < 2  # one by one: 5 s


def _block(rng, n_tx):
    body = bytes([n_tx])
    for i in range(n_tx):
        ins = [rng.randbytes(36) + bytes([k]) + rng.randbytes(k) + rng.randbytes(4) for k in (rng.randrange(4) for _ in range(rng.randrange(1, 4)))]
        outs = [rng.randbytes(8) + (bytes([k]) if k < 253 else b"\xfd" + k.to_bytes(2, "little")) + rng.randbytes(k) for k in (rng.choice((0, 25, 300)) for _ in range(rng.randrange(3)))]
        witness = b"".join(b"\2\1a\0" for _ in ins) if i % 3 == 0 else b""
        body += b"\1\0\0\0" + (b"\0\1" if witness else b"") + bytes([len(ins)]) + b"".join(ins) + bytes([len(outs)]) + b"".join(outs) + witness + rng.randbytes(4)
    return rng.randbytes(80) + body


def test_parsed_batches_equal_the_plain_parser():
    rng = random.Random(4)
    raws = [_block(rng, n) for n in (0, 1, 2, 7, 50)]
    for _ in range(300):  # cut, longer, or with some byte changed
        raw = bytearray(_block(rng, rng.randrange(1, 4)))
        kind = rng.randrange(3)
        if kind == 0:
            raw = raw[: rng.randrange(80, len(raw))]
        elif kind == 1:
            raw += b"\0"
        else:
            raw[rng.randrange(80, len(raw))] = rng.choice((0, 1, 252, 253, 254, 255))
        raws.append(bytes(raw))
    want, failed = [], 0
    for h, raw in enumerate(raws):
        try:
            n, txs = transactions.parse_block(raw)
            want += [{"height": h, "timestamp": 9, "n_tx": n, "tx_idx": i, **t, "parse_error": None} for i, t in enumerate(txs)]
        except transactions.ParseError as e:
            failed += 1
            want.append({k: None for k in transactions._Rows.NAMES} | {"height": h, "timestamp": 9, "ins": None, "outs": None, "parse_error": str(e)})
            with pytest.raises(transactions.ParseError, match=str(e)):
                list(transactions.parsed_batches([(h, 9, raw)], False))
    assert failed > 50
    got = [r for b in transactions.parsed_batches(((h, 9, raw) for h, raw in enumerate(raws)), True) for r in b.to_pylist()]
    assert got == want


def test_parsing_calls_nothing_for_each_entry(monkeypatch):
    raw = _block(random.Random(1), 200)
    calls = []
    monkeypatch.setattr(transactions, "parse_transaction", lambda c: calls.append(c))
    batches = list(transactions.parsed_batches([(0, 0, raw)] * 300, True))
    # No call for each field or transaction, and a batch holds a few MB of payloads.
    assert not calls and sum(b.num_rows for b in batches) == 60_000 and len(batches) >= 300 * len(raw) // (transactions.BATCH_BYTES + len(raw)) > 1


def test_headers_are_read_without_payloads(spark, tmp_path):
    raws = [bytes([i]) * 5000 for i in range(1, 6)]
    blk.write_blocks(spark.createDataFrame([(i, i, r) for i, r in enumerate(raws)], "file_no int, offset long, raw binary"), str(tmp_path / "b"), 5)
    assert sorted(len(r["raw"]) for r in blk.read_blocks(spark, str(tmp_path / "b"), most=80).collect()) == [80] * 5


def test_files_share_tasks(spark, tmp_path):
    rows = spark.range(120).selectExpr("CAST(id AS INT) AS file_no", "0L AS offset", "CAST(repeat('x', 80) AS BINARY) AS raw")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("files", "files")
    blk.write_blocks(rows, str(tmp_path / "b"), 120)
    tasks = [before.getStageInfo(s).numTasks for j in before.getJobIdsForGroup("files") for s in before.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert blk.read_blocks(spark, str(tmp_path / "b")).count() == 120 and max(tasks) <= 8


def _scripts():
    n20, n32, rng = "11" * 20, "22" * 32, random.Random(8)
    keys = [b + n32 for b in ("02", "03", "05", "00")]
    out = [f"a914{n20}876161", f"a914{n20}870051", f"a914{n20}8761ac", f"a914{n20}888761", f"0014{n20}", f"0020{n32}", f"5120{n32}", "6a", "6a00", "6a51", "6a0101", "6a02aa", "6aac51", "00", "4f", "50", "51", "60", "61"]
    out += [f"{head}{n:02x}{data * n}{tail}" for head in ("", "00", "4f", "51", "60", "50", "61", "0101") for n, data in ((1, "00"), (1, "80"), (1, "08"), (2, "00"), (2, "01"), (75, "00"), (75, "11"), (76, "11")) for tail in ("", "ac", "00")]
    out += [f"{head}{a}{tail}" for head in ("51", "") for a in ("048000000" + "1", "0480000000", "0400000080") for tail in ("", "61")]
    for n in (1, 2, 3, 4):
        for _ in range(25):
            out.append(f"{0x50 + rng.randrange(6):02x}" + "".join("21" + rng.choice(keys[:3]) for _ in range(n)) + f"{0x50 + rng.choice((n, n, n, n - 1, n + 1)):02x}" + rng.choice(("ae", "ae", "af", "ac")))
        out.append("51" + f"21{keys[0]}" * n + f"{0x50 + n:02x}ae61")
    for _ in range(300):
        s = bytearray.fromhex(rng.choice(out))
        s[rng.randrange(len(s))] = rng.choice((0, 1, 0x20, 0x21, 0x51, 0x61, 0x6A, 0x80, 0x87, 0xAC, 0xAE))
        out.append(s.hex())
    return out


@pytest.mark.parametrize("profile", ["reference", "standard"])
def test_decided_scripts_are_as_the_rules_have_it(spark, profile):
    rows = [(bytes.fromhex(s), h, t) for s in _scripts() for h in (388380, 388381) for t in (1, 1333238400, 1503539857)]
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else [bytes(x) for x in v] if isinstance(v, list) else v
    for r in script.with_class(spark.createDataFrame(rows, "script binary, height long, timestamp long"), profile).collect():
        assert {k: plain(v) for k, v in r["c"].asDict().items()} == script.classify(bytes(r["script"]), r["height"], r["timestamp"], profile), bytes(r["script"]).hex()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_ledgers_scripts_are_decided_without_python(spark):
    outs = tables(spark, SF)["outs"]
    rule, _ = script.fast(F.col("script"), F.hex("script"), F.col("timestamp"))
    assert outs.where(rule.isNull()).count() == 0


def test_tallies_are_those_of_decoded_scripts():
    rng = random.Random(2)
    scripts = [None, b"", *map(bytes.fromhex, _scripts()), *(rng.randbytes(rng.randrange(40)) for _ in range(500)), *(bytes(rng.choice((0x4C, 0x4D, 0x4E, 1, 0x61, 0xB1, 0x75, 0)) for _ in range(rng.randrange(12))) for _ in range(500)), b"\x51\xb1" * 3000]
    for cltv in (0, 1):
        heights = [opcodes.CLTV_HEIGHT - (1 - cltv)] * len(scripts)
        want = Counter(opcodes.op_name(o[0], o[3]) for s, h in zip(scripts, heights, strict=True) if s for o in opcodes.decode(s, h)[0])
        assert opcodes.tally(pa.array(scripts, pa.binary()), pa.array(heights, pa.int64())) == want
        assert opcodes.tally(pa.array(scripts, pa.binary())[3:9], pa.array(heights, pa.int64())[3:9]) == Counter(opcodes.op_name(o[0], o[3]) for s in scripts[3:9] for o in opcodes.decode(s, heights[0])[0])
    assert opcodes.tally(pa.array([], pa.binary()), pa.array([], pa.int64())) == {}


def test_tallies_take_part_of_a_microsecond_an_operation():
    scripts = pa.array([b"\x76\xa9\x14" + i.to_bytes(20, "big") + b"\x88\xac" for i in range(200_000)], pa.binary())
    heights = pa.array([0] * len(scripts), pa.int64())
    began = time.process_time()
    assert sum(opcodes.tally(scripts, heights).values()) == 1_000_000
    assert time.process_time() - began < 0.5  # decoded one by one: over 1 s


def test_parts_grow_with_the_files(spark, tmp_path, monkeypatch):
    spark.range(200_000).selectExpr("id", "rand() AS x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert shared.parts(df) == 4
    monkeypatch.setattr(shared, "PART_BYTES", 100_000)
    assert 15 < shared.parts(df, df.where("id > 5")) < 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_live_keys_shuffle_events_once_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_BYTES", 20_000)
    t = tables(spark, SF)
    plan = analyses.live_keys(t["ins"], t["outs"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    found = [int(x) for x in re.findall(r"Exchange hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", physical)]
    assert len(found) == 2 and min(found) > 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_addresses_are_made_after_they_are_in_order(spark):
    found = analyses.addresses(tables(spark, SF)["outs"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Sampling for the order runs what is below the exchange once more: no Python there.
    assert plan.count("rangepartitioning") == 1 and "ArrowEvalPython" not in plan[plan.index("rangepartitioning") :]
    places = [(r["height"], r["tx_idx"], r["vout"], r["pos"]) for r in found.collect()]
    assert places == sorted(places) and len(set(places)) == len(places) > 1000


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_clusters_read_what_was_spent_once(spark):
    t = tables(spark, SF)
    plan = analyses.cluster_edges(analyses.input_keys(t["ins"], t["outs"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_large_step_makes_edges_unique_only_after_the_small_one(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (5, 2), (5, 3)], "u long, v long")
    said = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert said(cluster._star(edges, True)) == 1 < said(cluster._star(edges, False))
    made = cluster._star(cluster._star(edges, True), False).collect()
    assert len(made) == len(set(made)) and all(r["u"] > r["v"] for r in made)
