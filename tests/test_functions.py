import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import codec
from ledgerspark.functions.script import classify, number, truthy, with_class

#: The public first block's header, transaction and key.
HEADER = bytes.fromhex("01000000" + "00" * 32 + "3ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a" + "29ab5f49ffff001d1dac2b7c")
KEY = bytes.fromhex("04678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5f")
LATE, HIGH = 1503539857, 388381


def test_golden_encodings():
    h = codec.hash160_bytes(KEY)
    assert h.hex() == "62e907b15cbf27d5425399ebf6f0fb50ebb88f18"
    assert codec.base58check_text(b"\0" + h) == "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
    assert codec.base58check_text(b"\x05" + h) == "3Ai1JZ8pdJb2ksieUV8FsxSNVJCpoPi8W6"
    assert codec.bech32_text(bytes.fromhex("751e76e8199196d454941c45d1b3a323f1433bd6")) == "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    assert codec.address_text(None) is None


def test_ripemd160_plain():
    # Published test vectors.
    assert codec._ripemd160_plain(b"").hex() == "9c1185a5c5e9fc54612808977ee8f548b2258d31"
    assert codec._ripemd160_plain(b"abc").hex() == "8eb208f7e05d987a9b044a8e98c6b087f15a0bfc"
    assert codec._ripemd160_plain(b"a" * 200) == hashlib.new("ripemd160", b"a" * 200).digest()


def test_columns(spark):
    row = spark.createDataFrame([(HEADER, b"\xff\xfeab", 5_000_000_000)], "h binary, t binary, v long")
    got = row.select(
        codec.hash_pretty(codec.dsha256(F.col("h"))), codec.lossy_text(F.col("t")), codec.coin_text(F.col("v")),
        codec.hash160_pretty(codec.hash160(F.lit(KEY))), codec.address(F.concat(F.lit(b"\xf0"), F.lit(bytes(20)))),
    ).first()
    assert got[0] == "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"
    assert got[1] == b"\xff\xfeab".decode(errors="replace")
    assert got[2] == "50.00000000"
    assert got[3] == "62e907b15cbf27d5425399ebf6f0fb50ebb88f18"
    assert got[4].startswith("bc1q")


def test_numbers():
    assert [truthy(bytes.fromhex(x)) for x in ("", "80", "8001", "01", "0000")] == [False, False, True, True, False]
    assert [number(bytes.fromhex(x)) for x in ("", "81", "0102", "80", "0080000000")] == [0, -1, 258, 0, None]


n20, n32 = "11" * 20, "22" * 32
P2, P3, P4, B5 = "02" + n32, "03" + n32, "04" + n32 * 2, "05" + n32
CORPUS = [
    ("", "Donation"), ("ac", "Donation"), ("75", "Donation"), (f"76a914{n20}88ac", "PayToPubkeyHash"), (f"76a914{n20}88ac61", "PayToPubkeyHash"),
    (f"517576a914{n20}88ac", "PayToPubkeyHash"), (f"6176a914{n20}88ac", "Invalid"), (f"76a914{n20}88acac", "Invalid"), (f"76a914{n20}88ac75", "Unknown"),
    (f"76a914{n20}88", "Challenge"), (f"76a914{n20}", "Donation"), (f"a914{n20}87", "Challenge"), (f"a914{n20}876161", "PayToScriptHash"),
    (f"a614{n20}87", "Challenge"), (f"a714{n20}87", "Challenge"), (f"a820{n32}87", "Challenge"), (f"aa20{n32}87", "Challenge"),
    (f"0014{n20}", "PayToWitnessPubkeyHash"), (f"0020{n32}", "PayToWitnessScriptHash"), (f"5120{n32}", "Donation"), (f"21{P2}ac", "PayToPubkey"),
    (f"41{P4}ac", "PayToPubkey"), (f"21{B5}ac", "Invalid"), (f"21{P2}ac61", "Unknown"), (f"5121{P2}21{P3}52ae", "PayToMultisig"), (f"5221{P2}51ae", "Invalid"),
    (f"5121{P2}52ae", "Unknown"), ("6a04deadbeef", "DataOutput"), ("6a", "Invalid"), ("6a00", "Invalid"), ("6a03deadbeef", "Invalid"), ("6a02aabb02ccdd", "Invalid"),
    ("6a4c04deadbeef", "Invalid"), ("6a4c4b" + "33" * 75, "DataOutput"), ("736372697074", "Invalid"), ("76a90088ac", "Invalid"), ("767676", "Donation"), ("76", "Donation"),
    ("5387", "Donation"), ("82", "Donation"), ("51", "Donation"), ("00", "Invalid"), ("05aabb", "Invalid"), ("65", "Invalid"), ("50", "Invalid"), ("63", "Invalid"),
    ("6368", "Unknown"), ("61", "Unknown"), ("51b17551", "Unknown"), (f"4c21{P2}ac", "Invalid"), (f"76a921{P2}88ac", "Invalid"),
]


@pytest.mark.parametrize("text,kind", CORPUS)
def test_corpus(text, kind):
    assert classify(bytes.fromhex(text), HIGH, LATE)["kind"] == kind


def test_activation_and_profile():
    assert classify(bytes.fromhex(f"0014{n20}"), HIGH, LATE - 1)["kind"] == "Donation"
    assert classify(bytes.fromhex("0014" + "00" * 20), HIGH, LATE - 1)["kind"] == "Invalid"
    assert classify(bytes.fromhex(f"a914{n20}876161"), HIGH, 1333238399)["kind"] == "Unknown"
    assert classify(bytes.fromhex("51b17551"), HIGH - 1, LATE)["kind"] == "Donation"
    assert classify(bytes.fromhex(f"a914{n20}87"), HIGH, LATE, "standard")["kind"] == "PayToScriptHash"
    assert classify(bytes.fromhex(f"4c21{P2}ac"), HIGH, LATE)["would_abort"]
    assert classify(bytes.fromhex(f"5121{P2}21{P3}52ae"), HIGH, LATE)["required"] == 1


@pytest.mark.parametrize("profile", ["reference", "standard"])
def test_fast_path_equals_slow_path(spark, profile):
    rows = [(i, bytes.fromhex(s), h, t) for i, (s, _) in enumerate(CORPUS) for h in (HIGH - 1, HIGH) for t in (1, 1333238400, LATE)]
    df = spark.createDataFrame([*rows, (-1, None, 1, 1)], "id int, script binary, height long, timestamp long")
    got = with_class(df, profile).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["script"] is None:
            assert r["c"] is None or r["c"]["kind"] is None
            continue
        want = classify(bytes(r["script"]), r["height"], r["timestamp"], profile)
        have = r["c"].asDict()
        assert {k: (bytes(v) if isinstance(v, bytearray) else [bytes(x) for x in v] if isinstance(v, list) else v) for k, v in have.items()} == want
