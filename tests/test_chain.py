import hashlib
import random
import struct

import pytest

from ledgerspark.operators.chain import heights, walk
from ledgerspark.operators.cluster import components
from ledgerspark.operators.merkle import root
from ledgerspark.plans import analyses
from ledgerspark.plans.chain_tables import load
from ledgerspark.sources import blk
from ledgerspark.sources.transactions import Cursor, ParseError, parse_transaction

from tests.test_functions import HEADER

TX = bytes.fromhex(
    "01000000010000000000000000000000000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054696d65732030332f4a616e2f32303039204368616e63656c6c6f72206f6e206272696e6b206f66207365636f6e64206261696c6f757420666f722062616e6b73"
    "ffffffff0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5fac00000000"
)
PARENTS = {"A": None, "B": "A", "B'": "A", "C": "B", "C'": "B'", "D": "C", "D'": "C'"}


def name(x):
    return bytes(32) if x is None else x.encode().ljust(32, b"#")


@pytest.mark.parametrize(
    "files,want",
    [
        (["A B C"], "A B"), (["A C B D"], "A B C"), (["A C B"], "A"), (["A C B", "D"], "A B C"), (["A C B +"], "A B C"),
        (["A B B' C D"], "A B C"), (["A B B' C' D'"], "A B' C'"), (["A B B'", "C' D'"], "A"),
    ],
)
def test_walk(files, want):
    made = [([{"prev": name(PARENTS[x]), "cur": name(x)} for x in f.split() if x != "+"], "+" in f) for f in files]
    assert [b["cur"] for b in walk(made)] == [name(x) for x in want.split()]


def framed(raw):
    return blk.MAGIC + struct.pack("<I", len(raw)) + raw


def test_frames():
    raw = HEADER + b"\x01" + TX
    got = list(blk.frames(b"\0\0" + framed(raw) + b"\0" * 3 + framed(raw) + b"\0"))
    assert [(o, r == raw, last, trailing) for o, r, last, trailing, _ in got] == [(2, True, False, False), (2 + 8 + 285 + 3, True, True, True)]
    for bad, error in ((b"abcdefgh", "Invalid"), (framed(raw)[:-1], "Eof"), (framed(b"x" * 10), "Eof")):
        with pytest.raises(blk.FramingError, match=error):
            list(blk.frames(bad))
        assert [x[4] for x in blk.frames(framed(raw) + bad, permissive=True)] == [None, error]
    assert [n for n, _ in blk.consecutive(["blk00000.dat", "blk00002.dat"])] == [0]


def test_transaction():
    t = parse_transaction(Cursor(TX))
    assert t["txid"][::-1].hex() == "4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b"
    assert t["txid"] == t["wtxid"] and t["outs"][0]["value"] == 5_000_000_000
    with pytest.raises(ParseError, match="Invalid"):
        parse_transaction(Cursor(TX[:4] + b"\0\2" + TX[4:]))
    with pytest.raises(ParseError, match="Eof"):
        parse_transaction(Cursor(TX[:-1]))


def block(prev, txs, n):
    body = bytes([len(txs)]) + b"".join(txs)
    top = root([hashlib.sha256(hashlib.sha256(t).digest()).digest() for t in txs])
    head = struct.pack("<i", 1) + prev + top + struct.pack("<III", 1_600_000_000 + n, 0x1D00FFFF, n)
    return head + body, hashlib.sha256(hashlib.sha256(head).digest()).digest()


def tx(ins, outs):
    body = b"".join(h + struct.pack("<IBI", i, 0, 0xFFFFFFFF) for h, i in ins)
    made = b"".join(struct.pack("<qB", v, len(s)) + s for v, s in outs)
    raw = struct.pack("<I", 1) + bytes([len(ins)]) + body + bytes([len(outs)]) + made + struct.pack("<I", 0)
    return raw, hashlib.sha256(hashlib.sha256(raw).digest()).digest()


def test_end_to_end(spark, tmp_path):
    pay = lambda c: bytes.fromhex("76a914") + bytes([c]) * 20 + bytes.fromhex("88ac")
    coin, coin_id = tx([(bytes(32), 0xFFFFFFFF)], [(50, pay(1)), (30, pay(2)), (7, b"\x6a\x02hi"), (5, b"\x51")])
    spend, _ = tx([(coin_id, 0), (coin_id, 1)], [(80, pay(3))])
    raws, prev = [], bytes(32)
    for n, txs in enumerate([[coin], [spend], [tx([(bytes(32), 1)], [(9, pay(4))])[0]]]):
        raw, prev = block(prev, txs, n)
        raws.append(raw)
    (tmp_path / "blk00000.dat").write_bytes(b"".join(map(framed, raws)))
    t = load(spark, str(tmp_path))
    assert t["blocks"].count() == 2  # the tip has no successor
    assert load(spark, str(tmp_path), "standard")["blocks"].count() == 3
    got = {r["balance"] for r in analyses.balances(t["inputs"], t["outputs"]).collect()}
    assert got == {"0.00000080"}
    clusters = analyses.clusters(t["inputs"], t["outputs"]).collect()
    assert len(clusters) == 2 and len({r["cluster"] for r in clusters}) == 1
    assert [r["text"] for r in analyses.data_outputs(t["inputs"], t["outputs"]).collect()] == ["hi"]
    assert [r["value"] for r in analyses.donations(t["inputs"], t["outputs"]).collect()] == [5]
    assert analyses.addresses(t["outputs"]).count() == 3
    from ledgerspark.operators.merkle import check

    assert all(r["ok"] for r in check(t["blocks"], t["txs"]).collect())
    blk.register(spark)
    assert spark.read.format("blk").load(str(tmp_path)).count() == 3


def test_heights_without_root(spark):
    rows = [(name("X"), name("Y"))]
    df = spark.createDataFrame(rows, "block_hash binary, prev_hash binary")
    assert heights(df).count() == 0


def test_merkle():
    h = lambda a, b: hashlib.sha256(hashlib.sha256(a + b).digest()).digest()
    a, b, c = (bytes([i]) * 32 for i in range(3))
    assert root([]) is None and root([a]) == a and root([a, b, c]) == h(h(a, b), h(c, c))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(None, 5), (7, 7)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                label.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
