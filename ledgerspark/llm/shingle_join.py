"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A document's set is its distinct word shingles, hashed to 64 bits. Sets are
arranged in size bands. A band's scheme hashes the universe of shingles into
segments; a set's segment subset is what of the set falls into a segment. Sets of
Jaccard similarity 0.8 or more differ in at most h shingles, so of any h + 1
segment subsets of a set one is equal in its partner. A set is indexed by all its
non-empty segment subsets, under the scheme of its band and, if it may be the
larger of a pair, under the band below. Sets of few segments are also indexed by
their subsets' one-deletion neighbourhoods: a subset equal up to one shingle
counts twice.

Allocation by cost: the index tells how many sets share each key. A set must look
through subsets worth h + 1; those that no other set shares cost nothing and come
first, then the cheapest. A set with h + 1 subsets of its own has no partner at
all, so common passages cost nothing to sets that are otherwise their own. Sets
whose subsets are not worth h + 1 also share one key and so meet each other.

What a set looks through meets by centers: a key's center is its member that
shares most, and keys of one center are looked through together, once. Members
carry parity sketches: bit i tells whether an odd number of a set's shingles hash
to i, so two sketches differ in no more bits than the sets in shingles. Pairs
whose sketches differ in more bits than linked sets may are left out, which loses
no link; the rest is verified by counting the shingles of both whole texts. Only
such pairs become rows. Components suffice, so this goes in three rounds: every
set with its nearest center; every set with its nearest member of each other
component; every pair left that lies in different components. The last round
leaves out no pair that could link two components, so the result is exact.

Heavy keys: a key that many sets of one batch of texts share is known to be
shared; such entries are dealt by set, and one mark of the batch goes to the key.
Centers with many members are split into blocks, each pair of blocks a group.

Hashes: equal sets are one class by a 128-bit name (a clash of its first half is
seen, and the names are made anew). A 64-bit hash stands for a shingle: two texts
of n different shingles are mistaken in one with probability n^2 / 2^64.

Defined cases: null text, and text without words, has the empty set and links
with nothing; with fewer words than a shingle the whole sequence is one; rows
that repeat an id each have a row; a row without id gets the component of its
copies that have one; an empty table gives no rows. Other columns are not used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import dropped, new_path, partitions, released, row_struct, small_arrow_batches, stored
from ledgerspark.llm.words import MULTIPLIER, mixed, word_hashes
from ledgerspark.operators.cluster import components

WORDS = 5
#: Similarity asked for, in hundredths.
PERCENT = 80
#: Ratio of a band's largest and smallest size.
BAND = 1.5
#: Schemes of so many segments or fewer index deletions.
FEW_SEGMENTS = 16
#: Sets verified against one other set in one group; a group is streamed.
GROUP = 256
#: Sets of one batch of texts that make a key heavy, and what a heavy key counts for a set of the batch.
HEAVY, HEAVY_COST = 64, 256
#: Characters of texts, and shingles of sets, whose arrays are made together.
TOGETHER = 1 << 18
#: Sets, and bytes of their sketches, in a block of a center's members.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Marked rows (two numbers each, 50 MB in all) that are broadcast at most.
MOST_BROADCAST = 2_000_000
#: Bits of a sketch for each shingle that linked sets may differ in, at least; a power of two.
SKETCH_BITS = 8


def bands(longest: int = 1 << 40) -> list[int]:
    """Largest size of each band."""
    out = [1]
    while out[-1] < longest:
        out.append(int(out[-1] * BAND) + 1)
    return out


def most_apart(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def largest_partner(a: int) -> int:
    return a * 100 // PERCENT


def scheme(top: int) -> int:
    """Segments of the scheme whose smaller sets have ``top`` shingles at most."""
    need = most_apart(top, largest_partner(top)) + 1
    return need + max(2, need // 8)


def shingle_sets(texts, words: int = WORDS):
    """(shingles, ends): sorted distinct hashes of each text, one after another.

    Portions of ``TOGETHER`` characters bound what is held beside the result."""
    import numpy as np

    h, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in portions(texts, TOGETHER):
        own, ends = _shingle_sets(texts[a:b], words)
        h.append(own)
        size.append(np.diff(ends, prepend=0))
    return np.concatenate(h), np.cumsum(np.concatenate(size))


def _shingle_sets(texts, words: int):
    import numpy as np

    word, _, count = word_hashes(texts)
    with np.errstate(over="ignore"):
        first = np.cumsum(count) - count
        shingles = np.maximum(count - words + 1, (count > 0).astype(np.int64))
        total = int(shingles.sum())
        of = np.repeat(np.arange(len(count)), shingles)
        at = np.arange(total) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[of]
        h = np.zeros(total, np.uint64)
        padded = np.r_[word, np.zeros(words, np.uint64)]
        for j in range(words):
            w = padded[at + j]
            w = np.where(count[of] > j, w, np.uint64(0))
            h = mixed(h * np.uint64(3) + w)
        h = mixed(h ^ np.minimum(count[of], words).astype(np.uint64))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if total else np.zeros(0, bool)
    h, of = h[new], of[new]
    return h, np.cumsum(np.bincount(of, minlength=len(count)))


def digests(h, ends, seed: int = 0):
    """One signed 64-bit name per set, from sums of its shingles' mixed hashes and its size."""
    import numpy as np

    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(mixed(h + np.uint64(99 + seed)), dtype=np.uint64)]
        starts = np.r_[0, ends[:-1]]
        return mixed((sums[ends] - sums[starts]) ^ (ends - starts).astype(np.uint64) * np.uint64(MULTIPLIER)).view(np.int64)


def sketch_bits(top: int) -> int:
    """Bits of the sketches of a band's sets."""
    return 1 << max(6, (SKETCH_BITS * most_apart(top, largest_partner(top)) - 1).bit_length())


def sketches(h, ends) -> list[bytes]:
    """Parity sketch of each set, as long as its band asks."""
    import numpy as np

    tops = bands()
    size = np.diff(np.r_[0, ends])
    bits = np.array([sketch_bits(tops[i]) for i in np.searchsorted(tops, size)], np.int64)
    begin = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(size)), size)
    at = (mixed(h ^ np.uint64(0x0DD)) & (bits[of] - 1).astype(np.uint64)).astype(np.int64) + begin[of]
    odd = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[i // 8 : (i + n) // 8] for i, n in zip(begin.tolist(), bits.tolist(), strict=True)]


def folded(sketches_: list[bytes], bits: int):
    """Sketches as rows of 64-bit words, the longer ones folded to ``bits``."""
    import numpy as np

    out = np.empty((len(sketches_), bits // 64), np.uint64)
    for i, raw in enumerate(sketches_):
        x = np.frombuffer(raw, "<u8")
        while len(x) > bits // 64:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def close_pairs(a, n_a, b, n_b, differ):
    """(rows of a, rows of b, bits) of pairs that ``differ(i, j)`` asks for and that may be linked.

    a and b are sketches of equal width, n_a and n_b the sets' sizes. Tiles bound
    the memory: a few megabytes whatever the blocks' sizes."""
    import numpy as np

    rows, cols, bits = [], [], []
    step = max(1, (4 << 20) // max(1, 8 * a.shape[1] * len(b)))
    for i in range(0, len(a), step):
        part = n_a[i : i + step, None]
        ask = differ(slice(i, i + step)) & (part * 100 >= n_b[None] * PERCENT) & (n_b[None] * 100 >= part * PERCENT)
        x, y = np.nonzero(ask)
        for k in range(0, len(x), 65_536):
            x2, y2 = x[k : k + 65_536], y[k : k + 65_536]
            far = np.zeros(len(x2), np.int64)
            for w in range(0, a.shape[1], 64):
                far += np.bitwise_count(a[i + x2, w : w + 64] ^ b[y2, w : w + 64]).sum(axis=1, dtype=np.int64)
            near = far <= (n_a[i + x2] + n_b[y2]) * (100 - PERCENT) // (100 + PERCENT)
            rows.append(i + x2[near])
            cols.append(y2[near])
            bits.append(far[near])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(cols), join(bits)


def index_keys(h, ends, tops):
    """Index entries (set number, key, need, units, unit) of the sets given one after another.

    need: units the set must look through under the scheme; units: how many it
    has; unit: 0 for a segment's own key (the key is its unit), else the segment
    whose deletions the key belongs to. A key's upper byte is its scheme. Runs of
    about ``TOGETHER`` shingles bound what is held beside the result."""
    import numpy as np

    out, a = [_index_keys(h[:0], ends[:0], tops)], 0
    while a < len(ends):
        begin = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + TOGETHER, side="right")))
        who, *rest = _index_keys(h[begin : ends[b - 1]], ends[a:b] - begin, tops)
        out.append((who + a, *rest))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _index_keys(h, ends, tops):
    import numpy as np

    out = []
    starts = np.r_[0, ends[:-1]]
    size = ends - starts
    band = np.searchsorted(tops, size)
    for below in (0, 1):
        k = band - below
        use = (size > 3) & (k >= 0)
        if below:
            use &= size <= np.array([largest_partner(tops[max(i, 0)]) for i in k])
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        m_of = np.array([scheme(tops[i]) for i in k[rows]])
        other = np.where(below, np.array([tops[i] for i in k[rows]]), np.array([largest_partner(int(x)) for x in size[rows]]))
        need = (size[rows] + other) * (100 - PERCENT) // (100 + PERCENT) + 1
        n = size[rows]
        of = np.repeat(np.arange(len(rows)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[rows][of]
        token = h[at]
        with np.errstate(over="ignore"):
            spread = mixed(token ^ np.uint64(0x5EED))
            segment = (spread >> np.uint64(32)).astype(np.int64) * m_of[of] >> 32
            cell = np.cumsum(m_of)[of] - m_of[of] + segment
            order = np.argsort(cell, kind="stable")
            cell, token, of2 = cell[order], token[order], of[order]
            begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sums = np.add.reduceat(mixed(token + np.uint64(7)), begin)
            owner, seg = of2[begin], segment[order][begin]
            scheme_of = k[rows].astype(np.uint64)
            own = np.bincount(owner, minlength=len(rows))
            twice = m_of <= FEW_SEGMENTS
            units = own * (1 + twice)

            def named(x, who, s, kind):
                v = mixed(x + mixed(s.astype(np.uint64) * np.uint64(4) + np.uint64(kind) + (scheme_of[who] << np.uint64(40))))
                return (v & np.uint64((1 << 56) - 1)) | (scheme_of[who] << np.uint64(56))

            out.append((rows[owner], named(sums, owner, seg, 0), need[owner], units[owner], np.zeros(len(owner), np.int64)))
            lack = np.flatnonzero(need > units)
            if len(lack):  # these meet under one key of the scheme
                out.append((rows[lack], np.uint64((1 << 56) - 1) | (scheme_of[lack] << np.uint64(56)), need[lack], units[lack], np.zeros(len(lack), np.int64)))
            few = twice[owner]
            if few.any():
                out.append((rows[owner[few]], named(sums[few], owner[few], seg[few], 1), need[owner[few]], units[owner[few]], seg[few] + 1))
                part = twice[of2]
                whole = np.repeat(sums, np.diff(np.r_[begin, len(token)]))[part]
                t, w, s = token[part], of2[part], segment[order][part]
                out.append((rows[w], named(whole - mixed(t + np.uint64(7)), w, s, 1), need[w], units[w], s + 1))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    who, key, need, units, unit = (np.concatenate(x) for x in zip(*out, strict=True))
    return who, key.view(np.int64), need, units, unit


def portions(texts, chars: int = 1_000_000):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def document_sets(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, h (text hash), n (set size), rec and rec2 (halves of the set's name) of every row."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, recs = [], ([], [])
            for a, b in portions(texts):
                h, ends = shingle_sets(texts[a:b])
                sizes.append(np.diff(np.r_[0, ends]))
                for i in (0, 1):
                    recs[i].append(digests(h, ends, 2 * seed + i))
            if texts:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(np.concatenate(x)) for x in (sizes, *recs)]], ["doc_id", "h", "n", "rec", "rec2"])
        released()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, n long, rec long, rec2 long")


def key_blocks(texts, parts: int, tops, seed: int, seen: set[int]):
    """Index entries of the texts' sets that are not ``seen``, as one block for each part; None without entries."""
    import numpy as np
    import pyarrow as pa

    h, ends = shingle_sets(texts)
    recs = digests(h, ends, 2 * seed)
    who, key, need, units, unit = index_keys(h, ends, tops)
    # A copy of a set that this task has sent adds nothing.
    fresh = np.array([not (r in seen or seen.add(r)) for r in recs.tolist()], bool)
    if len(seen) > 200_000:
        seen.clear()
    keep = fresh[who] if len(who) else np.zeros(0, bool)
    who, key, need, units, unit = who[keep], key[keep], need[keep], units[keep], unit[keep]
    if not len(who):
        return None
    names, of, count = np.unique(key, return_inverse=True, return_counts=True)
    heavy = count[of] >= HEAVY
    size = np.diff(np.r_[0, ends])
    spread = lambda x: (mixed(x.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    marks = names[count >= HEAVY]
    none = np.zeros(len(marks), np.int64)
    cols = [
        np.r_[key, marks], np.r_[recs[who], none], np.r_[size[who], none].astype(np.int32), np.r_[need, none].astype(np.int32), np.r_[units, none].astype(np.int32), np.r_[unit, none].astype(np.int16),
        np.r_[np.where(heavy, np.minimum(count[of] * HEAVY_COST, 1 << 30), 1), count[count >= HEAVY]].astype(np.int32),
    ]
    part = np.r_[np.where(heavy, parts + spread(recs[who]), spread(key)), spread(marks)]
    order = np.argsort(part, kind="stable")
    part, cols = part[order], [c[order] for c in cols]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    rows = [[c[i:j].tobytes() for i, j in zip(cuts, np.r_[cuts[1:], len(part)], strict=True)] for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), *[pa.array(r, pa.binary()) for r in rows]], ["part", "key", "rec", "n", "need", "units", "unit", "times"])


def shared_keys(docs: DataFrame, seed: int = 0) -> DataFrame:
    """rec, n, key, unit, need, units, sharing: index entries that sets share.

    Entries travel as blocks, one for each batch of texts and part of the key
    space; a task sorts the entries of its parts. No batch of texts sends more than
    ``HEAVY`` entries of a key to the key's part: beyond that they go to parts by
    set, and the key's part gets one mark (no set, how many it stands for)."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    parts = 2 * partitions(spark)
    tops = bands()

    def emit(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in portions(texts, 4_000_000):
                if made := key_blocks(texts[a:b], parts, tops, seed, seen):
                    yield made
        released()

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int16, np.int32)
        got = {False: [[] for _ in kinds], True: [[] for _ in kinds]}
        for batch in batches:
            known = batch.column(0).to_numpy() >= parts
            for which in (False, True):
                if (known == which).any():
                    some = batch.filter(pa.array(known == which))
                    for i in range(len(kinds)):
                        got[which][i].append(b"".join(some.column(i + 1).to_pylist()))
        for which in (False, True):
            cols = [np.frombuffer(b"".join(g), t) for g, t in zip(got.pop(which), kinds, strict=True)]
            if not len(cols[0]):
                continue
            if not which:
                # Only keys that occur twice need the sort.
                order = np.argsort(cols[0], kind="stable")
                key = cols[0][order]
                twin = np.zeros(len(key), bool)
                same = key[1:] == key[:-1]
                twin[1:] |= same
                twin[:-1] |= same
                cols = [c[order[twin]] for c in cols]
            order = np.lexsort((cols[5], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            key, rec, mark = cols[0], cols[1], cols[2] == 0
            if not len(key):
                continue
            first = np.r_[True, (key[1:] != key[:-1]) | (rec[1:] != rec[:-1])] | mark
            cols = [c[first] for c in cols]
            key, mark = cols[0], cols[2] == 0
            if which:
                sharing, keep = cols[6], np.ones(len(key), bool)
            else:
                begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                total = np.add.reduceat(cols[6].astype(np.int64), begin)
                sharing = np.minimum(np.repeat(total, np.diff(np.r_[begin, len(key)])), 1 << 30).astype(np.int32)
                keep = (sharing > 1) & ~mark
            every = np.flatnonzero(keep)
            for a in range(0, len(every), 100_000):
                at = every[a : a + 100_000]
                arrays = [cols[1][at], cols[2][at], key[at], cols[5][at], cols[3][at], cols[4][at], sharing[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["rec", "n", "key", "unit", "need", "units", "sharing"])
        released()

    block = "part int, key binary, rec binary, n binary, need binary, units binary, unit binary, times binary"
    return docs.select("text").mapInArrow(emit, block).repartition(partitions(spark), "part").mapInArrow(meet, "rec long, n int, key long, unit short, need int, units int, sharing int")


def allocate(shared: DataFrame) -> DataFrame:
    """rec, n, key, w, chosen: all shared entries; those chosen the set must look through.

    Units are ordered by cost; those that nothing shares are not in ``shared`` and
    cost nothing. A segment's deletions cost no less than the segment, so they
    come after it. A set whose units are worth too little takes all, and the key
    of such sets among them. w is how much the set shares in all. Entries are dealt
    by set once; a set has no more of them than twice its shingles and segments."""
    parts = partitions(shared.sparkSession)
    each = shared.withColumns({"scheme": F.shiftrightunsigned("key", 56), "u": F.when(F.col("unit") == 0, F.col("key")).otherwise(F.col("unit").cast("long"))})
    units = each.repartition(parts, "rec").groupBy("rec", "scheme", "u").agg(
        F.sum(F.col("sharing").cast("long")).alias("cost"), F.first("need").alias("need"), F.first("units").alias("units"), F.max("unit").alias("unit"), F.first("n").alias("n"), F.collect_set("key").alias("keys")
    )
    by = Window.partitionBy("rec", "scheme")
    ranked = units.withColumns({"nr": F.row_number().over(by.orderBy("cost", "unit", "u")), "listed": F.count("*").over(by), "w": F.sum("cost").over(Window.partitionBy("rec"))})
    return ranked.select("rec", "n", F.explode("keys").alias("key"), "w", F.expr("nr <= need - (units - listed)").alias("chosen"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, h (text hash), z: each text compressed, as it travels from here on."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(2).to_pylist()]
            packed, sizes = [codec.compress(r, asbytes=True) if r else b"" for r in raw], [len(r) for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "h", "size", "z"])
        released()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, size long, z binary")


def unpacked(sizes, packed, most: int = 4_000_000):
    """(from, to, texts) of runs of packed texts of about so many bytes."""
    import pyarrow as pa

    codec, at, held, total = pa.Codec("zstd"), 0, [], 0
    for i, (size, z) in enumerate(zip(sizes.to_pylist(), packed.to_pylist(), strict=True)):
        held.append(codec.decompress(z, decompressed_size=size, asbytes=True).decode("utf-8", "surrogatepass") if size else "")
        total += size
        if total >= most:
            yield at, i + 1, held
            at, held, total = i + 1, [], 0
    if held:
        yield at, at + len(held), held


class Texts:
    """Packed texts of candidate sets, in a table bucketed by set: joins by set don't move them."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        parts = partitions(spark)
        self.spark, self.path, self.name = spark, new_path(spark, "candidate-texts"), "candidate_texts_" + uuid.uuid4().hex
        dealt = rows.repartition(parts, "rec").dropDuplicates(["rec"])
        dealt.write.format("parquet").option("path", self.path).option("compression", "none").bucketBy(parts, "rec").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        self.table._stored_path = self.path
        dropped(self.table)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with column linked, by counting the shingles of both whole texts.

    The sets compared with one set follow it in a sorted stream; beyond ``GROUP``
    of them they are dealt to several groups, each with the one set again."""
    spark = pairs.sparkSession
    small_arrow_batches(spark)
    groups = pairs.groupBy("a").agg(F.expr(f"CAST(count(*) div {GROUP} + 1 AS INT)").alias("groups"))
    right = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), "b")
    right = right.join(texts.withColumnRenamed("rec", "b"), "b").select("a", "g", F.lit(1).alias("kind"), "b", "size", "z")
    left = groups.join(texts.withColumnRenamed("rec", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("kind"), F.col("a").alias("b"), "size", "z")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        mine = np.zeros(0, np.uint64)
        for batch in batches:
            a, kind, b = batch.column(0), batch.column(2).to_numpy(), batch.column(3)
            linked = np.zeros(batch.num_rows, bool)
            for i, j, some in unpacked(batch.column(4), batch.column(5), 1_000_000):
                h, ends = shingle_sets(some)
                starts = np.r_[0, ends[:-1]]
                for k in range(i, j):
                    own = h[starts[k - i] : ends[k - i]]
                    if kind[k] == 0:
                        mine = own.copy()
                    elif len(mine) and len(own):
                        both = int((mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own).sum())
                        linked[k] = 100 * both >= PERCENT * (len(own) + len(mine) - both)
            asked = pa.array(kind == 1)
            yield pa.RecordBatch.from_arrays([a.filter(asked), b.filter(asked), pa.array(linked).filter(asked)], ["a", "b", "linked"])
        released()

    rows = left.unionByName(right).repartition(partitions(spark), "a", "g").sortWithinPartitions("a", "g", "kind")
    return rows.mapInArrow(compare, "a long, b long, linked boolean")


def candidates(lookers: DataFrame, members: DataFrame, marks: DataFrame, nearest: bool = False) -> DataFrame:
    """rec, rec2, comp2, bits: pairs of a looker and a member of its groups that may be linked.

    Both sides: center, scheme, rec, n, comp; marks: rec, sketch. Pairs of one
    component are left out; with ``nearest``, so are all but a looker's nearest
    member of each component within a block. Groups are split into blocks of
    bounded size."""
    spark = lookers.sparkSession
    small_arrow_batches(spark)
    tops = bands(1 << 32)
    group = ["center", "scheme"]
    row_bytes = F.get(F.array(*[F.lit(sketch_bits(t) // 4).cast("long") for t in tops]), F.col("scheme"))
    size = lambda df, name: df.groupBy(*group).agg(F.count("*").alias("m")).select(*group, F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("m") * row_bytes / BLOCK_BYTES)).cast("int").alias(name))
    # Only groups with members of other components have anything to compare.
    sides = lookers.select(*group, "comp").unionByName(members.select(*group, "comp"))
    several = sides.groupBy(*group).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(*group)
    shape = size(lookers, "p").join(size(members, "q"), group).join(several, group)
    deal = lambda n: F.pmod(F.xxhash64("rec"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["rec", "n", "comp"]
    left = lookers.join(shape, group).select(*group, deal("p").alias("i"), every("q").alias("j"), F.lit(0).alias("kind"), *columns)
    right = members.join(shape, group).select(*group, every("p").alias("i"), deal("q").alias("j"), F.lit(1).alias("kind"), *columns)

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def cells():
            """(scheme, kinds, recs, sizes, comps, sketches) of each group of rows."""
            held, name = [], None
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
                cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
                for s, e in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=True):
                    this = tuple(keys[:, s])
                    if name is not None and this != name:
                        yield name[1], held
                        held = []
                    name = this
                    held.append(batch.slice(s, e - s))
            if held:
                yield name[1], held

        out, rows = [], 0
        names = ["rec", "rec2", "comp2", "bits"]
        for scheme_, held in cells():
            kind, rec, n, comp = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (4, 5, 6, 7))
            if not (0 < kind.sum() < len(kind)):
                continue
            raw = [x for b in held for x in b.column(8).to_pylist()]
            x = folded(raw, sketch_bits(tops[scheme_]))
            one, two = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            i, j, far = close_pairs(x[one], n[one].astype(np.int64), x[two], n[two].astype(np.int64), lambda at: comp[one[at], None] != comp[two][None])
            i, j = one[i], two[j]
            if nearest and len(i):
                order = np.lexsort((rec[j], far, comp[j], i))
                i, j, far = i[order], j[order], far[order]
                first = np.r_[True, (i[1:] != i[:-1]) | (comp[j][1:] != comp[j][:-1])]
                i, j, far = i[first], j[first], far[first]
            if len(i):
                out.append((rec[i], rec[j], comp[j], far))
                rows += len(i)
            if rows > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
        released()

    rows = left.unionByName(right).join(marks, "rec").select(*group, "i", "j", "kind", *columns, "sketch")
    cells_ = rows.repartition(partitions(spark), *group, "i", "j").sortWithinPartitions(*group, "i", "j", "kind")
    return cells_.mapInArrow(compare, "rec long, rec2 long, comp2 long, bits long")


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a < b) of the first two columns."""
    x, y = df.columns[:2]
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(sets, their first rows: rec, doc_id, h, n; seed of their names), written."""
    for seed in range(8):
        sets = stored(document_sets(docs, seed), "shingle-sets")
        one = sets.groupBy("rec").agg(F.min(F.struct("doc_id", "h")).alias("o"), F.first("n").alias("n"), (F.min("rec2") != F.max("rec2")).alias("clash"))
        one = stored(one.select("rec", "o.doc_id", "o.h", "n", "clash"), "shingle-classes")
        if one.where("clash").isEmpty():
            return sets, one.drop("clash"), seed
        dropped(sets, one)
    raise RuntimeError("names of sets clash with eight seeds")


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets: doc_id, h, n, rec, rec2; links between sets: a, b), both written.

    links hold enough of all links for every component."""
    sets, one, seed = _sets(docs)
    shared = stored(shared_keys(docs, seed), "shared-keys")
    entries = stored(allocate(shared), "allocated-keys")
    dropped(shared)
    # A key's center is its member that shares most; keys nobody looks through are dropped.
    centers = entries.groupBy("key").agg(F.max(F.struct("w", "rec")).alias("c"), F.max("chosen").alias("asked")).where("asked").select("key", F.col("c.rec").alias("center"))
    # Keys of one center are looked through together.
    scheme_ = F.shiftrightunsigned("key", 56).cast("int").alias("scheme")
    belonging = entries.join(centers, "key").groupBy("center", scheme_, "rec").agg(F.first("n").alias("n"), F.max("chosen").alias("looks"))
    belonging = stored(belonging, "members")
    dropped(entries)
    looking, belonging_ = belonging.where("looks").drop("looks"), belonging.drop("looks")

    wanted = one.join(belonging.select("rec").distinct(), "rec", "left_semi").select("rec", F.col("doc_id").alias("d"), F.col("h").alias("k"))
    rows = packed_texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))).select("rec", "size", "z")
    texts = Texts(rows)

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, some in unpacked(batch.column(1), batch.column(2), 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sketches(*shingle_sets(some)), pa.binary())], ["rec", "sketch"])
        released()

    marks = stored(texts.table.select("rec", "size", "z").mapInArrow(sketch, "rec long, sketch binary"), "sketches")

    def labelled(found: list[DataFrame] | None):
        """A function that adds comp, a set's component by the links found so far."""
        if found is None:
            return lambda df: df.withColumn("comp", F.col("rec"))
        links = found[0]
        for more in found[1:]:
            links = links.unionByName(more)
        of = components(links.where("linked")).select(F.col("node").alias("rec"), F.col("component").alias("comp"))
        return lambda df: df.join(of, "rec", "left").withColumn("comp", F.coalesce("comp", "rec"))

    def found_by(new: DataFrame, name: str) -> DataFrame:
        pairs = stored(_pairs(new), f"{name}-pairs")
        out = stored(verified(pairs, texts.table), name)
        dropped(pairs)
        return out

    # Every set with its nearest center.
    comp = labelled(None)
    others = comp(looking.where("rec <> center"))
    near = candidates(others, comp(belonging_.where("rec = center")), marks)
    best = near.withColumn("nr", F.row_number().over(Window.partitionBy("rec").orderBy("bits", "rec2"))).where("nr = 1")
    found = [found_by(best.select("rec", "rec2"), "found-1")]
    # Every set with its nearest member of each other component; then whatever is left.
    for nearest in (True, False):
        comp = labelled(found)
        near = candidates(comp(looking), comp(belonging_), marks, nearest)
        known = found[0].unionByName(found[-1]) if len(found) > 1 else found[0]
        new = _pairs(near.select("rec", "rec2")).join(known.select("a", "b"), ["a", "b"], "left_anti")
        found.append(found_by(new, f"found-{len(found) + 1}"))
    dropped(belonging, marks)
    texts.drop()
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return sets, every.where("linked").select("a", "b")


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    sets, links = near_duplicates(docs)
    one = sets.where("n > 0").groupBy("rec").agg(F.min("doc_id").alias("rep"))
    of = components(links).withColumnRenamed("node", "rec").join(one, "rec", "right")
    of = of.withColumn("component", F.coalesce("component", "rec"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = of.join(least, "component").select("rec", "component_id")
    out = sets.where("n > 0").join(named, "rec", "left").select("doc_id", "n", "component_id")
    alone = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of the rows of ``docs``; columns as they are.

    It is the row of the smallest id (rows without id last), then of the smallest
    text hash, then of the smallest hash of all columns. Rows without words are
    each a component of their own and stay. Any further columns are carried,
    whatever their names."""
    sets, links = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("o")
    of = components(links).withColumnRenamed("node", "rec").join(sets.where("n > 0").groupBy("rec").agg(first), "rec", "right")
    of = of.withColumn("component", F.coalesce("component", "rec"))
    named = of.join(of.groupBy("component").agg(F.min("o").alias("kept")), "component").select("rec", F.col("kept.doc_id").alias("d"), F.col("kept.h").alias("k"))
    rows = sets.where("n > 0").join(named, "rec").groupBy("doc_id", "h").agg(F.count("*").alias("times"), F.max(F.expr("doc_id <=> d AND h <=> k")).alias("kept"))
    marked = stored(rows.where("times > 1 OR NOT kept").select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "kept"), "near-duplicates")
    # Few marked rows go to all tasks, so that texts stay where they are; beyond that both sides are dealt.
    if marked.count() <= MOST_BROADCAST:
        marked = F.broadcast(marked)
    met = docs.select(row_struct(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))
    out = met.join(marked, same, "left_anti").select("row.*")
    again = marked.where("kept")
    if again.isEmpty():
        return out
    row = F.min_by("row", F.xxhash64("row")).alias("row")
    return out.unionByName(met.join(again, same).groupBy("d", "k").agg(row).select("row.*"))
