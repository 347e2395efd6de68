"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its words, a term's weight its count. Sample i draws for
each term, from a hash of (term, i) alone, r and c from Gamma(2, 1) and b from
U(0, 1); with t = floor(ln w / r + b) and ln y = r (t - b), the term with the
least a = c / (y e^r) is the sample, and (term, t) its value. Two documents have
equal values at a sample with the probability of their generalised Jaccard
similarity (Ioffe, ICDM 2010). A fingerprint is the string of ``SAMPLES`` values
of 16 bits each; likeness is the share of equal values.

Gamma quantiles come from tables (made by rule, below), so a draw is a hash and
two look-ups. Terms are counted and sampled inside the task that holds their
document: texts are dealt once by ranges of ids, nothing else of their size moves.

The edit and near_next need each document's successor in descending id order.
Rows are dealt in ranges of about equal numbers of rows, by (id, text hash, place
in the input), so a repeated id is split too; the first row of a range is also
sent to the range before it. Bounds of ranges are the first rows' keys of a
sampled range partitioning of narrow rows; a row finds its range by binary search,
a loop over the steps in one expression, so the plan (of which the driver keeps
many copies as text) names the bounds eight times, however many steps there are.
A range is a task: ``RANGES`` at most, else four for each shuffle partition.

Defined cases: null text is empty; a text without words has the fingerprint of
all zeros, and two such are alike to degree 1; ids may be any long; rows with
equal ids are ordered by text hash, null ids come last; the only row is its own
successor; an empty table gives no rows. Other columns are not carried. The rows
of ``docs`` are read twice and must come in the same order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import partitions

SAMPLES = 64
#: Samples made in one pass over a term; more make plans too large for the driver.
TOGETHER = 16
SPACE = r"[\x20\x09-\x0D]+"
#: Cells of the quantile tables; within a cell quantiles are interpolated.
R_CELLS, C_CELLS = 64, 128
RANGES = 16_384


def gamma_quantile(u: float) -> float:
    """x with P(X <= x) = 1 - e^-x (1 + x) = u for X of Gamma(2, 1), by bisection."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid) * (1 + mid) < u else (low, mid)
    return (low + high) / 2


def tables() -> tuple[list[float], list[float]]:
    """Quantiles of r, and of ln c, at the ends of each cell; the open end is cut."""
    ends = lambda n: [max(i, 0.05) / n for i in range(n)] + [1 - 0.2 / n]
    r = [round(gamma_quantile(u), 6) for u in ends(R_CELLS)]
    return r, [round(math.log(gamma_quantile(u)), 6) for u in ends(C_CELLS)]


def fingerprints(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, part, values from keys, th (term hash long), lw (ln of its weight double).

    A part holds ``TOGETHER`` samples; the parts in order are the fingerprint.
    Bits of the hash of (term, sample): 6 + 10 for r and 7 + 13 for ln c (cell and
    place in it), 28 for b. Per sample the least long is kept: ln a in its upper
    bits, the value in its lower ones, so one min() finds the sampled term."""
    import numpy as np

    rt, ct = (F.lit(np.array(x)) for x in tables())
    aggs = []
    terms = terms.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // TOGETHER - 1))).alias("part"))
    for i in range(TOGETHER):
        h = F.xxhash64("th", F.col("part"), F.lit(i))
        part = lambda shift, bits, h=h: F.shiftrightunsigned(h, shift).bitwiseAND((1 << bits) - 1)
        unit = lambda shift, bits, p=part: (p(shift, bits) + 0.5) / float(1 << bits)
        between = lambda table, cell, place: F.get(table, cell) + (F.get(table, cell + 1) - F.get(table, cell)) * place
        # In the lowest cells u = x^2 / 2 - x^3 / 3 + ..., solved for x and for ln x.
        cell, place = part(0, 6).cast("int"), unit(6, 10)
        twice = place * (2.0 / R_CELLS)
        r = F.when(cell == 0, F.sqrt(twice) + twice / 3).otherwise(between(rt, cell, place))
        cell, place = part(16, 7).cast("int"), unit(23, 13)
        twice = place * (2.0 / C_CELLS)
        lnc = F.when(cell == 0, 0.5 * F.log(twice) + F.sqrt(twice) / 3).otherwise(between(ct, cell, place))
        b = unit(36, 28)
        t = F.when(F.col("lw") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("lw") / r + b))
        lna = lnc - r * (t - b + 1)
        # ln a lies far within (-1000, 1000): 31 bits keep its order to 2^-20.
        order = F.floor((lna + 1000.0) * float(1 << 20)).cast("long")
        value = (F.shiftrightunsigned(h, 32) + t).bitwiseAND((1 << 32) - 1)
        aggs.append(F.min(F.shiftleft(order, 32).bitwiseOR(value)).alias(f"s{i}"))
    least = terms.groupBy(*keys, "part").agg(*aggs)
    text = [F.lpad(F.lower(F.hex(F.xxhash64(F.col(f"s{i}").bitwiseAND((1 << 32) - 1)).bitwiseAND(0xFFFF))), 4, "0") for i in range(TOGETHER)]
    return least.select(*keys, "part", F.concat(*text).alias("values"))


def likeness(a, b, samples: int = SAMPLES):
    """Share of equal values of two fingerprint columns."""
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(samples))


def term_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, th, lw: each distinct word of a text with the log of its count.

    Grouping keeps the partitioning of ``keys``, so it needs no exchange where
    rows are dealt by one of them."""
    words = rows.select(*keys, F.explode(F.split(text, SPACE)).alias("w")).where("w <> ''")
    counts = words.select(*keys, F.xxhash64("w").alias("th")).groupBy(*keys, "th").count()
    return counts.select(*keys, "th", F.when(F.col("count") == 1, 0.0).otherwise(F.log("count")).alias("lw"))


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, k1, k2, k3: rows with the three parts of their place in descending id order.

    k1 turns ids round without overflow; in k2 null ids come after the one id that
    k1 can't tell from null, else it is 62 bits of the text's hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("k3"))
    k2 = F.shiftright(F.xxhash64("text"), 2) + F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("k1"), k2.alias("k2"), "k3")


def dealt_ranges(docs: DataFrame) -> DataFrame:
    """k1, k2, k3, text, b, copy: rows dealt by ranges of descending ids.

    copy is 1 for the first row of the next range, which stands after range b's own."""
    import numpy as np

    ranges = min(RANGES, 4 * partitions(docs.sparkSession))
    keys = ["k1", "k2", "k3"]
    narrow = ordered(docs).select(*keys).repartitionByRange(ranges, *keys)
    heads = narrow.groupBy(F.spark_partition_id().alias("b")).agg(F.min(F.struct(*keys)).alias("h")).select("h.*")
    heads = sorted(tuple(r) for r in heads.collect())  # one short row for each range
    ends = [F.lit(np.array([h[i] for h in heads] or [0], np.int64)) for i in range(3)]
    # Binary search for the last head that isn't above the row; past the last one get() is null.
    steps = [1 << i for i in reversed(range(max(1, (len(heads) - 1).bit_length())))]

    def moved(b, step):
        x, y, z = (F.get(e, b + step) for e in ends)
        not_above = (x < F.col("k1")) | ((x == F.col("k1")) & ((y < F.col("k2")) | ((y == F.col("k2")) & (z <= F.col("k3")))))
        return F.when(not_above, b + step).otherwise(b)

    placed = ordered(docs).withColumn("b", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), moved))
    x, y, z = (F.get(e, F.col("b")) for e in ends)
    first = (x == F.col("k1")) & (y == F.col("k2")) & (z == F.col("k3"))
    before = F.pmod(F.col("b") - 1, F.lit(max(1, len(heads))))
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("copy"))
    sent = F.struct(before.alias("b"), F.lit(1).alias("copy"))
    placed = placed.withColumn("to", F.explode(F.when(first, F.array(own, sent)).otherwise(F.array(own))))
    # Both readers of these rows use all of their columns, and columns that can't be null
    # get no null filter below the exchange: so it is the same for both and made once.
    sure = lambda c: F.coalesce(F.col(f"to.{c}"), F.lit(0)).alias(c)
    return placed.select(*keys, "text", sure("b"), sure("copy")).repartitionById(ranges, F.col("b"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = Window.partitionBy("b").orderBy("copy", "k1", "k2", "k3")
    # Back from the keys: only null ids have both the last k1 and a k2 above all hashes.
    null_id = (F.col("k1") == F.lit((1 << 63) - 1)) & (F.col("k2") >= F.lit(1 << 61))
    doc_id = F.when(~null_id, F.bitwise_not("k1")).alias("doc_id")
    rows = dealt_ranges(docs).select("b", "copy", doc_id, "text", F.row_number().over(order).alias("nr"), F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), edited.alias("t")))
    texts = rows.select("b", "nr", F.explode(F.when(F.col("copy") == 0, both).otherwise(F.slice(both, 1, 1))).alias("x")).select("b", "nr", F.col("x.v").alias("v"), F.col("x.t").alias("t"))
    made = fingerprints(term_rows(texts, ["b", "nr", "v"], "t"), ["b", "nr", "v"])
    parts = range(SAMPLES // TOGETHER)
    cell = lambda v, p: F.max(F.when((F.col("v") == v) & (F.col("part") == p), F.col("values")))
    made = made.groupBy("b", "nr").agg(*[cell(v, p).alias(f"p{v}_{p}") for v in (0, 1) for p in parts])
    made = made.select("b", "nr", *[F.concat(*[F.col(f"p{v}_{p}") for p in parts]).alias(n) for v, n in ((0, "f"), (1, "e"))])
    facts = rows.select("b", "nr", "copy", "doc_id", n.cast("long").alias("n_chars"), F.when(F.col("copy") == 0, F.sha2(edited, 256)).alias("edited_sha256"))
    none = F.lit("0000" * SAMPLES)
    whole = facts.join(made, ["b", "nr"], "left").withColumns({"f": F.coalesce("f", none), "e": F.coalesce("e", none)})
    whole = whole.withColumn("next", F.lead("f").over(Window.partitionBy("b").orderBy("nr"))).where("copy = 0")
    return whole.select(
        "doc_id", "n_chars", "edited_sha256", F.col("f").alias("fingerprint"), F.col("e").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next")).alias("near_next"),
    )
