"""Mix sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are shuffled (by a hash of seed and id) and laid end to
end, twice in a row; the first words of that line, as many as the source's target
says, are cut into blocks of equal length, only the last of which may be shorter.
A slot of the schedule takes one block. The slots of all sources stand side by
side, so their cumulative counts are the cumulative weights; slot k of the
schedule has the k-th golden-ratio point of that line and goes to the source whose
stretch holds the point. The points of 2^m slots are a permutation (an odd step
near 2^m / golden ratio), so every source gets exactly its slots, spread evenly;
points beyond the line are skipped. The n-th slot of a source takes its n-th block.
So each source's words taken are its target, rounded, however small it is.

A hot source costs no more than its rows: positions within a source are found
from sums of (source, hash bucket), ranks of slots from counts of (source, slot
chunk); only those sums are windowed by source. Rows that repeat an id are laid
from sums of (id, input chunk).

Defined cases: null text has size 0; a null source is a source of its own, last
in order; sources without words and an empty table take nothing (every row is
returned with taken 0); rows that repeat an id are laid side by side, and each
row is returned with what is taken of it. Further columns clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import row_struct, stored

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (1 + 5**0.5) / 2
#: Weights of sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all words: numerator, denominator.
SHARE = (3, 2)
#: At most so many times is a source taken.
PASSES = 2
BLOCK_WORDS = 1024
#: Bits of a document's place in its source's shuffled order; the upper ones are its bucket.
KEY_BITS, BUCKET_BITS = 60, 10
CHUNK_SLOTS = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, words (the target rounded), nr (place in order) from source, source_size.

    Targets share ``SHARE`` of all words by weight, stop at ``PASSES`` times the
    source's size, and the excess is reshared by weight until none is above. That
    fixpoint fills sources in the order of size / weight: the first ones up to
    their limit, the others share the rest. One row per source throughout."""
    num, den = SHARE
    weights = ", ".join(map(str, WEIGHTS))
    return sizes.sparkSession.sql(
        f"""
        WITH ranked AS (
          SELECT source, source_size, element_at(array({weights}), CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1 AS INT)) AS weight,
                 row_number() OVER (ORDER BY source IS NULL, source) AS nr FROM {{sizes}}),
        sums AS (
          SELECT *, {num} * sum(source_size) OVER () AS goal, sum(weight) OVER () AS all_weight,
                 coalesce(sum(source_size) OVER (ORDER BY source_size / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sizes_before,
                 coalesce(sum(weight) OVER (ORDER BY source_size / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before
          FROM ranked),
        filled AS (
          SELECT *, {PASSES * den} * CAST(source_size AS DECIMAL(19,0)) * CAST(all_weight - weights_before AS DECIMAL(15,0)) <= weight * CAST(goal - {PASSES * den} * sizes_before AS DECIMAL(19,0)) AS full FROM sums),
        rest AS (
          SELECT *, sum(IF(full, source_size, 0)) OVER () AS full_sizes, sum(IF(full, weight, 0)) OVER () AS full_weights FROM filled),
        targets AS (
          SELECT source, source_size, weight, nr,
                 CASE WHEN full THEN CAST({PASSES} * source_size AS DOUBLE)
                      ELSE CAST(weight * (goal - {PASSES * den} * full_sizes) AS DOUBLE) / ({den} * (all_weight - full_weights)) END AS target
          FROM rest)
        SELECT source, source_size, weight, target, CAST(round(target) AS BIGINT) AS words, nr FROM targets""",
        sizes=sizes,
    )


def golden_step(bits: int) -> int:
    """The odd number nearest to 2^bits / golden ratio: its multiples permute 2^bits points."""
    return int((1 << bits) / GOLDEN / 2) * 2 + 1


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, rank (from 0, of the source's slots): the low-discrepancy order.

    Stretches are found by an equality join on cells of the line of slots, each
    cell listing the few stretches that meet it."""
    spark = targets.sparkSession
    lines = spark.sql(f"SELECT source, own, sum(own) OVER (ORDER BY nr) - own AS low FROM (SELECT source, nr, (words + {block - 1}) div {block} AS own FROM {{targets}})", targets=targets)
    lines = stored(lines, "mix-stretches")  # one row per source
    n, slots = lines.agg(F.count("*"), F.coalesce(F.sum("own"), F.lit(0))).first()
    bits = max(1, (slots - 1).bit_length())
    step, cut = golden_step(bits), 1 << 17
    # k * step mod 2^bits in two parts, so that no product leaves 63 bits.
    point = f"((id % {cut}) * {step} + ((id div {cut}) * {step} % {max(1, (1 << bits) // cut)}) * {cut}) % {1 << bits}"
    cells = 1 << max(1, n.bit_length() + 2)
    width = max(1, -(-slots // cells))
    stretches = lines.where("own > 0").select("source", "low", (F.col("low") + F.col("own")).alias("high"))
    stretches = stretches.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    points = spark.range(1 << bits if slots else 0).select(F.col("id").alias("slot"), F.expr(point).alias("point")).where(F.col("point") < slots)
    met = points.withColumn("cell", F.expr(f"point div {width}")).join(F.broadcast(stretches) if n <= 100_000 else stretches, "cell")
    dealt = met.where("low <= point AND point < high").select("slot", "source", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    return spark.sql(
        """
        WITH before AS (SELECT source, chunk, sum(n) OVER (PARTITION BY source ORDER BY chunk) - n AS before FROM (SELECT source, chunk, count(*) AS n FROM {dealt} GROUP BY source, chunk)),
             inside AS (SELECT *, row_number() OVER (PARTITION BY source, chunk ORDER BY slot) - 1 AS nr FROM {dealt})
        SELECT a.slot, a.source, b.before + a.nr AS rank FROM inside a JOIN before b ON a.source <=> b.source AND a.chunk = b.chunk""",
        dealt=dealt,
    )


def sized(docs: DataFrame, *more) -> DataFrame:
    """rid, doc_id, source, size, key, bucket: narrow rows that the mix works on."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.concat(F.lit("mix-0-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), key.alias("key"), *more)
    return rows.withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS).cast("int"))


def laid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, placed) of rows as ``sized`` gives them, already written; placed: rows with start."""
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    placed = rows.sparkSession.sql(
        """
        WITH ids AS (SELECT source, bucket, key, shiftright(rid, 33) AS chunk, sum(size) AS n FROM {rows} GROUP BY source, bucket, key, shiftright(rid, 33)),
             offsets AS (SELECT source, bucket, sum(n) OVER (PARTITION BY source ORDER BY bucket) - n AS ahead FROM (SELECT source, bucket, sum(size) AS n FROM {rows} GROUP BY source, bucket)),
             starts AS (SELECT *, sum(n) OVER (PARTITION BY source, bucket ORDER BY key, chunk ROWS UNBOUNDED PRECEDING) - n AS before FROM ids),
             inner_ AS (SELECT *, shiftright(rid, 33) AS chunk, sum(size) OVER (PARTITION BY source, bucket, key, shiftright(rid, 33) ORDER BY rid ROWS UNBOUNDED PRECEDING) - size AS within FROM {rows})
        SELECT i.rid, i.doc_id, i.source, i.size, i.within + s.before + o.ahead AS start
        FROM inner_ i JOIN starts s ON i.source <=> s.source AND i.bucket = s.bucket AND i.key = s.key AND i.chunk = s.chunk
        JOIN offsets o ON i.source <=> o.source AND i.bucket = o.bucket""",
        rows=rows,
    )
    return targets, placed


def small_side(targets: DataFrame) -> DataFrame:
    """Targets to join with rows; broadcast only if they are few."""
    small = targets.select(F.col("source").alias("s"), "source_size", "target", "words")
    return F.broadcast(small) if targets.count() <= 100_000 else small


def mix(rows: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, placed, pieces) of rows as ``sized`` gives them, already written.

    placed: rows with start (their place on the source's line); pieces: slot, rid,
    doc_id, word_from, word_to (words of the document the slot takes), in the
    order of slots the training stream."""
    targets, placed = laid(rows)
    small = small_side(targets)
    on_line = placed.where("size > 0").join(small, F.expr("source <=> s"))
    # Where the document stands on the line, in each pass the target reaches.
    stands = on_line.withColumn("at", F.explode(F.expr("filter(array(start, start + source_size), x -> x < words)")))
    cut = stands.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(least(at + size, words) - 1) div {block}"))))
    pieces = schedule(targets, block).alias("a").join(cut.alias("b"), F.expr("a.source <=> b.source AND a.rank = b.block")).selectExpr(
        "slot", "rid", "doc_id", f"greatest(b.block * {block} - at, 0) AS word_from", f"least((b.block + 1) * {block} - at, words - at, size) AS word_to"
    )
    return targets, placed, pieces


def taken_words(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(targets; rid, taken)."""
    targets, _, pieces = mix(rows, block)
    return targets, pieces.groupBy("rid").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))


def mix_report(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    rows = stored(sized(docs), "mix-rows")
    targets, taken = taken_words(rows, block)
    out = rows.join(small_side(targets), F.expr("source <=> s")).join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix in whole documents; columns as they are, whatever their names.

    A row is repeated as often as the mix takes its words, to the nearest whole
    number: 0, 1 or 2 times, so a source misses its target by half a document at
    most. Rows without words are kept once. Rows of equal id and text share what is
    taken of them."""
    rows = stored(sized(docs, F.xxhash64("text").alias("h")), "mix-rows")
    _, taken = taken_words(rows.drop("h"), block)
    per_row = rows.select("rid", "doc_id", "h", "size").join(taken, "rid", "left")
    times = per_row.groupBy("doc_id", "h").agg(F.sum("size").alias("size"), F.sum(F.coalesce("taken", F.lit(0))).alias("taken"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    times = times.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), copies.alias("times")).where("times > 0")
    met = docs.select(row_struct(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    met = met.join(times, F.col("id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
