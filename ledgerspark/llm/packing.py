"""Best-fit packing by minimum bin slack.

Whole texts are encoded and cut into pieces of at most ``size`` tokens (a
document's first piece is the shorter one). Packing needs only how many pieces
there are of each length, at most ``size`` numbers whatever the corpus. Per bin
the largest length left is fixed, and a bitset subset-sum programme over the
available lengths finds the fullest feasible combination; that combination is
taken as often as the counts allow and removed. Pieces of a length are then
numbered in parallel, and their number tells combination, bin and place.

Defined cases: null and empty texts are one piece with the end id alone;
repeated rows are packed each; equal lengths are interchangeable and go in file
order; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import released, small_arrow_batches, stored
from ledgerspark.llm.encode import encoder, portions

SIZE = 1024


def cut_lengths(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of n tokens; only the first may be shorter than ``size``."""
    return ([n % size] if n % size else []) + [size] * (n // size)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within capacity.

    Bit s of ``reach`` says that sum s can be made of the lengths so far; the
    bitsets after each multiple are kept, to walk back from the best sum."""
    steps, reach, limit = [], 1, (1 << (capacity + 1)) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, many = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            many *= 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each of them), until no piece is left."""
    left, out = dict(counts), []
    while left:
        top = max(left)
        left[top] -= 1
        rest = {k: n for k, n in left.items() if n > 0}
        found = fullest(rest, size - top) if top < size else {}
        left[top] += 1
        found[top] = found.get(top, 0) + 1
        times = min(left[k] // n for k, n in found.items())
        out.append((times, [k for k in sorted(found, reverse=True) for _ in range(found[k])]))
        for k, n in found.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def encoded_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: narrow rows, one per piece."""
    small_arrow_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions(texts):
                out = []
                for doc, own in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    raw = own.tobytes() + end
                    start = 0
                    for i, n in enumerate(cut_lengths(len(raw) // 4, size)):
                        out.append((doc, i, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])))
                        start += n
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])
        released(vocabulary)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to written pieces with columns pid and length."""
    import numpy as np

    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    # For each length: from which number on, in which bins (first, pieces each) and at which offset.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used, bins = dict.fromkeys(counts, 0), 0
    for times, lengths in plan(counts, size):
        at = 0
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            runs.setdefault(length, []).append((used[length], bins, each, at))
            used[length] += times * each
            at += each * length
        bins += times
    table = {k: np.array(v, np.int64) for k, v in runs.items()}

    # Number the pieces of a length: counts of (length, chunk of rows) first, then inside.
    pieces = pieces.withColumn("chunk", F.shiftright("pid", 33))
    numbered = spark.sql(
        """
        WITH sums AS (SELECT length, chunk, count(*) AS n FROM {pieces} GROUP BY length, chunk),
             ahead AS (SELECT length, chunk, sum(n) OVER (PARTITION BY length ORDER BY chunk) - n AS before FROM sums),
             inside AS (SELECT *, row_number() OVER (PARTITION BY length, chunk ORDER BY pid) - 1 AS nr FROM {pieces})
        SELECT i.doc_id, i.piece, i.start, i.length, i.ids_crc32, a.before + i.nr AS nr
        FROM inside i JOIN ahead a ON i.length = a.length AND i.chunk = a.chunk""",
        pieces=pieces,
    )

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, nr = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(nr), np.int64), np.zeros(len(nr), np.int64)
            for k in np.unique(length):
                rows, t = np.flatnonzero(length == k), table[int(k)]
                run = t[np.searchsorted(t[:, 0], nr[rows], side="right") - 1]
                inside = nr[rows] - run[:, 0]
                sequence[rows] = run[:, 1] + inside // run[:, 2]
                offset[rows] = run[:, 3] + inside % run[:, 2] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = encoded_pieces(docs, vocabulary, end_id, size).withColumn("pid", F.monotonically_increasing_id())
    return assign(stored(pieces, "pieces"), size)
