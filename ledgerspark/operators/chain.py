"""Chain resolution: which blocks are walked, at which height.

``walk`` replays, over header links alone, how a reader of block files meets
blocks: a block is walked once its successor turns up; blocks that come early wait
by their parent; of two siblings the first to get a child wins; a file that ends
while siblings compete decides nothing. Headers are a few dozen bytes a block and
a chain has under a million, which is checked; ``heights`` does the plain longest
chain in joins for any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.codec import ZERO_HASH
from ledgerspark.shared import stored

MAX_HEADERS = 5_000_000


def _kept(df: DataFrame) -> DataFrame:
    return stored(df, "chain")


class _Walk:
    def __init__(self):
        self.walked, self.goal, self.tip, self.waiting = [], ZERO_HASH, None, {}

    def _emit(self, block):
        self.walked.append(block)

    def catch_up(self):
        """Walk the tip and all waiting blocks that continue it."""
        if self.goal not in self.waiting:
            return
        self._emit(self.tip)
        self.tip = None
        while (block := self.waiting.pop(self.goal, None)) is not None:
            self._emit(block)
            self.goal = block["cur"]

    def meet(self, block, following):
        if block["prev"] == self.goal:
            if self.tip is not None:
                self._emit(self.tip)
            self.goal, self.tip = block["cur"], block
            return
        self.waiting[block["prev"]] = block
        if self.tip is None or block["prev"] != self.tip["prev"]:
            return
        for child in following:  # siblings: read on until one has a child
            self.waiting[child["prev"]] = child
            if child["prev"] == self.tip["cur"]:
                return
            if child["prev"] == block["cur"]:
                self.goal, self.tip = block["cur"], block
                return


def walk(files: list[tuple[list[dict], bool]]) -> list[dict]:
    """Walked blocks in order, from (blocks with prev and cur, bytes after the last) per file."""
    state = _Walk()
    for blocks, trailing in files:
        following = iter(blocks)
        for block in following:
            state.catch_up()
            state.meet(block, following)
        if trailing:
            state.catch_up()
    return state.walked


def resolve(headers: DataFrame, profile: str = "reference") -> DataFrame:
    """block_hash, height of the main chain.

    ``reference`` replays the walk; ``standard`` takes the longest chain, tip included."""
    if profile == "standard":
        return heights(headers)
    n = headers.count()
    if n > MAX_HEADERS:
        raise ValueError(f"{n} headers; the replay takes {MAX_HEADERS}, profile 'standard' any number")
    import pyarrow as pa

    # Columns, not rows: a million headers are some 100 MB and few seconds.
    rows = headers.select("file_no", "offset", F.col("prev_hash").alias("prev"), F.col("block_hash").alias("cur"), "trailing_bytes").orderBy("file_no", "offset").toArrow()
    files: dict[int, tuple[list[dict], bool]] = {}
    for file_no, prev, cur, trailing_bytes in zip(*(rows[c].to_pylist() for c in ("file_no", "prev", "cur", "trailing_bytes")), strict=True):
        blocks, trailing = files.get(file_no, ([], False))
        blocks.append({"prev": prev, "cur": cur})
        files[file_no] = (blocks, trailing or bool(trailing_bytes))
    out = [b["cur"] for b in walk([files[k] for k in sorted(files)])]
    return headers.sparkSession.createDataFrame(pa.table({"block_hash": pa.array(out, pa.binary()), "height": pa.array(range(len(out)), pa.int64())}))


def heights(headers: DataFrame, rounds: int = 40) -> DataFrame:
    """block_hash, height on the longest chain from the zero hash, by pointer doubling.

    Ties between chains go to the tip with the smaller hash."""
    links = headers.select(F.col("block_hash").alias("b"), F.col("prev_hash").alias("p")).dropDuplicates(["b"])
    # depth: steps taken towards the root so far; p: the block reached.
    now = _kept(links.withColumn("d", F.lit(1).cast("long")))
    for _ in range(rounds):
        up = now.select(F.col("b").alias("p"), F.col("p").alias("p2"), F.col("d").alias("d2"))
        now = _kept(now.join(up, "p", "left").select("b", F.coalesce("p2", "p").alias("p"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
        if not now.join(now.select(F.col("b").alias("p")), "p", "left_semi").limit(1).count():
            break
    rooted = now.where(F.col("p") == F.lit(ZERO_HASH)).select("b", (F.col("d") - 1).alias("height"))
    best = rooted.orderBy(F.desc("height"), "b").limit(1).select("b")
    # Ancestors of the best tip, by the same doubling backwards.
    chain = best
    known = _kept(links)
    for _ in range(rounds):
        more = chain.join(known, "b").select(F.col("p").alias("b"))
        bigger = _kept(chain.union(more).distinct())
        if bigger.count() == chain.count():
            break
        chain = bigger
        known = _kept(known.alias("x").join(known.alias("y"), F.col("x.p") == F.col("y.b")).select("x.b", "y.p"))
    return rooted.join(chain, "b", "left_semi").select(F.col("b").alias("block_hash"), "height")
