"""Quality classifier: importance resampling over hashed n-grams.

Two generative models over hashed n-grams are counted: one of target text (rows
labelled of good quality) and one of raw text (all rows). N-grams are of three
kinds: 2 and 4 bytes, and 4 consecutive marks of whether a word repeats the one
before it, which tells repetition that no n-gram of ordinary words shows. A
document's log weight is ``SHARPNESS`` times the sum, over the kinds, of the mean
log ratio of its n-grams' likelihoods, so that length does not decide. Adding
Gumbel noise to the log weights and taking the k largest draws k documents
without replacement in proportion to the weights.

The sample size k is the number of documents whose weight is not below the
``TAIL`` quantile of target text that the model has not seen: target rows are
dealt to ``FOLDS`` by a hash of their text, and each is weighed by the model of
the other folds. Weights of target-like text lie within a few units of each other,
so the noise decides which of the lowest of them are left out; other text lies
tens of units below, where no noise reaches.

The target model is fitted on at most ``SAMPLE`` labelled rows, chosen by hash;
raw counts, scores and the selection cover all rows. The k-th largest key is
found exactly by narrowing a histogram, never by gathering keys.

Defined cases: null and empty texts have no n-grams and log weight 0, like text on
the verge of the target; equal rows have equal noise and stand or fall together
(ties at the k-th key are all kept); without labelled rows, or if all of them fall
in one fold, every row is kept; an empty table gives an empty result. Labels other
than 1, or of absent ids, are not target. Further columns clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import released, row_struct, small_arrow_batches, stored
from ledgerspark.llm.words import word_hashes

BITS = 14
GRAMS = (2, 4)
#: Consecutive marks of word repetition that are one n-gram.
MARKS = 4
KINDS = len(GRAMS) + 1
#: Bound of the fit: labelled rows that the target model reads.
SAMPLE = 20_000
SHARPNESS = 20.0
TAIL = 0.002
#: Parts of the target rows, each weighed by the model of the others: the fit flatters rows it has seen.
FOLDS = 10
SMOOTHING = 0.5
#: Characters of texts whose n-grams are hashed together.
TOGETHER = 1 << 18
#: Odd multipliers of the bytes of an n-gram.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)


def grams(texts):
    """For each kind: (hashes of all n-grams of all texts, number of n-grams of each text).

    Portions of ``TOGETHER`` characters bound what is held beside the result."""
    import numpy as np

    found = [_grams(part) for part in portions(texts, TOGETHER)]
    return [tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[f[kind] for f in found], strict=True)) if found else (np.zeros(0, np.int64),) * 2 for kind in range(KINDS)]


def _grams(texts):
    import numpy as np

    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(data))  # bytes from here to the text's end
    out = []
    for n in GRAMS:
        if len(data) < n:
            out.append((np.zeros(0, np.int64), np.zeros(len(size), np.int64)))
            continue
        h = np.full(len(data) - n + 1, n * 374761393, np.uint32)
        for j in range(n):
            h = (h ^ data[j : len(data) - n + 1 + j]) * np.uint32(MULTIPLIERS[j])
        h = (h ^ (h >> np.uint32(15))) * np.uint32(MULTIPLIERS[0]) >> np.uint32(32 - BITS)
        out.append((h[left[: len(h)] >= n].astype(np.int64), np.maximum(size - n + 1, 0)))
    word, owner, count = word_hashes(texts)
    again = np.zeros(len(word), np.int64)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    marks = again.copy()
    for j in range(1, MARKS):
        marks[j:] += (again[:-j] << j) * (owner[j:] == owner[:-j])
    out.append((marks, count))
    return out


def portions(texts, chars: int = 1_000_000):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def gram_counts(docs: DataFrame, folds: int = 1):
    """Counts of all hashed n-grams of ``docs``: folds x KINDS x 2^BITS numbers.

    With more than one fold, ``docs`` has a column fold from 0."""
    import numpy as np

    small_arrow_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        total = np.zeros((folds, KINDS, 1 << BITS), np.int64)
        for batch in batches:
            of = batch.column(1).to_numpy()
            for f in range(folds):
                for part in portions(batch.column(0).filter(pa.array(of == f)).to_pylist()):
                    for kind, (h, _) in enumerate(grams(part)):
                        total[f, kind] += np.bincount(h, minlength=1 << BITS)
        fold, kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in (fold, kind, at)], pa.array(total[fold, kind, at])], ["fold", "kind", "gram", "n"])
        released()

    out = np.zeros((folds, KINDS, 1 << BITS))
    rows = docs.select("text", "fold" if folds > 1 else F.lit(0).alias("fold"))
    # At most folds x KINDS x 2^BITS numbers, whatever the corpus.
    for r in rows.mapInArrow(count, "fold int, kind int, gram int, n long").groupBy("fold", "kind", "gram").agg(F.sum("n").alias("n")).collect():
        out[r["fold"], r["kind"], r["gram"]] = r["n"]
    return out


def scorer(ratio):
    """texts -> (number of n-grams, sum over kinds of the mean log ratio) of each."""

    def score(texts):
        import numpy as np

        sizes, means = [], []
        for part in portions(texts):
            total, n = np.zeros(len(part)), np.zeros(len(part), np.int64)
            for of_kind, (h, c) in zip(ratio, grams(part), strict=True):
                sums = np.concatenate([[0], np.cumsum(of_kind[h])])
                ends = np.cumsum(c)
                total += (sums[ends] - sums[ends - c]) / np.maximum(c, 1)
                n += c
            sizes.append(n)
            means.append(total)
        return np.concatenate(sizes) if sizes else np.zeros(0, np.int64), np.concatenate(means) if means else np.zeros(0)

    return score


def noise(id: str = "doc_id", text: str = "text"):
    """Gumbel noise of a row: minus the log of an exponential, from its hash."""
    u = (F.pmod(F.xxhash64(F.col(id), F.xxhash64(text), F.lit(5)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest value of the one column of ``keys``; exact, few numbers gathered."""
    c = keys.columns[0]
    low, high, n = keys.agg(F.min(c), F.max(c), F.count(c)).first()
    inside, above = n, 0
    while inside > few and low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(c) - low) / width), F.lit(bins - 1))
        seen = sorted(keys.where(F.col(c).between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect(), key=lambda r: -r["b"])
        for r in seen:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] == inside and (r["lo"], r["hi"]) == (low, high):
            break
        low, high, inside = r["lo"], r["hi"], r["n"]
    if low == high:
        return low
    values = sorted((r[0] for r in keys.where(F.col(c).between(low, high)).collect()), reverse=True)
    return values[k - above - 1]


def fit(docs: DataFrame, labels: DataFrame):
    """(log ratio of each hashed n-gram, ratios without each fold, target rows with their fold) or None without target rows."""
    import numpy as np

    chosen = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("target_id")).distinct()
    chosen = stored(chosen.orderBy(F.xxhash64("target_id"), "target_id").limit(SAMPLE), "target-ids")
    target = docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("target_id"), "left_semi")  # SAMPLE ids at most
    target = target.select("text", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold"))
    parts, raw = gram_counts(target, FOLDS), gram_counts(docs)[0]
    t = parts.sum(axis=0)
    if not t.sum():
        return None
    share = lambda x: (x + SMOOTHING) / (x + SMOOTHING).sum(axis=-1, keepdims=True)
    ratio = lambda x: np.log(share(x)) - np.log(share(raw))
    return ratio(t), [ratio(t - p) if (t - p).any() else None for p in parts], target


def held_out_tail(target: DataFrame, ratios) -> float | None:
    """The ``TAIL`` quantile of the log weights of target rows, each by the model without its fold."""
    scores = [None if r is None else scorer(r) for r in ratios]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            of = batch.column(1).to_numpy()
            for f, score in enumerate(scores):
                if score is not None and (of == f).any():
                    n, mean = score(batch.column(0).filter(pa.array(of == f)).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(SHARPNESS * mean[n > 0])], ["w"])
        released()

    return target.mapInArrow(run, "w double").agg(F.percentile_approx("w", TAIL, 100_000)).first()[0]


def classify(docs: DataFrame, labels: DataFrame):
    """(scores written: doc_id, n_grams, log_weight, key; smallest key kept or None; score function)."""
    fitted = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), noise().alias("noise"), F.col("text").alias("t"))
    score = scorer(fitted[0]) if fitted else None

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            n, mean = score(texts) if score else (np.zeros(len(texts), np.int64), np.zeros(len(texts)))
            weight = SHARPNESS * mean
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(weight + batch.column(1).to_numpy())], ["doc_id", "n_grams", "log_weight", "key"])
        released()

    small_arrow_batches(docs.sparkSession)
    scores = stored(rows.mapInArrow(run, "doc_id long, n_grams long, log_weight double, key double"), "quality-scores")
    if not fitted:
        return scores, None, None
    floor = held_out_tail(fitted[2], fitted[1])
    k = scores.where((F.col("log_weight") >= floor) | (F.col("n_grams") == 0)).count() if floor is not None else scores.count()
    return scores, kth_largest(scores.select("key"), k) if k else None, score


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_grams, log_weight, key, keep for every row of ``docs``."""
    scores, least, _ = classify(docs, labels)
    return scores.withColumn("keep", F.lit(True) if least is None else F.col("key") >= F.lit(least))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the resampling draws; columns as they are."""
    _, least, score = classify(docs, labels)
    if least is None:
        return docs
    # The row goes as one struct, beside what the decision needs: no names clash.
    rows = docs.select(row_struct(docs), F.col("text").alias("t"), noise().alias("noise"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            _, mean = score(batch.column(1).to_pylist())
            key = SHARPNESS * mean + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(key >= least))], ["row"])
        released()

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
