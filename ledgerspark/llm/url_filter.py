"""URL filter: host and path rules, else a logistic regression on character n-grams.

The model is trained in numpy from a small labelled URL table: hashed n-grams of
the host and of the path (separate name spaces), L2-normalised, L2-penalised,
full-batch gradient descent, so training is deterministic. ``cross_validated``
gives its accuracy on hosts it has not seen. More labelled rows can be given
to ``judge_urls``; at most ``LABELS`` of them are taken.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and gets the model's verdict on no features, the bias alone (allow, as the
table has more allowed than blocked rows). Repeated rows are
judged alike, row by row; there is no shuffle with up to ``INLINE_RULES`` rules.
Rows keep their ``page_id`` whatever it is; other columns are not carried.
"""

from __future__ import annotations

import random
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import lower_ascii

BITS = 14
GRAMS = (3, 4, 5)
INLINE_RULES = 64
#: Bound of the fit: labelled rows.
LABELS = 5000
#: Probability from which a URL is blocked: a page is not dropped on a doubt.
THRESHOLD = 0.6

#: Words of the labelled URL table, made up for this purpose. A host
#: joins a word of one list with a word of the other, a path has one of its list.
BLOCKED_WORDS = (
    "casino poker roulette jackpot betting sportsbook lottery bingo porn xxx escort webcam viagra cialis steroids pharmacy "
    "warez keygen torrent cracked phishing malware ransomware popup adserver clickbait payday counterfeit replica ponzi".split(),
    "bonus royale vip deals cheap online zone hub spins winner".split(),
    "/bonus-code /spin-now /order-viagra /xxx-gallery /crack-download /click?id= /adserver/banner /payday-loan /escort-list /jackpot".split(),
)
ALLOWED_WORDS = (
    "library museum university gazette weather recipes gardening physics chemistry history geography poetry orchestra theatre "
    "hospital council parliament railway cycling hiking astronomy biology dictionary encyclopedia archive journal school college "
    "bakery carpentry knitting fishing chess football swimming architecture philosophy economics linguistics botany zoology "
    "geology medicine nursing painting sculpture photography cinema radio newspaper magazine bookshop travel museumshop "
    "software compiler database kernel mathematics statistics algebra geometry".split(),
    "city notes review guide club society institute daily world home".split(),
    "/about /articles/2019/07 /wiki/index.html /news/today /contact /index.html /lesson/12 /gallery/spring /events /papers/44.pdf".split(),
)
FRONTS = ("", "www.", "m.", "blog.")
NAMES = 500


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, blocked): each word in four hosts, with fitting and plain paths, and bad paths on plain hosts."""
    table = []
    for label, (one, two, own) in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, word in enumerate(one):
            for j, front in enumerate(FRONTS):
                other = two[(i + 3 * j) % len(two)]
                host = (f"{word}-{other}", f"{other}{word}", f"{word}{other}", word)[j]
                paths = own if j % 2 else ALLOWED_WORDS[2]
                table.append((f"{front}{host}.test", paths[(3 * i + j) % len(paths)], label))
    # Names without meaning are mostly harmless: hosts of random syllables.
    rng = random.Random(3)
    for i in range(NAMES):
        name = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        table.append((f"{FRONTS[i % 4]}{name}.test", ALLOWED_WORDS[2][i % 10], 0))
    plain = [h for h, _, label in table if not label]
    return table + [(plain[7 * i % len(plain)], p, 1) for i, p in enumerate(BLOCKED_WORDS[2])]


def features(host: str, path: str) -> list[int]:
    """Distinct hashed n-grams; a mark stands at both ends of host and path.

    A host's last label says nothing of its kind and is left out, as is www."""
    out = set()
    name = host.rpartition(".")[0].removeprefix("www.")
    for space, text in (("h", f".{name}."), ("p", f"{path} ")):
        raw = text.encode("utf-8", "surrogatepass")
        seed = zlib.crc32(space.encode())
        for n in GRAMS:
            for i in range(len(raw) - n + 1):
                out.add(zlib.crc32(raw[i : i + n], seed + n) & ((1 << BITS) - 1))
    return sorted(out)


def probability(weights, bias, feature_lists):
    """Of each list of features, that its URL is to be blocked; distinct lists are added up together."""
    import numpy as np

    size = np.array([len(f) for f in feature_lists], np.int64)
    flat = np.fromiter((x for f in feature_lists for x in f), np.int64, int(size.sum()))
    sums = np.concatenate([[0], np.cumsum(weights[flat], dtype=np.float64)])
    ends = np.cumsum(size)
    return 1 / (1 + np.exp(-((sums[ends] - sums[ends - size]) / np.sqrt(np.maximum(size, 1)) + bias)))


def train(table, rounds: int = 1500, rate: float = 16.0, penalty: float = 1e-4):
    """(weights, bias) of the logistic regression."""
    import numpy as np

    table = table[:LABELS]
    lists = [features(host, path) for host, path, _ in table]
    # Only features that occur have a column.
    used, at = np.unique(np.concatenate([np.array(f, np.int64) for f in lists]), return_inverse=True)
    x = np.zeros((len(table), len(used)), np.float32)
    size = [len(f) for f in lists]
    x[np.repeat(np.arange(len(table)), size), at] = np.repeat(1 / np.sqrt(size), size)
    y = np.array([label for _, _, label in table], np.float32)
    w, b = np.zeros(len(used), np.float32), np.float32(0)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ g / len(y) + penalty * w)
        b -= np.float32(rate * 0.1) * g.mean()
    out = np.zeros(1 << BITS)
    out[used] = w
    return out, float(b)


def cross_validated(table, folds: int = 5) -> tuple[float, float]:
    """(share of blocked rows found, share of allowed rows left alone), each row judged without its fold."""
    import numpy as np

    right = {0: [], 1: []}
    for k in range(folds):
        weights, bias = train([r for i, r in enumerate(table) if i % folds != k])
        rest = [r for i, r in enumerate(table) if i % folds == k]
        for (_, _, label), p in zip(rest, probability(weights, bias, [features(h, u) for h, u, _ in rest]), strict=True):
            right[label].append((p >= THRESHOLD) == label)
    return float(np.mean(right[1])), float(np.mean(right[0]))


def url_parts(url):
    """(host, path) columns: host between the first :// and / ? # or the end, A-Z
    lower-cased; path from there to ? # or the end."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return lower_ascii(part(r"(?s)^.*?://([^/?#]*)")), part(r"(?s)^.*?://[^/?#]*([^?#]*)")


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add rule and rule_verdict of the longest fitting (verdict, host, path) rule."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    host, path = F.col("host"), F.col("path")
    if len(ranked) <= INLINE_RULES:
        fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
        pick = lambda say: F.coalesce(*[F.when(f, F.lit(say(r))) for f, r in zip(fits, ranked, strict=True)], F.lit(None).cast("string"))
        return urls.withColumns({"rule": pick(lambda r: r[1] + r[2]), "rule_verdict": pick(lambda r: r[0])})
    # Many rules: each distinct host meets the rules of its suffixes, then its pages meet that list.
    spark = urls.sparkSession
    table = spark.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(ranked)], "v string, suffix string, p string, o int")
    suffixes = urls.select("host").distinct().selectExpr("host", "explode(transform(sequence(1, size(split(host, '[.]'))), x -> substring_index(host, '.', -x))) AS suffix")
    lists = suffixes.join(table, "suffix").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("o", "p", F.concat("suffix", "p").alias("r"), "v"))).alias("fits"))
    met = urls.join(lists, "host", "left").withColumn("best", F.expr("get(filter(fits, x -> startswith(path, x.p)), 0)"))
    return met.withColumns({"rule": F.col("best.r"), "rule_verdict": F.col("best.v")}).drop("best", "fits")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id: str = "page_id", url: str = "url", threshold: float = THRESHOLD, labelled=None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every row of ``pages``.

    ``labelled``: (host, path, 1 for block) rows to train from; the built-in table if None."""
    weights, bias = train(labelled_urls() if labelled is None else labelled)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            # Hosts repeat, and so do pairs: each distinct one has its features made once a batch.
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            known = {x: i for i, x in enumerate(dict.fromkeys(pairs))}
            p = probability(weights, bias, [features(h, u) if h or u else [] for h, u in known])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[np.array([known[x] for x in pairs], np.int64)])], [*batch.schema.names, "p_block"])

    host, path = url_parts(F.col(url))
    parts = with_rule(pages.select(F.col(id).cast("long").alias("page_id"), host.alias("host"), path.alias("path")), rules)
    parts = parts.select("page_id", "host", "path", "rule", "rule_verdict")
    judged = parts.mapInArrow(score, "page_id long, host string, path string, rule string, rule_verdict string, p_block double")
    model = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", model).alias("verdict"), "p_block")
