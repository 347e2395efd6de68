"""Language ID: a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's largest response in a window is kept, and a softmax over those
gives the window's languages. A text is covered by windows from end to end, and
its languages are its windows' mean, weighted by their bytes.

Training reads at most ``SAMPLE`` windows of each language (chosen by hash, each
cut at a place chosen by hash), so its cost is bounded; counts of languages
cover all rows. It is deterministic.

To reject text of no learned language (``keep_identified``), the network gets one
more class, learned from noise made of the same windows: their characters shuffled,
and random printable characters. A fifth of the windows is held out of that fit;
the bound of the noise class's share is set by them, so that learned languages stay.

Defined cases: null text and text without a letter are ``und`` with score 0;
rows without language or id are never learned from but are predicted; with no
labelled row at all every text is ``und``; repeated rows are predicted alike;
an empty table gives an empty result. Text is all that a prediction sees.
Further columns clash with nothing. The number of distinct languages is taken to be
small (``MOST_LANGUAGES``, checked): the fit is bounded by their windows.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import released, row_struct, small_arrow_batches

WINDOW, PAD, EMBED = 256, 3, 8
WIDTHS, FILTERS = (2, 3, 4), 16
#: Bound of the fit: windows of a language.
SAMPLE = 400
MOST_LANGUAGES = 1000
#: Characters of the shortest noise: shorter text can't be told from it.
SHORTEST_NOISE = 24
#: Share of the noise class that rejects a text, at least.
REJECT = 0.5
#: Share of held-out windows of learned languages that the bound lets through, at least; whole texts average many.
HELD_OUT_KEPT = 0.99
ROUNDS, RATE, BATCH = 12, 4e-3, 64
#: Windows convolved together; their patches fit a CPU cache.
TOGETHER = 32
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


class Network:
    """Parameters and passes; ``w`` holds all widths side by side, narrower filters
    padded with zeros, so a window needs one matrix product."""

    def __init__(self, n_langs: int):
        import numpy as np

        rng = np.random.default_rng(7)
        n = len(WIDTHS) * FILTERS
        self.mask = np.zeros((max(WIDTHS) * EMBED, n), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"e": f(256, EMBED, s=0.5), "w": f(*self.mask.shape, s=0.2) * self.mask, "b": np.zeros(n, np.float32), "v": f(n, n_langs, s=0.1), "c": np.zeros(n_langs, np.float32)}

    def patches(self, windows):
        """(n, WINDOW, width * EMBED): the embedded bytes from each place on."""
        import numpy as np

        x = self.p["e"][np.pad(windows, ((0, 0), (0, PAD)))]
        n, length, _ = x.shape
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, length - PAD, (PAD + 1) * EMBED), (s[0], s[1], s[2]), writeable=False)
        return np.ascontiguousarray(view)

    def pooled(self, patches):
        import numpy as np

        n, length, k = patches.shape
        z = (patches.reshape(n * length, k) @ self.p["w"]).reshape(n, length, -1)
        at = z.argmax(axis=1)
        return np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.p["b"], at

    def softmax(self, h):
        import numpy as np

        y = np.maximum(h, 0) @ self.p["v"] + self.p["c"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        return y / y.sum(axis=1, keepdims=True)

    def probabilities(self, windows):
        """Softmax of each window, without keeping the responses' places."""
        import numpy as np

        out = np.empty((len(windows), len(self.p["c"])), np.float32)
        for a in range(0, len(windows), TOGETHER):
            x = self.patches(windows[a : a + TOGETHER])
            n, length, k = x.shape
            z = (x.reshape(n * length, k) @ self.p["w"]).reshape(n, length, -1).max(axis=1)
            out[a : a + n] = self.softmax(z + self.p["b"])
        return out

    def fit(self, windows, labels) -> None:
        """Adam on cross-entropy. Only pooled places pass a gradient back."""
        import numpy as np

        rng = np.random.default_rng(11)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(ROUNDS):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                take = order[a : a + BATCH]
                x = self.patches(windows[take])
                pre, at = self.pooled(x)
                prob = self.softmax(pre)
                prob[np.arange(len(take)), labels[take]] -= 1
                prob /= len(take)
                g = {"v": np.maximum(pre, 0).T @ prob, "c": prob.sum(axis=0)}
                dh = (prob @ self.p["v"].T) * (pre > 0)
                picked = x[np.arange(len(take))[:, None], at]  # row, filter, patch
                g["w"] = np.einsum("nfk,nf->kf", picked, dh) * self.mask
                g["b"] = dh.sum(axis=0)
                back = (dh[:, :, None] * self.p["w"].T[None]).reshape(-1, EMBED)
                padded = np.pad(windows[take], ((0, 0), (0, PAD)))
                bytes_at = padded[np.arange(len(take))[:, None, None], at[:, :, None] + np.arange(PAD + 1)].reshape(-1)
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], bytes_at, back)
                step += 1
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def windows_of(raw: bytes):
    """The text's bytes as rows of WINDOW bytes, the last padded with zeros."""
    import numpy as np

    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def sampled(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> list[tuple[str, str]]:
    """(language, cut) of at most ``SAMPLE`` rows or so of each language, from rows with text, language and id."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull())
    per = rows.groupBy(F.col(lang).alias("k")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(per) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not per:
        return []
    # Keep about SAMPLE rows of each language: those whose hash lies below its share.
    point = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(1 << 40)) / float(1 << 40)
    share = F.coalesce(*[F.when(F.col(lang) == r["k"], F.lit(SAMPLE / r["n"])) for r in per])
    place = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit(2)), F.greatest(F.lit(1), F.char_length(text) - WINDOW)).cast("int") + 1
    chosen = rows.where(point < share).select(F.col(lang).alias("k"), F.col(text).substr(place, F.lit(WINDOW)).alias("cut"), point.alias("point"), F.xxhash64(text).alias("h"))
    found = chosen.orderBy("point", "h").limit(2 * SAMPLE * len(per)).collect()  # bounded: windows, not texts
    return [(r["k"], r["cut"]) for r in found if has_letter(r["cut"])]


def noise_of(cuts: list[str], seed: int = 13) -> list[str]:
    """Texts of no language: the cuts' characters shuffled, and as many random printable ones."""
    rng, out = random.Random(seed), []
    printable = [chr(c) for c in range(33, 127)] + [" "] * 12
    for cut in cuts:
        if len(cut) >= SHORTEST_NOISE:
            out.append("".join(rng.sample(cut, len(cut))))
            out.append("".join(rng.choice(printable) for _ in cut))
    return out


def first_window(text: str):
    return windows_of(text.encode("utf-8", "replace")[:WINDOW])


def train(labelled: DataFrame, reject: bool = False):
    """(languages, network, bound) from rows with text, language and id; None where there are none.

    With ``reject`` the network has one more class, of noise, and bound is the
    share of it from which a text is rejected."""
    import numpy as np

    sample = sampled(labelled)
    if not sample:
        return None
    langs = sorted({k for k, _ in sample})
    held = [r for i, r in enumerate(sample) if i % 5 == 4] if reject and len(sample) >= 10 else []
    fit = [r for i, r in enumerate(sample) if not held or i % 5 != 4]
    classes = [langs.index(k) for k, _ in fit]
    texts = [cut for _, cut in fit]
    if reject:
        # Short cuts too, so that short text of a language isn't taken for noise.
        rng = random.Random(17)
        short = [(k, cut[: rng.randint(3, 60)]) for k, cut in fit[::2]]
        short = [(k, cut) for k, cut in short if has_letter(cut)]
        noise = noise_of(texts[::2])
        classes += [langs.index(k) for k, _ in short] + [len(langs)] * len(noise)
        texts += [cut for _, cut in short] + noise
    net = Network(len(langs) + reject)
    net.fit(np.concatenate([first_window(t) for t in texts]), np.array(classes))
    bound = REJECT
    if held:
        shares = net.probabilities(np.concatenate([first_window(cut) for _, cut in held]))[:, -1]
        bound = max(bound, float(np.quantile(shares, HELD_OUT_KEPT)))
    return langs, net, bound if reject else None


def predictor(model):
    """texts -> (languages, scores), for use on executors."""
    langs, net, bound = model if model else ([], None, None)

    def predict(texts):
        import numpy as np

        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if net is None:
            return names, scores
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        a = 0
        while a < len(at):
            # About a thousand windows at once; a long text's own are all taken.
            rows, size, b = [], 0, a
            while b < len(at) and size < 1024:
                rows.append(windows_of(texts[at[b]].encode("utf-8", "replace")))
                size += len(rows[-1])
                b += 1
            windows = np.concatenate(rows)
            p = net.probabilities(windows) * (windows != 0).sum(axis=1, keepdims=True)
            starts = np.cumsum([0, *[len(r) for r in rows[:-1]]])
            total = np.add.reduceat(p, starts, axis=0)
            total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
            for i, q in zip(at[a:b], total, strict=True):
                if bound is not None and q[-1] > bound:
                    scores[i] = float(q[-1])
                else:
                    q = q[: len(langs)]
                    names[i], scores[i] = langs[int(q.argmax())], float(q.max())
            a = b
        return names, scores

    return predict


def identify(docs: DataFrame, model, *carried) -> DataFrame:
    """Carried columns, lang_pred, score."""
    small_arrow_batches(docs.sparkSession)
    predict = predictor(model)
    rows = docs.select(F.struct(*carried).alias("row"), F.col("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, scores = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])
        released()

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def held_out(id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    model = train(docs.where(~held_out()))
    return identify(docs, model, F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is identified; columns as they are.

    Rows without text or letters go, and rows whose noise share is above the bound.
    Without any row to learn from, every row goes."""
    small_arrow_batches(docs.sparkSession)
    predict = predictor(train(docs, reject=True))
    rows = docs.select(row_struct(docs), F.col("text").alias("t"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, _ = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([n != "und" for n in names], pa.bool_()))], ["row"])
        released()

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
