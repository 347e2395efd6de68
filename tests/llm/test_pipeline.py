"""The pipeline's stages, one after another, on a small table."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from ledgerspark.llm.common import documents, stored

    docs = first = documents(spark, SF).cache()
    ids = {r["doc_id"] for r in docs.collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == first.columns
        docs = stored(out, f"test-{name}")
        counts.append((name, docs.count(), docs.select("doc_id").distinct().count()))
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= ids
    assert counts[0][1] >= 0.95 * len(ids) and counts[1][1] >= 0.7 * len(ids)
    assert counts[2][1] == counts[2][2] <= counts[1][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[3][2]


def test_run_against_brute_force(spark, tmp_path):
    """Rows of run() on a small odd table: what goes and stays, and whole sequences."""
    import random

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from ledgerspark.llm.encode import Encoder
    from ledgerspark.llm.queries import vocabulary
    from tests.llm.test_operators import MOTS, WORDS, brute_components, prose

    rng = random.Random(21)
    names = [f"{a}{b}" for a in WORDS for b in WORDS]
    clean = [(i, prose(rng, rng.randrange(20, 120), names), "en", f"s{i % 3}") for i in range(240)]
    clean += [(300 + i, prose(rng, rng.randrange(20, 120), [f"{a}{b}" for a in MOTS for b in MOTS]), "fr", None) for i in range(120)]
    copies = [(1000 + i, t + (" end" if i % 2 else ""), lang, s) for i, (_, t, lang, s) in enumerate(clean[:40])]
    bad = [(2000 + i, " ".join([rng.choice(names)] * 40), "en", "s1") for i in range(30)]
    odd = [(3000, None, "en", "s1"), (3001, "", None, "s1"), (3002, "12 34 !!", "fr", None), (None, None, None, None)]
    made = clean + copies + bad + odd + [clean[50], clean[50]]
    spark.createDataFrame([(*r, "extra") for r in made], "doc_id long, text string, lang string, source string, _h string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, *_ in clean[::2]] + [(i, 0, 0) for i, *_ in bad[::2]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert not ids & {i for i, *_ in bad + odd}
    # One of each group of copies: the smallest id; its copies are gone.
    component = {k: c for k, _, c in brute_components([(i, t) for i, t, *_ in clean + copies])}
    assert all(component[i] == i for i in ids)
    # What the mix must take at least once: documents of sources whose target is twice their size; all in all 1.5 words for each kept.
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    text = dict((i, t) for i, t, *_ in clean)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] <= 1024
    for places in by.values():
        assert sum(n for _, n in places) <= 1024 and [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
    times = {}
    for r in out:
        times.setdefault(r["doc_id"], []).append(r["length"])
    for i, lengths in times.items():
        n = len(enc.encode([text[i]])[0]) + 1
        assert sum(lengths) % n == 0 and 1 <= sum(lengths) // n <= 2


def test_stages_on_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
