"""Licence scan: positional rare-token index, in DataFrame functions only.

Every whole text is lower-cased (A-Z) and cut into words. Words of the licence
vocabulary (all templates' and phrases' words that are not common) are kept as
hits: position, word number, and which phrases the text has in place around it.
The table of hits is small and is written once. Document frequencies of the
licence words over all documents give their IDF. Then

* a phrase is looked up by its highest-IDF word: each hit of that word that has
  the whole phrase around it is one place;
* a template's postings are met by every hit; hits whose (position - template
  position) agree vote for one alignment. A file is a candidate for a template if
  it has the highest-IDF word of the template's mandatory key phrase; without it
  no alignment could be accepted. An alignment is accepted if all words of the
  key phrase stand in their places and at least ``least`` of the template's
  indexed words do. Nothing is capped: a file may have any number of notices.

Defined cases: null and empty texts have no words, no places, empty labels and
score 0; repeated rows get a result each; very long texts cost in proportion to
their length (hits are grouped by alignment, never paired, and a hit is a few
numbers whatever stands around it); an empty table gives an empty result. Other
columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import lower_ascii, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Opening words of public licence notices, the mandatory key phrase, the label.
TEMPLATES = [
    ("licensed under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    ("gnu general public license as published by the free software foundation", "general public license", "gpl"),
    ("gnu lesser general public license as published by the free software foundation", "lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", "bsd"),
    ("this work is licensed under cc by nc 4 0", "licensed under cc by nc", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution license", "creative commons attribution", "cc-by"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute", "isc"),
    ("this is free and unencumbered software released into the public domain", "unencumbered software released", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "no part of this publication", "all-rights-reserved"),
]
#: Words too common to be indexed for templates.
COMMON = set("a all and any are as by for in is may no not of or out part person source the this to use with work be on that it from you your under 0 4".split())


def _index():
    """Per template its words' places (common words left out) and the key phrase's places."""
    out = []
    for text, key, label in TEMPLATES:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        places = [(i, w) for i, w in enumerate(words) if w not in COMMON]
        out.append((places, {i for i, _ in places if at <= i < at + len(phrase)}, label))
    return out


def vocabulary_of(phrases) -> list[str]:
    """Words that are indexed; a phrase of common words alone is indexed by all of them."""
    words = {w for text, *_ in TEMPLATES for w in text.split()} - COMMON
    for text, _ in phrases:
        own = set(text.split())
        words |= own - COMMON or own
    return sorted(words)


def quoted(words) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def licence_hits(docs: DataFrame, phrases) -> DataFrame:
    """rid, doc_id, n_words, hits (i, w, ph): one row per document; reads each text once.

    w is a word's number in the vocabulary; ph has number * 64 + place of each
    phrase that stands around the hit, the hit at that place."""
    lower = F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), f"\\A{SEPARATORS}|{SEPARATORS}\\z", "")
    vocabulary = vocabulary_of(phrases)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(lower, SEPARATORS).alias("words"))
    around = []
    for n, (text, _) in enumerate(phrases):
        parts = text.split()
        for j, w in enumerate(parts):
            if w in vocabulary:
                around.append(f"IF(words[i] = {quoted([w])} AND i >= {j} AND slice(words, i + 1 - {j}, {len(parts)}) = array({quoted(parts)}), {n * 64 + j}, -1)")
    phrased = quoted(sorted({w for text, _ in phrases for w in text.split()} & set(vocabulary)))
    stands = f"IF(words[i] IN ({phrased}), filter(array({', '.join(around)}), x -> x >= 0), CAST(array() AS array<int>))" if around else "CAST(array() AS array<int>)"
    return words.selectExpr(
        "monotonically_increasing_id() AS rid",
        "doc_id",
        "CAST(IF(size(words) = 1 AND words[0] = '', 0, size(words)) AS BIGINT) AS n_words",
        f"""transform(filter(transform(words, (w, i) -> IF(w IN ({quoted(vocabulary)}), i, -1)), i -> i >= 0),
            i -> struct(i AS i, CAST(array_position(array({quoted(vocabulary)}), words[i]) - 1 AS INT) AS w, {stands} AS ph)) AS hits""",
    )


def scan_licences(docs: DataFrame, phrases=None, least: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``phrases``: (words in lower case parted by spaces, at most 64; label)."""
    phrases = PHRASES if phrases is None else phrases
    if any(not 0 < len(text.split()) <= 64 for text, _ in phrases):
        raise ValueError("a phrase has 1 to 64 words")
    vocabulary = vocabulary_of(phrases)
    number = {w: i for i, w in enumerate(vocabulary)}
    files = stored(licence_hits(docs, phrases), "licence-hits")
    some = files.where(F.size("hits") > 0).select("rid", "hits")
    total = max(1, files.count())
    seen = some.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count()
    df = {vocabulary[r["w"]]: r["count"] for r in seen.collect()}  # at most the vocabulary
    idf = lambda w: math.log((total + 1) / (df.get(w, 0) + 1))

    # Phrases: all hits of the rarest word that have the phrase around them.
    checks = []
    for n, (text, _) in enumerate(phrases):
        words = text.split()
        lead = max((w for w in words if w in number), key=lambda w: (idf(w), w))
        at = words.index(lead)
        checks.append(f"transform(filter(hits, h -> h.w = {number[lead]} AND array_contains(h.ph, {n * 64 + at})), h -> CAST(h.i - {at} AS BIGINT))")
    labels = [label for _, label in phrases]
    no_places = "CAST(array() AS array<bigint>)"
    places = some.selectExpr("rid", *[f"{c} AS p{i}" for i, c in enumerate(checks)])
    names = ", ".join([no_places, *[f"p{i}" for i in range(len(checks))]])
    found = ", ".join(["CAST(array() AS array<string>)", *[f"IF(size(p{i}) > 0, array({quoted([labels[i]])}), CAST(array() AS array<string>))" for i in range(len(checks))]])
    base = places.selectExpr("rid", f"concat({names}) AS places", f"array_sort(array_distinct(concat({found}))) AS base").where("size(places) > 0")

    # Templates: votes of hits for alignments, in files that have the rarest word of the key phrase.
    index = _index()
    leads = [max((w for i, w in places_ if i in key), key=lambda w: (idf(w), w)) for places_, key, _ in index]
    postings = [(w, t, i, i in key) for t, (places_, key, _) in enumerate(index) for i, w in places_]
    table = ", ".join(f"({number[w]}, {t}, {i}, {str(k).lower()}, {number[leads[t]]})" for w, t, i, k in postings)
    spark = docs.sparkSession
    posts = spark.sql(f"SELECT * FROM VALUES {table} AS p(w, t, p, is_key, lead)")
    hits = some.selectExpr("rid", "array_distinct(hits.w) AS has", "explode(hits) AS h").selectExpr("rid", "has", "h.i AS i", "h.w AS w")
    votes = hits.join(F.broadcast(posts), "w").where("array_contains(has, lead)").groupBy("rid", "t", F.expr("i - p").alias("offset"))
    votes = votes.agg(F.count("*").alias("n"), F.count_if("is_key").alias("keys"))
    sizes = ", ".join(f"({t}, {len(pl)}, {len(key)}, '{label}')" for t, (pl, key, label) in enumerate(index))
    of = spark.sql(f"SELECT * FROM VALUES {sizes} AS s(t, n_words, n_keys, label)")
    met = votes.join(F.broadcast(of), "t").where(f"keys = n_keys AND n >= {least} * n_words")
    own = met.groupBy("rid").agg(F.collect_set("label").alias("own"), F.max(F.col("n") / F.col("n_words")).alias("part"))

    none = F.expr("CAST(array() AS array<string>)")
    out = files.select("rid", "doc_id", "n_words").join(base.join(own, "rid", "full"), "rid", "left")
    joined = lambda c: F.array_join(c, ",")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        joined(F.coalesce("base", none)).alias("base_labels"),
        joined(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("own", none)))).alias("labels"),
        F.when(F.col("places").isNotNull(), 1.0).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )
