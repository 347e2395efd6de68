"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return rows with the columns of ``documents``. ``run`` writes each stage's rows as
Parquet to the shared folder and rereads them as the next stage's ``docs``; a
stage's input is removed once its output is written.

Defined cases, for every stage: an empty table gives an empty result; further
columns are carried, whatever their names, by all stages but the last; rows that
repeat an id or a whole row are rows like others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm.common import documents, dropped, stored
from ledgerspark.llm.language import keep_identified
from ledgerspark.llm.mixing import mixed_documents
from ledgerspark.llm.packing import pack
from ledgerspark.llm.quality import keep_quality
from ledgerspark.llm.queries import vocabulary
from ledgerspark.llm.shingle_join import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: null and empty texts, texts
    without letters, and texts that are more like noise than like any language."""
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resampling towards good labelled text doesn't draw go.

    Without labelled good rows all stay; equal rows stay or go together."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id.

    Texts without words are near nothing and stay."""
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0, 1 or 2 times.

    Rows without source are a source of their own; texts without words stay once."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences.

    Null and empty texts are one piece with the end id."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), 2)


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Language ID and quality are trained models that SQL can't express; tests hold the rows of every other stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
