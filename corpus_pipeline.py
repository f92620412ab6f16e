"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run writes it to the shared folder
and reads it back as the next one's docs. All but the last return the columns of documents.

quality: rows that the rule ensemble, fitted on all labels, predicts to be good stay.
language: rows with a letter and a language of score 0.5 or more stay.
near_duplicates: one row of each group of copies and near copies (five words, 0.8) stays.
decontamination: rows that hold no benchmark item within its error budget stay.
packing: what is left, as pieces of sequences.

Null texts have no quality of their own (the model decides on zeros), no language, and so go in
the second stage at the latest. An empty table gives an empty table of the same columns. Very long
texts are read whole by every stage, and packed whole. Repeated rows are copies: one of them stays.
Columns besides those of documents stay up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import langid, leaks, near, packing, quality
from cloakframe.llm.common import prepare, stored, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.accepted(docs, model)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = langid.train(docs, F.lit(True), langid.vocabulary())
    return langid.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    name = unused(docs, "leaks")
    found = leaks.with_leaks(docs, table(spark, sf_dir, "benchmark"), column=name)
    return found.filter(F.size(name) == 0).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage of these is expressible in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
