"""A corpus from documents to training sequences: quality rules, language, near duplicates, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import language_id, ngram_join, quality_rules
from folioscope.llm.common import fresh_name, remove, removed_at_exit, shared_dir, table
from folioscope.llm.packing import pack

#: A language below this share of the likelihood is no decision.
LEAST_SCORE = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; references are learnt from all documents."""
    rules, mark = fresh_name(docs, "rules"), fresh_name(docs, "mark")
    # a column that differs by row keeps the filter above the rules; below, it would be spelt out anew at each step
    judged = quality_rules.measure(docs, quality_rules.learn(docs), rules).withColumn(mark, F.monotonically_increasing_id())
    return judged.where(F.col(rules)["kept"] & (F.col(mark) >= 0)).drop(rules, mark)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters or without a clear language go; a null lang is filled in."""
    pred, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "lang_score")
    out = language_id.with_prediction(docs, language_id.train(docs), pred, score)
    return out.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).withColumn("lang", F.coalesce("lang", pred)).drop(pred, score)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity of 0.8 or more."""
    return ngram_join.one_of_each_group(docs, 5, 80, 100)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length; nothing is left out."""
    return pack(docs)


STAGES = [
    ("quality rules", keep_good),
    ("language id", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    A stage's table goes once the next one is written; that of the last but one, which the result is made from, goes with the
    application. Null texts have no words and fail the quality rules, as do empty ones; texts are read whole, of any length;
    repeated rows are one group of near duplicates; of equals the smallest doc_id stays. Extra columns are carried to the last
    stage, whatever their names. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            removed_at_exit(spark, f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: Language, similarity groups and tokens are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None
