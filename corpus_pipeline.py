"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Every stage but the last returns the columns of its input. Null and empty texts have no
language and go in the first stage; an empty table stays empty through all of them.
Rows with a null doc_id are filtered like any other and are never duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmesh.llm import common, decontaminate, language, rules, simhash
from lexmesh.llm.queries import packed
from lexmesh.session import written

#: A text goes if the network gives no language this much; texts in two languages stay.
LEAST_LANGUAGE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognisable language go. The network learns from the labels the documents carry."""
    model = language.fit(docs.where(~common.held_out("doc_id", 4, 2)))
    return language.keep(docs, model, least=LEAST_LANGUAGE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the rules find of low quality go. The rules are learnt from the labelled documents that are still here."""
    table = written(rules.with_statistics(docs.where(~common.held_out("doc_id", 3, 1))))
    model = rules.learn(table, common.read(spark, sf_dir, "labels", "doc_id", "quality"))
    return rules.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the least doc_id, then of the least text hash; rows that share an id but not a text are decided apart."""
    return simhash.distinct(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def sequenced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the remaining documents fill."""
    return packed(docs)


STAGES = [("language", identified), ("quality", good), ("near_duplicates", distinct), ("decontamination", unseen), ("packing", sequenced)]

#: No stage can be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
