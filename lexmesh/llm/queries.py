"""The registered queries of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.llm import (addressable, bag_search, brown, chat, common, decontaminate, language, lr_repair, neighbours, packing, rules, simhash,
                         token_counts, weak_rules)
from lexmesh.session import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def packed(documents: DataFrame) -> DataFrame:
    pieces = packing.pack(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.read(spark, sf_dir, "documents", "doc_id", "text", "source"))


@_query
def op10_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ids/{uuid.uuid4().hex}"
    addressable.write(common.read(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return addressable.read(spark, folder).select(
        F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@_query
def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = common.held_out("doc_id", 4, 2)
    model = language.fit(documents.where(~out))
    return language.identify(documents, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(rules.with_statistics(common.read(spark, sf_dir, "documents", "doc_id", "text")))
    out = common.held_out("key", 3, 1)
    model = rules.learn(table.where(~out), common.read(spark, sf_dir, "labels", "doc_id", "quality"))
    return rules.scored(table, model).select(F.col("key").alias("doc_id"), out.alias("held_out"), "score", "predicted")


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))


@_query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


@_query
def op6_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.read(spark, sf_dir, "documents", "doc_id", "text")
    out = common.held_out("doc_id", 7, 2)
    found = brown.scores(documents, documents.where(~out))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.linked(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@_query
def op11_lr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return lr_repair.report(rows, lr_repair.damaged(rows))


@_query
def op12_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.ranked(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLES["op12_bag_search"] = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
listed AS (SELECT doc_id, regexp_extract_all(translate(text, up, low), p) AS words FROM documents, pattern WHERE text IS NOT NULL),
sized AS (SELECT doc_id, len(words) AS n FROM listed WHERE len(words) > 0),
whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(words) AS term FROM listed) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, up, low), p)) AS term FROM benchmark, pattern WHERE text IS NOT NULL) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term),
scores AS (SELECT item_id, t.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN tfs t USING (term) JOIN weights USING (term) JOIN sized s ON s.doc_id = t.doc_id, whole GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""


@_query
def op13_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(weak_rules.voted(weak_rules.counted(common.read(spark, sf_dir, "documents", "doc_id", "text"))))
    found = weak_rules.judged(table, weak_rules.learn(table))
    return found.select(F.col("key").alias("doc_id"), *weak_rules.COUNTS, "base_failed", "kept", "posterior")
