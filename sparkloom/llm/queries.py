"""The pN_ queries of the problems tagged llm, and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import knn, lang, leak, mix, names, ocr, split
from sparkloom.session import table


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lang.label_segments(docs, lang.train(docs))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return lang.label_documents(p9_segments(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lang.found(p9_segments(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_sections(table(spark, d, "sections"), table(spark, d, "chunks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.found(p1_pieces(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = knn.nearest(table(spark, d, "doc_cards"), "card_id", "embedding")
    return n.select(F.col("key_a").alias("card_id"), F.col("key_b").alias("neighbour_id"), "cosine")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "doc_cards")
    pairs = knn.similar_pairs(knn.nearest(cards, "card_id", "embedding"), cards, "card_id", "embedding", 0.9)
    return pairs.select(F.col("key_a").alias("card_id_a"), F.col("key_b").alias("card_id_b"))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.clean(table(spark, d, "sections"), table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.found(p4_text(spark, d))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.resolve(table(spark, d, "entities")).select(F.col("key").alias("entity_id"), F.col("tenant").alias("tenant_id"), "name", "cluster")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = names.linked_pairs(names.resolve(table(spark, d, "entities")))
    return pairs.select(F.col("key_a").alias("entity_id_a"), F.col("key_b").alias("entity_id_b"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_spans(spark, d).select("doc_id", "item_id").distinct()


QUERIES = {"p4_found": p4_found, "p4_text": p4_text, "p6_found": p6_found, "p6_entities": p6_entities, "p1_found": p1_found, "p1_pieces": p1_pieces, "p8_mix": p8_mix, "p8_shares": p8_shares, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p7_found": p7_found, "p7_spans": p7_spans, "p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents}
ORACLE = {"p1_found": "SELECT DISTINCT section_id FROM sections WHERE length(text) > 3000"}
