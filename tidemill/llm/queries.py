"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_RULES, find_secrets

    base = [r.kind for r in BASE_RULES]
    found = find_secrets(table(spark, sf_dir, "documents"))
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [_count_of(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_joined(own).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["stop"] - h["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from .common import shared_dir
    from .token_files import read_token_files, write_token_files

    path = f"{shared_dir(spark)}/tidemill-tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    found = derivatives(responses(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\r\n")
    return found.select(F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", "content_length", headers.alias("headers"), F.col("block").cast("string").alias("content"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_decontamination": op3_decontamination,
        "op4_packing": op4_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_files": op6_token_files,
        "op7_simhash": op7_simhash,
        "op8_line_dedup": op8_line_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_warc": op10_warc,
        "op11_clustering": op11_clustering,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import OP3, OP8, OP12, OP13, op5, op11

    return {"op3_decontamination": OP3, "op5_quality_rules": op5(), "op8_line_dedup": OP8, "op11_clustering": op11(), "op12_embedding_dedup": OP12, "op13_hard_negatives": OP13}
