"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import spread

from . import bpe, fim, hmm, licenses, merkle, quality_rules, recompression, secrets
from .common import table
from .decontaminate import decontaminate
from .line_quality import score_quality
from .neardup import near_duplicates
from .token_counts import count_tokens
from .toxicity import score_toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores where they lie in few files."""
    return spread(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.drop("text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), VOCABULARY)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.drop("text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir), VOCABULARY)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summarize(secrets.find_secrets(documents(spark, sf_dir)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "near_ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text")))
    digests = (F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    proved = merkle.manifest(docs, offered=merkle.without_newlines(docs))
    return merkle.audit(proved, "offered").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity,
        op2_token_counts,
        op3_quality_classifier,
        op4_bpe,
        op5_license_scan,
        op6_near_duplicates,
        op7_language_model,
        op8_secret_scan,
        op9_decontaminate,
        op10_quality_rules,
        op11_fill_in_middle,
        op12_substring_dedup,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_license_scan": licenses.oracle(),
        "op10_quality_rules": quality_rules.ORACLE,
        "op11_fill_in_middle": fim.ORACLE,
        "op12_substring_dedup": recompression.ORACLE,
        "op13_merkle_manifest": merkle.oracle(),
    }
