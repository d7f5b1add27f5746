"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage takes what the stage before it kept. Quality, near duplicates and decontamination drop
documents; the secret scan masks secrets in the text; the last stage adds token ids. Every row is
judged by itself: ids may be null or repeat. Extra columns pass through all stages with their values,
whatever their names. Very long texts are taken whole everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import materialize, numbered, table
from lodestone.llm.decontaminate import mark_contaminated
from lodestone.llm.line_quality import score_quality
from lodestone.llm.neardup import near_duplicates
from lodestone.llm.queries import VOCABULARY
from lodestone.llm.secrets import mask_secrets
from lodestone.sources.tables import spread

ORACLE_SQL = None


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns but doc_id and text under names that no operator uses."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"held{i}_") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))


def restored(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, in its order, from a frame of :func:`apart`."""
    return [F.col(c if c in ("doc_id", "text") else f"held{i}_").alias(c) for i, c in enumerate(docs.columns)]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Each row is judged by its own text: null and
    repeated ids are no matter, a null text is one empty line, equal texts get equal scores. An empty table
    stays empty."""
    return score_quality(apart(docs), table(spark, sf_dir, "labels")).where("predicted = 1").select(*restored(docs))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one of least id, and of rows with that id (or of
    rows without id where no row of the group has one) the first. Rows whose text is null, empty or
    without words are groups of their own, repeated or not. Decisions are joined by row, so ids may be
    null or repeat; an empty table stays empty."""
    rows = numbered(apart(docs), "dedup-rows")
    found = materialize(near_duplicates(rows.select(F.col("row").alias("doc_id"), "text", "row"), row="row"), "dedup-found")
    groups = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    grouped = found.join(groups, "component_id", "left_semi").select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"))
    grouped = materialize(grouped.join(ids, "row"), "dedup-grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    kept = grouped.groupBy("component_id").agg(first.alias("row")).select("row")
    dropped = materialize(grouped.select("row").join(kept, "row", "left_anti"), "dedup-dropped")
    # texts of all sizes are shuffled once, as what is dropped follows the corpus
    return rows.join(dropped.hint("shuffle_hash"), "row", "left_anti").select(*restored(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage by the contamination rule, each judged by its own text, in the
    pass that reads it. Null and empty texts hold none; repeated rows and tied ids are no matter; an empty
    table stays empty."""
    return mark_contaminated(apart(docs), table(spark, sf_dir, "benchmark")).where("not contaminated").select(*restored(docs))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked in their text and n_chars set anew. Null texts stay null; an empty table
    stays empty."""
    return mask_secrets(docs)


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their token ids and whether decoding gives the text back; a null text is empty, an empty
    table stays empty.

    The new columns are n_tokens, ids and round_trip; where the table has such a name already, its
    column stays and the new one gets an underscore behind its name.
    """
    coded = bpe.encode_and_decode(apart(docs), VOCABULARY)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    new = {"n_tokens": F.size("ids").cast("long"), "ids": F.col("ids"), "round_trip": same}
    return coded.select(*restored(docs), *(c.alias(free_name(n, docs.columns)) for n, c in new.items()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_first_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", hide_secrets),
    ("bpe", add_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i + 1}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
