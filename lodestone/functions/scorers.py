"""Scorers by name: each turns rows into the same few columns, so they can be exchanged and compared.

A scorer is a function of a frame (item_id and what the scorer reads) that gives item_id, score (0 to 5),
scoreable and error. The rule is common to all: what can't be judged has a null score, what was judged and
failed has 0, and ``passed`` is null without a score.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuzzy, phones
from . import stats as s
from . import text as x

PASS = 4.0  # fixed value: the least passing score
MISMATCH = 3.853  # fixed value: the distance for each sound at which the score is 0

SCORERS: dict[str, Callable[..., DataFrame]] = {}


def register_scorer(name: str, scorer: Callable[..., DataFrame]) -> None:
    SCORERS[name] = scorer


def available_scorers() -> list[str]:
    return sorted(SCORERS)


def build_scorer(name: str, **options) -> Callable[[DataFrame], DataFrame]:
    """The scorer with its options; an unknown name is an error before any work."""
    if name not in SCORERS:
        raise KeyError(f"unknown scorer {name}; known: {', '.join(available_scorers())}")
    return partial(SCORERS[name], **options)


def judged(rows: DataFrame, score: Column, missing: Column, failed: Column | None = None) -> DataFrame:
    """item_id, score, scoreable, error, passed: ``missing`` (a text, or null) makes a row unscoreable, a
    failed one scores 0."""
    value = F.when(missing.isNull(), F.when(F.coalesce(failed, F.lit(False)), 0.0).otherwise(score) if failed is not None else score)
    out = rows.select("item_id", value.alias("score"), missing.isNull().alias("scoreable"), missing.alias("error"))
    return out.withColumn("passed", F.col("score") >= PASS)


def rate_to_score(rate: Column, zero: float = MISMATCH) -> Column:
    return F.round(5.0 * s.clamp(1.0 - rate / zero, 0.0, 1.0), 3)


def phoneme_distance(rows: DataFrame) -> DataFrame:
    """heard (symbols) against every accepted variant (an array of symbols): the least cost for each sound of
    the variant counts. Without a variant or a span the item can't be judged."""
    each = rows.where((F.size("variants") > 0) & F.col("heard").isNotNull()).select("item_id", "heard", F.explode("variants").alias("ref"))
    pairs = each.select("ref", "heard").distinct()
    costs = pairs.withColumn("rate", phones.segmental_cost("ref", "heard") / F.greatest(F.size(F.split("ref", " ")), F.lit(1)))
    best = each.join(costs, ["ref", "heard"]).groupBy("item_id").agg(F.min("rate").alias("rate"))
    missing = F.when(F.coalesce(F.size("variants"), F.lit(0)) <= 0, "no variant").when(F.col("heard").isNull(), "no span")
    return judged(rows.join(best, "item_id", "left"), rate_to_score(F.col("rate")), missing)


def asr_roundtrip(rows: DataFrame) -> DataFrame:
    """expected against the recognised span: 5 if equal, by sound code and similarity else; nothing heard is 0.
    No transcript at all can't be judged."""
    a, b = (x.slug_squeezed(F.col(c)) for c in ("expected", "recognized"))
    score = fuzzy.gated_score(a, b, x.phonetic_code(a) == x.phonetic_code(b))
    return judged(rows, F.round(score, 3), F.when(F.col("recognized").isNull(), "no transcript"), b == "")


def speech_similarity(rows: DataFrame) -> DataFrame:
    """f1 of the best reference as a score; without a reference the item can't be judged."""
    return judged(rows, s.f1_score(F.col("f1")), F.when(F.col("f1").isNull(), "no reference"))


def unwired(rows: DataFrame) -> DataFrame:
    """A judge that nobody plugged in."""
    raise NotImplementedError("no judge is plugged in: register one under this name")


for _name, _scorer in {"phoneme-distance": phoneme_distance, "asr-roundtrip": asr_roundtrip, "speech-similarity": speech_similarity, "audio-judge": unwired}.items():
    register_scorer(_name, _scorer)
