"""Loops over rows that are scored again and again, with their state in tables.

Each round writes what it looked at and is done only when a mark says so. A loop that was killed goes on
behind its last whole round, so its answers are those of a loop that ran through, and no plan holds more
than one round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import fresh_path

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Rounds:
    """The parts of a loop in a shared folder: ``part=N`` has the rows that round N looked at, as it left them.

    ``done=N`` is written after the part and holds its number of rows, so a part that was cut off, or a mark
    without its part, does not count and the round is run again.
    """

    spark: SparkSession
    folder: str

    def _read(self, path: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def part(self, n: int) -> DataFrame | None:
        """The rows of a round that is done, else None."""
        mark = self._read(f"{self.folder}/done={n}", "n long")
        rows = None if mark is None else self._read(f"{self.folder}/part={n}")
        said = None if mark is None else mark.first()
        return rows if rows is not None and said is not None and rows.count() == said["n"] else None

    def run(self, n: int, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of round ``n``, from its part or else made and kept."""
        found = self.part(n)
        if found is not None:
            return found
        rows = make()
        rows.write.mode("overwrite").parquet(f"{self.folder}/part={n}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/part={n}")
        self.spark.range(1).select(F.lit(stored.count()).alias("n")).write.mode("overwrite").parquet(f"{self.folder}/done={n}")
        return stored


def _rounds(rows: DataFrame, folder: str | None, name: str) -> Rounds:
    return Rounds(rows.sparkSession, folder or fresh_path(rows.sparkSession, name))


def hill_climb(rows: DataFrame, key: str, propose: list[Scorer], score: Scorer, goal: float, gain: float = 0.0, folder: str | None = None) -> DataFrame:
    """Rounds of proposals over the rows still under ``goal``; a proposal is kept if it gains more than ``gain``.

    ``rows`` has key, form and score. Round n calls ``propose[n - 1]`` for a form (key, form) of each open row
    and keeps the better one with the number of the round that gave it. A row whose proposal is its own
    form is not scored. Rows at the goal and rows without a score are left as they are. With ``folder`` a loop
    that was cut off goes on where it was; a proposer sees the same rows as before.
    """
    kept = _rounds(rows, folder, "climb")
    parts = [kept.run(0, lambda: rows.select(key, "form", "score", F.lit(0).alias("round")))]
    still_open = F.coalesce(F.col("score") < goal, F.lit(False))
    for n, step in enumerate(propose, 1):

        def one(at: int = n, of: Scorer = step) -> DataFrame:
            state = parts[-1].where(still_open)
            trial = of(state).select(key, F.col("form").alias("_form")).join(state.select(key, F.col("form").alias("_own")), key).where("_form is distinct from _own")
            scored = score(trial.select(key, F.col("_form").alias("form"))).select(key, F.col("form").alias("_form"), F.col("score").alias("_score"))
            better = F.coalesce(F.col("_score") > F.col("score") + gain, F.lit(False))
            new = {"form": F.col("_form"), "score": F.col("_score"), "round": F.lit(at)}
            return state.join(scored, key, "left").select(key, *(F.when(better, x).otherwise(F.col(c)).alias(c) for c, x in new.items()))

        parts.append(kept.run(n, one))
    # a row stands in every part up to the one in which it reached the goal
    out = parts[-1]
    for part in parts[:-1]:
        out = out.unionByName(part.where(~still_open))
    return out


def retry_variants(rows: DataFrame, options: DataFrame, key: str, score: Scorer, low: float, gain: float, most: int = 3, folder: str | None = None) -> DataFrame:
    """Walk on to the next unused variant of rows under ``low`` while each step gains enough.

    ``rows`` has key, used (the variant in use of each part) and score; ``options`` has key and options
    (the variants of each part). The first part that still has an unused variant moves on. A row stops at
    its first step without the gain, without another variant, or after ``most`` steps. A round is one job
    over all rows that still walk, scored by ``score`` (key, used -> key, score), and its rows are stored; with
    ``folder`` a walk that was cut off goes on.
    """
    kept = _rounds(rows, folder, "walk")
    begun = lambda: rows.join(options, key, "left").select(key, "used", "score", "options", F.lit(True).alias("walks"), F.lit(0).alias("tries"))
    parts = [kept.run(0, begun)]
    for n in range(1, most + 1):

        def one() -> DataFrame:
            state = parts[-1].where("walks")
            used_up = lambda o, i: F.array_position(o, F.get("used", i))
            nexts = F.transform("options", lambda o, i: F.when(used_up(o, i) > 0, F.get(o, used_up(o, i).cast("int"))).otherwise(F.get(o, F.lit(0))))
            tried = state.withColumn("nexts", nexts)
            at = F.coalesce(F.array_position(F.transform("nexts", lambda x: x.isNotNull()), F.lit(True)), F.lit(0))
            tried = tried.withColumn("at", F.when(F.coalesce("score", F.lit(0.0)) < low, at).otherwise(F.lit(0)))
            tried = tried.withColumn("trial", F.when(F.col("at") > 0, F.transform("used", lambda u, i: F.when(i + 1 == F.col("at"), F.get("nexts", i)).otherwise(u))))
            scored = score(tried.where("trial is not null").select(key, F.col("trial").alias("used"))).select(key, F.col("score").alias("new"))
            keeps = F.coalesce(F.col("new") >= F.coalesce("score", F.lit(0.0)) + gain, F.lit(False))
            return tried.join(scored, key, "left").select(
                key,
                F.when(keeps, F.col("trial")).otherwise(F.col("used")).alias("used"),
                F.when(keeps, F.col("new")).otherwise(F.col("score")).alias("score"),
                "options",
                keeps.alias("walks"),
                (F.col("tries") + F.col("trial").isNotNull().cast("int")).alias("tries"),
            )

        parts.append(kept.run(n, one))
    out = parts[-1]
    for part in parts[:-1]:
        out = out.unionByName(part.where("not walks"))
    return out.select(key, "used", "score", "tries")


def accepted_phrases(rows: DataFrame, key: str, ask: Scorer, folder: str | None = None) -> DataFrame:
    """Phrases of a row left out one at a time until a service takes the rest.

    ``rows`` has key and phrases (array). A round asks about all open rows in one job (key, phrases -> key,
    answer, message); a message is a refusal. The first phrase that the message holds is dropped, or the last
    one if it holds none, and the row is asked again in the next round. A row is settled when it is taken or
    has no phrase left, so there are at most as many rounds as phrases in a row. Gives key, phrases, dropped
    (in order), answer (null without one), asked (how often).
    """
    kept = _rounds(rows, folder, "phrases")
    none = F.array().cast("array<string>")
    begun = {"phrases": F.coalesce("phrases", none), "dropped": none, "answer": F.lit(None).cast("string"), "asked": F.lit(0), "open": F.size(F.coalesce("phrases", none)) > 0}
    parts = [kept.run(0, lambda: rows.select(key, *(c.alias(name) for name, c in begun.items())))]
    while not parts[-1].where("open").isEmpty():

        def one() -> DataFrame:
            state = parts[-1].where("open")
            told = ask(state.select(key, "phrases")).select(key, F.col("answer").alias("_answer"), F.col("message").alias("_message"))
            joined = state.join(told, key, "left").withColumn("_refused", F.col("_message").isNotNull())
            named = F.array_position(F.transform("phrases", lambda p: F.contains("_message", p)), F.lit(True))
            place = F.when(named > 0, named).otherwise(F.size("phrases"))
            joined = joined.withColumn("_place", F.when(F.col("_refused"), place))
            rest = F.filter("phrases", lambda p, i: i + 1 != F.col("_place"))
            return joined.select(
                key,
                F.when(F.col("_refused"), rest).otherwise(F.col("phrases")).alias("phrases"),
                F.when(F.col("_refused"), F.concat("dropped", F.array(F.element_at("phrases", F.col("_place").cast("int"))))).otherwise(F.col("dropped")).alias("dropped"),
                F.when(~F.col("_refused"), F.col("_answer")).alias("answer"),
                (F.col("asked") + 1).alias("asked"),
                (F.col("_refused") & (F.size("phrases") > 1)).alias("open"),
            )

        parts.append(kept.run(len(parts), one))
    out = parts[-1]
    for part in parts[:-1]:
        out = out.unionByName(part.where("not open"))
    return out.drop("open")


def two_arms(rows: DataFrame, key: str, ask: Scorer, speak: Scorer, likeness: Callable[[Column, Column], Column], clips: DataFrame, gate: float = 0.35, folder: str | None = None) -> DataFrame:
    """A row for two ways to say a name: its phrases, without those that a service refuses, against its alias.

    ``rows`` has key, phrases, alias and cached (an earlier answer for the phrases, or null, which saves the
    asking); ``speak`` gives the alias's answer (key, alias -> key, answer); ``clips`` has key and clip, a person's
    answer, for some. Arms that are less alike than ``gate`` are a mix-up: the phrases are not used. Gives key,
    used, dropped, error, alike, phrases_vs_clip, alias_vs_clip, delta.
    """
    fresh = accepted_phrases(rows.where("cached is null").select(key, "phrases"), key, ask, folder)
    none = F.array().cast("array<string>")
    old = rows.where("cached is not null").select(key, F.coalesce("phrases", none).alias("phrases"), none.alias("dropped"), F.col("cached").alias("answer"))
    first = fresh.select(key, "phrases", "dropped", "answer").unionByName(old).withColumnRenamed("answer", "_one")
    second = speak(rows.where("alias <> ''").select(key, "alias")).select(key, F.col("answer").alias("_two"))
    both = rows.select(key, "alias").join(first, key).join(second, key, "left").join(clips.select(key, "clip"), key, "left")
    both = both.withColumn("_alike", F.when(F.coalesce("alias", F.lit("")) != "", likeness(F.col("_one"), F.col("_two"))))
    error = F.when(F.coalesce("alias", F.lit("")) == "", "no_respelling").when(F.col("_one").isNull(), "no_ipa").when(F.col("_alike") < gate, "mixup_ipa")
    both = both.withColumn("error", error)
    sound = lambda c: F.when(F.col("error").isNull(), c)
    scored = both.select(
        key,
        F.when(F.col("_one").isNull() | F.coalesce(F.col("error") == "mixup_ipa", F.lit(False)), none).otherwise(F.col("phrases")).alias("used"),
        "dropped",
        "error",
        F.col("_alike").alias("alike"),
        sound(likeness(F.col("_one"), F.col("clip"))).alias("phrases_vs_clip"),
        sound(likeness(F.col("_two"), F.col("clip"))).alias("alias_vs_clip"),
    )
    return scored.withColumn("delta", F.round(F.col("phrases_vs_clip") - F.col("alias_vs_clip"), 4))
