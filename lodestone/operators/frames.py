"""Spans of words in sound from labels of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(frames: DataFrame, keys: list[str], frame: str, label: str, score: str, blank: str) -> DataFrame:
    """keys, place (from 0), label, start and end (exclusive) and score (mean) of the runs of equal labels that
    are no blank. A blank between equal labels parts them, and a missing label or frame ends a run."""
    ordered = Window.partitionBy(*keys).orderBy(frame)
    same = F.lag(label).over(ordered).eqNullSafe(F.col(label)) & F.coalesce(F.col(frame) - F.lag(frame).over(ordered) == 1, F.lit(False))
    marked = frames.withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(ordered))
    spoken = marked.where(F.col(label).isNotNull() & (F.col(label) != blank))
    g = spoken.groupBy(*keys, "_run").agg(F.first(label).alias("label"), F.min(frame).alias("start"), (F.max(frame) + 1).alias("end"), F.avg(score).alias("score"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_run")) - 1).select(*keys, "place", "label", "start", "end", "score")


def aligned_spans(found: DataFrame, tokens: DataFrame, lengths: DataFrame, keys: list[str], pad: float = 0.03, most: float = 0.15) -> DataFrame:
    """keys, from_s, to_s, score of the wanted tokens: their segments and what is recovered around them.

    ``tokens`` has keys, place, label and wanted (boolean): what was to be said, in order. ``lengths`` has keys,
    seconds and frames. A clip whose segments are not the tokens one to one, or which wants none, has no row.
    Half of the gap to the neighbouring segment is taken, ``most`` seconds at most; where there is no neighbour
    ``pad`` seconds, within the clip. The score is the mean over the wanted frames.
    """
    both = tokens.join(found.withColumnRenamed("label", "_said"), [*keys, "place"], "full")
    sound = F.coalesce(F.col("label") == F.col("_said"), F.lit(False))
    ordered = Window.partitionBy(*keys).orderBy("place")
    around = both.select(*keys, "place", "wanted", "start", "end", "score", F.min(sound).over(Window.partitionBy(*keys)).alias("_whole"), F.lag("end").over(ordered).alias("_before"), F.lead("start").over(ordered).alias("_after"))
    wanted = around.where("_whole and wanted").withColumn("_n", F.col("end") - F.col("start"))
    first, last = (F.struct("place", "start", "_before"), F.struct("place", "end", "_after"))
    g = wanted.groupBy(*keys).agg(F.min(first).alias("a"), F.max(last).alias("z"), (F.sum(F.col("score") * F.col("_n")) / F.sum("_n")).alias("score"))
    timed = g.join(lengths.select(*keys, "seconds", "frames"), keys).withColumn("_stride", F.col("seconds") / F.col("frames"))
    half = lambda gap: F.least(gap / 2 * F.col("_stride"), F.lit(most))
    begin, stop = F.col("a.start") * F.col("_stride"), F.col("z.end") * F.col("_stride")
    from_s = F.when(F.col("a._before").isNull(), F.greatest(F.lit(0.0), begin - pad)).otherwise(begin - half(F.col("a.start") - F.col("a._before")))
    to_s = F.when(F.col("z._after").isNull(), F.least("seconds", stop + pad)).otherwise(stop + half(F.col("z._after") - F.col("z.end")))
    return timed.select(*keys, from_s.alias("from_s"), to_s.alias("to_s"), "score")
