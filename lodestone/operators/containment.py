"""Names within texts, for any number of names.

Names are taken in blocks of a bounded number of bytes. One block at a time is sent to the executors, where a
worker builds an Aho-Corasick automaton from it once and walks every text of its batches through it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.variants import squeezed
from lodestone.sources.tables import stored

_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(token: str, keys: list[str]) -> ahocorasick.Automaton:
    """The block's automaton, built once in a worker; a worker holds one block at a time."""
    if token not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for k in keys:
            found.add_word(k, k)
        found.make_automaton()
        _automata[token] = found
    return _automata[token]


def contained_names(texts: DataFrame, keys: list[str], text: str, own: str, names: DataFrame, name: str, least: int = 6, block_bytes: int = 8 << 20) -> DataFrame:
    """keys and ``name``: the names that a text contains though its own name does not, both squeezed to letters
    and digits.

    Names of fewer than ``least`` such characters, and names that are all of the own one, are left out. Names that
    squeeze to the same are all given. A null text contains nothing, a null own name hides nothing. A block has
    ``block_bytes`` of squeezed names; each block is one pass over the texts.
    """
    listed = names.select(F.col(name).alias("name"), squeezed(F.col(name)).alias("key")).where(F.length("key") >= least).distinct()
    listed = stored(listed, "names")
    total = listed.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = listed.select("key", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).distinct()
    dealt = stored(dealt.repartition(min(blocks, 200), "block"), "blocks")
    rows = texts.select(*keys, F.coalesce(squeezed(F.col(text)), F.lit("")).alias("_blob"), F.coalesce(squeezed(F.col(own)), F.lit("")).alias("_own"))
    schema = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys), "key string"])
    found = None
    for b in range(blocks):
        held = texts.sparkSession.sparkContext.broadcast([r["key"] for r in dealt.where(F.col("block") == b).select("key").collect()])  # block_bytes, whatever the number of names
        token = uuid.uuid4().hex  # workers live on from call to call

        def run(batches: Iterator[pa.RecordBatch], held=held, token=token) -> Iterator[pa.RecordBatch]:
            if not held.value:
                return
            walk = automaton(token, held.value)
            for batch in batches:
                at, hits = [], []
                for i, (blob, mine) in enumerate(zip(batch.column("_blob").to_pylist(), batch.column("_own").to_pylist(), strict=True)):
                    inside = {k for _, k in walk.iter(blob)}
                    if inside:
                        inside -= {k for _, k in walk.iter(mine)}
                    at += [i] * len(inside)
                    hits += sorted(inside)
                kept = batch.select(keys).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hits, pa.string())], names=[*keys, "key"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return found.join(listed, "key").select(*keys, F.col("name").alias(name))


def undominated(rows: DataFrame, group: str, text: str, most: int) -> DataFrame:
    """group, text: of each group's distinct phonetic texts, without dots and spaces, those inside no longer one,
    the first ``most``; of texts that differ in dots and spaces alone the first.

    Texts meet by equality with parts of longer ones. A part can be a text of its group only if it begins as all of
    them do and is no shorter than the shortest, so few parts of a text are rows, and no group is ever gathered.
    """
    keyed = rows.where(F.col(text).isNotNull()).withColumn("key", F.regexp_replace(text, "[. ]", "")).groupBy(group, "key").agg(F.min(text).alias(text))
    bounds = keyed.groupBy(group).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min(F.length("key")).alias("least"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    # what the first and the last text in order begin with, all texts between them begin with
    shared = F.size(F.filter(upto(F.col("least")), lambda i: F.left("low", i) == F.left("high", i)))
    bounds = bounds.select(group, "least", F.left("low", shared).alias("begin"))
    own, key = F.length("key"), F.col("key")
    starts = F.filter(upto(own), lambda i: F.substr(key, i, F.length("begin")) == F.col("begin"))
    parts = lambda i: F.transform(F.filter(upto(own - i + 1), lambda n: (n >= F.col("least")) & (n < own)), lambda n: F.substr(key, i, n))
    inner = keyed.join(bounds, group).select(group, F.explode(F.array_distinct(F.flatten(F.transform(starts, parts)))).alias("key"))
    # an empty text is inside every other
    free = keyed.where("key <> ''").join(inner, [group, "key"], "left_anti").unionByName(keyed.where("key = ''").join(keyed.where("key <> ''"), group, "left_anti"))
    order = F.row_number().over(Window.partitionBy(group).orderBy(text))
    return free.withColumn("place", order).where(F.col("place") <= most).select(group, text)
