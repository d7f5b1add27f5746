"""Readers and writers: JSON Lines, JSON documents, Parquet with labels, sound headers, caches."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a malformed line is an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Malformed lines are dropped; of several records of a key the last by ``order`` counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def read_json_document(spark: SparkSession, path: str, schema: str, field: str = "rows") -> DataFrame:
    """The elements of one array field of whole-file documents."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode(field).alias("x")).select("x.*")


def read_json_map(spark: SparkSession, path: str, schema: str, key: str = "key") -> DataFrame:
    """The members of whole-file objects without a field for rows: each name as ``key``, its object's fields beside it.

    A file is one object, so it is one row of one task; a member that is no object has null fields.
    """
    texts = spark.read.option("wholetext", True).text(path)
    members = F.from_json("value", f"map<string, struct<{schema}>>", {"mode": "FAILFAST"})
    return texts.select(F.explode(members).alias(key, "x")).select(key, "x.*")


def decode_labels(rows: DataFrame, column: str, labels: Mapping[int, str]) -> DataFrame:
    """Integer labels by name; a code without a name stays as text."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return rows.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column).cast("int")), F.col(column).cast("string")))


def parquet_labels(spark: SparkSession, path: str, column: str, names_key: str = "names") -> dict[int, str]:
    """Label names kept in the schema metadata of a column, by code."""
    found = spark.read.parquet(path).schema[column].metadata.get(names_key, [])
    return dict(enumerate(found))


def layered_config(defaults: Mapping, systems: list[Mapping], nested: tuple[str, ...] = ("audio", "pricing", "retry")) -> list[dict]:
    """Each system over the defaults; nested parts merge key by key."""
    out = []
    for s in systems:
        merged = {**defaults, **s}
        for n in nested:
            if n in defaults or n in s:
                merged[n] = {**defaults.get(n, {}), **s.get(n, {})}
        out.append(merged)
    return out


def config_frame(spark: SparkSession, systems: list[Mapping]) -> DataFrame:
    """system_id, status and the whole configuration as JSON (a driver-side dimension)."""
    rows = [(s["system_id"], s.get("status", "planned"), json.dumps(s, sort_keys=True)) for s in systems]
    return spark.createDataFrame(rows, "system_id string, status string, config string")


WAV = StructType([StructField("frames", LongType()), StructField("sample_rate_hz", IntegerType()), StructField("channels", IntegerType()), StructField("width", IntegerType()), StructField("duration_s", DoubleType()), StructField("problem", StringType())])


@F.pandas_udf(WAV)
def probe_wav(content: pd.Series) -> pd.DataFrame:
    """Header of each sound; ``problem`` says why one can't be read."""
    rows = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as w:
                n, rate = w.getnframes(), w.getframerate()
                rows.append((n, rate, w.getnchannels(), w.getsampwidth(), n / rate, None if w.getsampwidth() == 2 else "not 16 bit"))
        except (wave.Error, EOFError, TypeError) as e:
            rows.append((None, None, None, None, None, str(e) or type(e).__name__))
    return pd.DataFrame(rows, columns=[f.name for f in WAV])


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 and header of each file; content isn't kept."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), probe_wav("content").alias("wav")).select("path", "bytes", "sha256", "wav.*")


def duration_flag(seconds, low: float = 0.3, high: float = 4.0):
    return F.when(seconds < low, "short").when(seconds > high, "long")


def merge_collected(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Files of collected records in order: the record of the last file counts, and ``conflict``
    says whether files disagree about the content."""
    rows = None
    for i, p in enumerate(paths):
        part = spark.read.schema(schema).option("multiLine", True).json(p).withColumn("_file", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != "_file"]
    g = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_file").alias("x"), (F.countDistinct("audio_b64") > 1).alias("conflict"))
    return g.select("x.*", "conflict").withColumn("audio", F.unbase64("audio_b64"))


def newest_last(spark: SparkSession, path: str) -> list[str]:
    """Paths of a folder's files, oldest first; none is an error. A listing, so it is collected."""
    listed = spark.read.format("binaryFile").load(path).select("path", "modificationTime").orderBy("modificationTime", "path")
    found = [r["path"] for r in listed.collect()]
    if not found:
        raise FileNotFoundError(path)
    return found


class CacheTable:
    """Answers by key in an append-only Parquet table. Absent answers are kept, failures never."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def misses(self, keys: DataFrame, key: str) -> DataFrame:
        return keys.select(key).distinct().join(self.read().select(key), key, "left_anti")

    def append(self, answers: DataFrame, failed: str = "failed") -> None:
        answers.where(~F.col(failed)).drop(failed).write.mode("append").parquet(self.path)


def write_artifacts(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Each frame as a folder of JSON Lines under its name."""
    for name, frame in frames.items():
        finite = [F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes]
        frame.select(*finite).write.mode("overwrite").json(f"{folder}/{name}")


def write_with_digest(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Rows as CSV, and a manifest with their number and a digest that doesn't depend on partitions."""
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/rows")
    line = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    halves = [F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(2)]
    rows.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", *halves), 256).alias("digest")).write.mode("overwrite").json(f"{folder}/manifest")


def save_manifest(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A manifest sorted by key over its files."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)
