"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application: their Python workers import it by name, so
    they need it even where they were started without it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="lodestone-code-")  # the driver's file server hands it out
    path = os.path.join(folder, "lodestone_code.zip")
    Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='lodestone-shared-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores where their files give fewer partitions than there are cores.

    A table of one small file is one task, whatever is done to its texts; a table of many files is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (by ``keys``, if any) over all shuffle partitions, which Spark won't put together again: few bytes with much work for
    each row would end in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its rows and their partitions can't change any more."""
    ship_code(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_count(text: str) -> int:
    """A size as Spark's settings write it: '10485760b', '10MB', '256k'."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.strip().lower().removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text and text[-1] in units else int(text)
