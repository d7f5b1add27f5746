"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Beyond so many files, a map from path to number is dearer than writing the rows again.
_MOST_FILES = 2000


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and bound the batches that workers get
    unless the session has a bound of its own.

    Python workers import ``lodestone.llm`` by name, so they need the package even where the
    executors were started without it on their path.
    """
    sc = spark.sparkContext
    # what a Python worker holds at once follows bytes, not rows: by default a batch may have 64 MB
    if spark.conf.get(_BATCH, None) == "67108864b":
        spark.conf.set(_BATCH, str(_BATCH_BYTES))
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


def shared_root(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; any other master must set it,
    because executors can't see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='lodestone-shared-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Like checkpoints, these tables stay until the folder is cleaned: a result may be read lazily
    long after this call. Rows of megabytes need ``group_bytes``: writers hold a row group, readers up to
    4096 rows of one, and by default a group has 100 rows at least.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    groups = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1}
    df.write.options(**groups).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a ``row`` number that is the same each time the result is read.

    Rows of a stored table get their file's number and their place in it. A frame without such places,
    or with more rows of a file than it has places, is written to the shared folder with numbers first.
    """
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        found = df.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max(place).alias("last")).limit(_MOST_FILES + 1).collect()
    except AnalysisException:
        found = []
    if 0 < len(found) <= _MOST_FILES and all(r["n"] <= r["last"] + 1 for r in found):
        number = F.create_map(*[F.lit(x) for i, f in enumerate(sorted(r["file"] for r in found)) for x in (f, i)])
        row = place + F.try_element_at(number, file).cast("long") * F.lit(1 << 40)
        # an unknown file gives null, which must not pass for a number
        return df.select("*", F.coalesce(row, F.raise_error(F.lit("a file of the table is not in its list")).cast("long")).alias("row"))
    return materialize(df.withColumn("row", F.monotonically_increasing_id()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def is_held_out(doc_id: Column, mod: int, rest: int = 2) -> Column:
    """Rows kept from learning; a row without id is not held out."""
    return F.coalesce(id_remainder(doc_id, mod) == rest, F.lit(False))


def join_small_ids(big: DataFrame, ids: DataFrame, n_ids: int, keys: list[str], how: str = "inner", row_bytes: int = 64) -> DataFrame:
    """Join a table of long rows with a thin one whose row count is known.

    The thin side is broadcast only if its size is under Spark's own broadcast threshold. Beyond
    it the thin side becomes the hash table of a shuffled join, so the long rows are never sorted.
    """
    hint = "broadcast" if fits_broadcast(big.sparkSession, n_ids, row_bytes) else "shuffle_hash"
    return big.join(ids.hint(hint), keys, how)


def one_text_each(docs: DataFrame, chosen: DataFrame, n_chosen: int, most_chars: int | None = None) -> DataFrame:
    """``chosen`` (doc_id and labels, ``n_chosen`` rows at most) with a text: of an id that repeats, the
    text of least hash, so what is gathered follows the number of ids and not that of rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if most_chars is not None:
        texts = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars)
    others = [c for c in chosen.columns if c != "doc_id"]
    found = join_small_ids(texts, chosen, n_chosen, ["doc_id"], row_bytes=8 + 4 * len(others))
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", *others)).alias("least")
    return found.groupBy("doc_id").agg(least).select("doc_id", "least.text", *(f"least.{c}" for c in others))


def fits_broadcast(spark: SparkSession, rows: int, row_bytes: int = 64) -> bool:
    """Whether so many rows stay under Spark's broadcast threshold."""
    return rows * row_bytes <= _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))


def _bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.strip().lower().removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text and text[-1] in units else int(text)


def null_safe_key(c: Column) -> Column:
    """A join key for a nullable id: text that tells null from every value."""
    return F.coalesce(c.cast("string"), F.lit("null"))
