"""Operator 2: token counts through a digest cache.

A text's key is the SHA-256 of its normalised content with the digest of the tokenizer's file, so
another tokenizer never meets this one's counts. Normalisation may only do what can't change the
count: null becomes the empty text. Keys are joined to the cache; only distinct keys that it lacks
are encoded, once each, by the tokenizer's own library, and their counts appended to it.

The cache is a Parquet table (content, tokenizer, n_tokens); a key that two writers appended is
read once. Null texts are empty. Very long texts are encoded whole. Repeated texts cost one encoding. Rows with a
repeated or null id are answered row by row. There are no ties to break: a key has one count. An empty
table reads and appends nothing. Extra columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, join_small_ids, materialize, null_safe_key, shared_path, ship_code
from .pretokens import PieceMemory

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"

_counters: dict[str, PieceMemory] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str, most_pieces: int = 600_000) -> PieceMemory:
    """Counts of pieces by the library for ``path``; one for each worker."""
    if path not in _counters:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            count = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        _counters[path] = PieceMemory(count, most_pieces)
    return _counters[path]


def count_texts(texts: list[str], path: str, by_pieces: bool) -> list[int]:
    memory = counter(path)
    return [sum(v) for v in memory.values(texts)] if by_pieces else memory.compute(texts)


def read_cache(docs: DataFrame, cache_path: str) -> DataFrame:
    """The cache's rows; none if there is no cache yet."""
    try:
        return docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return docs.sparkSession.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, path: str, cache_path: str | None = None, limit: int = 512, by_pieces: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``cache_path`` keeps counts between calls; without it the call has a cache of its own, empty at
    first. ``by_pieces`` lets a worker count the recurring space-separated pieces of texts once,
    which is exact for byte-level BPE only; set it False for other tokenizers.
    """
    spark = docs.sparkSession
    ship_code(spark)
    cache_path = cache_path or shared_path(spark, "op2-cache")
    version = tokenizer_digest(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("content", F.sha2("text", 256))
    keys = materialize(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "op2-keys")
    stored = read_cache(docs, cache_path).where(F.col("tokenizer") == version)
    misses = keys.groupBy("content").agg(F.min(null_safe_key(F.col("doc_id"))).alias("carrier")).join(stored, "content", "left_anti")
    misses = materialize(misses, "op2-misses")
    n_misses = misses.count()
    carried = join_small_ids(rows.withColumn("carrier", null_safe_key(F.col("doc_id"))), misses, n_misses, ["content", "carrier"], row_bytes=160)
    if fits_broadcast(spark, n_misses, 160):  # else the join has brought repeated rows together
        carried = carried.dropDuplicates(["content"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()  # a repeated row can carry its text twice
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                pick = []
                for i, c in enumerate(batch.column(0).to_pylist()):
                    if c not in done:
                        done.add(c)
                        pick.append(i)
                chosen = batch.take(pa.array(pick, pa.int64()))
                counts = count_texts(chosen.column(1).to_pylist(), path, by_pieces)
                yield pa.record_batch([chosen.column(0), pa.array([version] * len(pick), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    carried.select("content", "text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(docs, cache_path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
