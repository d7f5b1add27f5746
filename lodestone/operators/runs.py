"""Providers and runs that resume: external answers come in as frames."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import pending, resumable


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    initial_s: float = 0.5
    factor: float = 2.0
    most_s: float = 30.0

    def wait(self, tried: int) -> float:
        """Seconds before the next try, after so many."""
        return min(self.initial_s * self.factor ** (tried - 1), self.most_s)


RECORD = "item_id string, system_id string, text_sha256 string, status string, error string, attempt_count int, latency_ms double, seconds double, cost_usd double, seq long"

PROVIDERS: dict[str, Callable[[], Provider]] = {}


def register_provider(name: str, make: Callable[[], Provider]) -> None:
    PROVIDERS[name] = make


def build_provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise KeyError(f"unknown provider {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]()


class Provider:
    """Answers one item; timing, retries and cost are done here and not by subclasses."""

    system_id = "none"
    retry = Retry()
    price_per_second = 0.0

    def answer(self, item_id: str, text: str, attempt: int) -> float:
        """Seconds of output; an error may be tried again if it has ``transient``."""
        raise NotImplementedError

    def run(self, item_id: str, text: str, seq: int) -> dict:
        began, error, seconds, tried = time.monotonic(), None, None, 0
        for tried in range(1, self.retry.attempts + 1):
            try:
                seconds, error = self.answer(item_id, text, tried), None
                break
            except Exception as e:  # noqa: BLE001  an answer's failure is data
                error = type(e).__name__
                if not getattr(e, "transient", False):
                    break
                if tried < self.retry.attempts:
                    time.sleep(self.retry.wait(tried))
        return {
            "item_id": item_id, "system_id": self.system_id, "text_sha256": hashlib.sha256(text.encode()).hexdigest(), "status": "ok" if error is None else "error", "error": error,
            "attempt_count": tried, "latency_ms": (time.monotonic() - began) * 1e3, "seconds": seconds, "cost_usd": (seconds or 0.0) * self.price_per_second, "seq": seq,
        }


class Mock(Provider):
    """Seconds from the text's digest; every seventh item fails once, every 31st for good."""

    system_id, price_per_second = "mock", 0.001
    retry = Retry(initial_s=0.001)

    class Busy(RuntimeError):
        transient = True

    def answer(self, item_id: str, text: str, attempt: int) -> float:
        n = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
        if n % 31 == 0:
            raise ValueError(item_id)
        if n % 7 == 0 and attempt == 1:
            raise self.Busy(item_id)
        return 0.2 + n % 1000 / 500


register_provider("mock", Mock)


def run_batch(work: DataFrame, manifest: DataFrame, provider: str, parallel: int = 8) -> DataFrame:
    """Manifest rows for the work that isn't done: its text changed, it failed, or it is new.

    ``work`` has item_id and text, ``manifest`` RECORD's columns. ``parallel`` bounds how many
    answers are asked for at once.
    """
    build_provider(provider)  # an unknown one fails before any work
    make = PROVIDERS[provider]  # goes to the executors, whose own registry lacks the caller's providers
    records = manifest.withColumn("path", F.lit(None).cast("string"))
    todo = resumable(work, records, "item_id", "text").where(~F.col("eligible")).select("item_id", "text")
    after = (manifest.agg(F.max("seq").alias("s")).first()["s"] or 0) + 1

    def answers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()
        for part in parts:
            yield pd.DataFrame([p.run(i, t, after) for i, t in zip(part.item_id, part.text, strict=True)], columns=[c.split(" ")[0] for c in RECORD.split(", ")])

    return todo.repartition(parallel).mapInPandas(answers, RECORD)


def summarize_run(records: DataFrame) -> DataFrame:
    """One row: counts, errors by class, retried, seconds, cost, mean latency of successes."""
    ok = F.col("status") == "ok"
    g = records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.count_if(F.col("attempt_count") > 1).alias("retried"),
        F.round(F.sum("seconds"), 6).alias("seconds"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"), F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_latency_ms"),
    )
    errors = records.where(~ok).groupBy("error").agg(F.count(F.lit(1)).alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error", "c")))).alias("errors"))
    return g.join(F.broadcast(errors))


def done_ids(manifest: DataFrame) -> DataFrame:
    return manifest.where("status = 'ok'").select("item_id").distinct()


def not_started(work: DataFrame, manifest: DataFrame) -> DataFrame:
    return pending(work, done_ids(manifest), ["item_id"])
