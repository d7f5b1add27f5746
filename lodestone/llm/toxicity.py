"""Operator 1: toxicity by a classifier chain.

Categories are predicted one after another by logistic models. Each model sees the text's features
and the probabilities of the earlier categories; in training these are out-of-fold predictions, so
a later model learns from probabilities as it will meet them. The last category is ``toxic`` itself.
An earlier category is learned from the column of its name in ``labels`` where there is one. Where there
is none, as in the tables at hand, its labels are weak: a text labelled toxic that also matches the
category's pattern. Patterns mark training texts only; all scores come from the models.

Features are words and word beginnings (5 to 7 bytes), chosen by the G-squared statistic of their
document counts in labelled texts, counted over distinct words, with the text's length.

The fit takes at most ``most_docs`` labelled documents (those with the least hashed id); all texts
are scored whole, very long ones too. Null and empty texts have no features and get the model's base rate.
Repeated rows are scored row by row; in the fit an id that repeats counts once, with the highest of its
labels and one of its texts. Features of equal statistic are taken by name. Rows without label or id are
scored. Without labels of both classes the score is the share of toxic labels (0 without any). An empty
table gives no rows. Labels, lang, source and doc_id are never inputs. Extra columns pass through, but
those named held_out, predicted, score or p_<category> are replaced by the operator's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, is_held_out, materialize, one_text_each, ship_code

# The chain's earlier categories and the words that mark them in a toxic text.
CATEGORIES = {
    "insult": r"\b(?:idiot|moron|stupid|loser|clown|imbecile|fool|dumb)\b",
    "contempt": r"\b(?:trash|pathetic|worthless|disgusting|scum|garbage|vermin|filth)\b",
}
_LETTERS = bytes(i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
BEGINNINGS = (5, 6, 7)
FOLDS = 5


def distinct_words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_LETTERS).split())


def word_features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)]


class Features:
    """Counts of the chosen features over a text's distinct words."""

    def __init__(self, names: list[bytes], most_words: int = 500_000):
        self.column = {n: i for i, n in enumerate(names)}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.most = most_words

    def entries(self, texts: list[str | None]) -> tuple[list[list[int]], list[int]]:
        """The columns that each text's distinct words count in, and the number of these words."""
        columns, lengths = [], []
        for text in texts:
            words = distinct_words(text)
            lengths.append(len(words))
            if len(self.words) > self.most:
                self.words = {}
            seen, own = self.words, []
            for w in words:
                found = seen.get(w)
                if found is None:
                    found = seen[w] = tuple(self.column[f] for f in word_features(w) if f in self.column)
                own += found
            columns.append(own)
        return columns, lengths

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return dense(*self.entries(texts), len(self.column))


def dense(columns: list, lengths: list[int], width: int) -> np.ndarray:
    """Rows of the models' inputs from what :meth:`Features.entries` gives."""
    n = len(columns)
    row = np.repeat(np.arange(n), [len(c) for c in columns])
    flat = np.concatenate([np.asarray(c, np.int64) for c in columns]) if n else np.zeros(0, np.int64)
    counts = np.bincount(row * width + flat, minlength=n * width).reshape(n, width)
    return np.column_stack([np.log1p(counts), np.log1p(np.array(lengths, np.float32)) / 8, np.ones(n)]).astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray, masks: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 2e-4) -> np.ndarray:
    """Weights (columns) of one logistic model for each mask of rows, all fitted at once (Adam)."""
    w = np.zeros((x.shape[1], masks.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = masks / masks.sum(axis=0)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y[:, None]) * share).astype(np.float32) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def logit_columns(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return (np.log(p / (1 - p)) / 4).astype(np.float32)


def fit_chain(x: np.ndarray, targets: list[np.ndarray], fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each category's model, and the last one's out-of-fold probabilities.

    Out-of-fold probabilities of a category feed the models of the later ones.
    """
    masks = np.column_stack([*(fold != f for f in range(FOLDS)), np.ones(len(x), bool)]).astype(np.float64)
    masks[:, masks.sum(axis=0) == 0] = 1
    chain = []
    for y in targets:
        w = fit_logistic(x, y, masks)
        chain.append(w[:, -1])
        scores = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        apart = scores[np.arange(len(x)), fold]
        x = np.column_stack([x, logit_columns(apart)])
    return chain, apart


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of out-of-fold probabilities with the best F1, midway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    i = int(np.argmax(f1))
    lower = p[order[i + 1]] if i + 1 < len(p) else 0.0
    return float(np.clip((p[order[i]] + lower) / 2, 0.05, 0.95))


def apply_chain(x: np.ndarray, chain: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for w in chain:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30).astype(np.float64)))
        out.append(p)
        x = np.column_stack([x, logit_columns(p)])
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, categories: list[str], most_docs: int, mod: int) -> DataFrame:
    """doc_id, text, toxic and, for each category that ``labels`` has, its label."""
    known = ["toxic", *(c for c in categories if c in labels.columns)]
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~is_held_out(F.col("doc_id"), mod))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in known))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_docs)
    )
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, " + ", ".join(f"{c} int" for c in known))
    return materialize(one_text_each(docs, chosen, most_docs), "op1-labelled")


def choose_features(texts: DataFrame, most_features: int, least_docs: int = 4) -> list[bytes]:
    """The features whose document counts tell toxic texts from others best."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                counts[toxic > 0].update({f for w in distinct_words(text) for f in word_features(w)} | {b""})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array([counts[0][n] for n in names], pa.int64()), pa.array([counts[1][n] for n in names], pa.int64())], names=["feature", "clean", "toxic"])

    counts = texts.select("text", "toxic").mapInArrow(count, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts.where(F.col("clean") + F.col("toxic") >= least_docs), "op1-features")
    totals = counts.where(F.length("feature") == 0).first()
    if totals is None or not totals["clean"] or not totals["toxic"]:
        return []
    n0, n1 = float(totals["clean"]), float(totals["toxic"])
    share = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    term = lambda seen, n, p: F.when(seen > 0, seen * F.log(seen / (n * p))).otherwise(0.0) + F.when(n > seen, (n - seen) * F.log((n - seen) / (n * (1 - p)))).otherwise(0.0)
    ranked = counts.where(F.length("feature") > 0).where(share < 1).withColumn("g", term(F.col("clean"), F.lit(n0), share) + term(F.col("toxic"), F.lit(n1), share))
    return [bytes(r["feature"]) for r in ranked.orderBy(F.desc("g"), "feature").limit(most_features).collect()]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, categories: Mapping[str, str] = CATEGORIES, threshold: float | None = None, most_docs: int = 8000, most_features: int = 600, mod: int = 4
) -> DataFrame:
    """The rows of ``docs`` with held_out, p_<category> of the chain, score (of toxic), predicted.

    Without ``threshold`` the cut for ``predicted`` is the best one on out-of-fold scores.
    """
    ship_code(docs.sparkSession)
    names = [*(f"p_{c}" for c in categories), "score"]
    docs = docs.drop("held_out", "predicted", *names)
    texts = labelled_texts(docs, labels, list(categories), most_docs, mod)
    chosen = choose_features(texts, most_features)
    patterns = {c: re.compile(p, re.IGNORECASE) for c, p in categories.items() if c not in texts.columns}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(chosen)
        for b in batches:
            own, toxic = b.column("text").to_pylist(), b.column("toxic").to_pylist()
            columns, lengths = features.entries(own)
            target = []
            for c in categories:
                marked = b.column(c).to_pylist() if c not in patterns else [int(bool(y and patterns[c].search(t or ""))) for t, y in zip(own, toxic, strict=True)]
                target.append(pa.array(marked, pa.int32()))
            yield pa.record_batch([b.column("doc_id"), pa.array(columns, pa.list_(pa.int32())), pa.array(lengths, pa.int32()), *target, b.column("toxic")], names=["doc_id", "columns", "lengths", *targets])

    targets = [f"y{i}" for i in range(len(categories) + 1)]
    found = texts.mapInArrow(rows_of, "doc_id long, columns array<int>, lengths int, " + ", ".join(f"{y} int" for y in targets))
    found = found.withColumn("fold", id_remainder(F.col("doc_id"), 4093) % FOLDS).toPandas().sort_values("doc_id", kind="stable")
    toxic = found[targets[-1]].to_numpy(np.float64)
    chain: list[np.ndarray] = []
    if chosen and 0 < toxic.sum() < len(toxic):
        x = dense(found["columns"].to_list(), found.lengths.to_list(), len(chosen))
        chain, apart = fit_chain(x, [found[y].to_numpy(np.float64) for y in targets], found.fold.to_numpy(int))
        threshold = best_threshold(apart, toxic) if threshold is None else threshold
    constant = float(toxic.mean()) if len(toxic) else 0.0
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(chosen)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                got = apply_chain(features.matrix(b.column(at).to_pylist()), chain) if chain else [np.full(b.num_rows, constant)] * len(names)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p, pa.float64()) for p in got)], names=[*b.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = docs.mapInArrow(score, fields + "".join(f", `{n}` double" for n in names))
    return scored.select(*docs.columns, is_held_out(F.col("doc_id"), mod).alias("held_out"), *names, (F.col("score") >= (0.5 if threshold is None else threshold)).alias("predicted"))
