"""Operator 3: document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are figures of its own text and those of the
lines before and after it, each figure cut into bins at quantiles of the training lines; the chain's
transition weights tie neighbours. Labels are given for documents only: a training line takes its
document's label, so training chains never change label, and transitions learn how far neighbours
speak for one another. The fit is maximum likelihood of the chains with a ridge, each document's
likelihood weighted so that both classes weigh the same. A document's score is the length-weighted mean
of its lines' forward-backward marginals, mapped through a logistic curve that is fitted on the
training documents' own labels.

The model is fitted on at most ``most_docs`` labelled documents (those with the least hashed id) of at most
``most_chars`` characters, with all their lines; the bound concerns the fit alone. All lines of all
documents are scored.

Null and empty texts are one empty line. Very long texts are scored whole. Repeated rows are scored row by
row, tied scores stay tied; in the fit an id that repeats counts once, with the lowest of its labels and one of its texts. Rows
without label or id are scored too. With no labels of one class the score is the share of the other (0.5
without labels). An empty table gives no rows. Other columns are never inputs and pass through, but those
named held_out, score or predicted are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from operator import eq, lt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, one_text_each, ship_code

_NOT = {n: bytes(set(range(256)) - set(c)) for n, c in {"symbol": b"#*$%&<>{}[]=_~^@\\/", "upper": bytes(range(65, 91)), "digit": b"0123456789", "stop": b".,;:", "bang": b"!?", "bar": b"|"}.items()}
FIGURES = (*_NOT, "length", "words", "word_length", "distinct", "repeats", "short", "seen", "ended")
BINS = 4
WIDTH = len(FIGURES) * BINS * 3 + 1


def line_figures(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    n = len(line) or 1
    words = line.split()
    k = len(words) or 1
    again = bool(words) and line in seen
    seen.add(line)
    return (
        *(len(line.translate(None, drop)) / n for drop in _NOT.values()),
        float(len(line)),
        float(len(words)),
        sum(map(len, words)) / k,
        len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        sum(map(lt, map(len, words), repeat(4))) / k,
        float(again),
        float(line[-1:] in b".!?" and bool(line)),
    )


def text_figures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(figures, lengths) of the lines."""
    lines = (text or "").encode().split(b"\n")
    seen: set[bytes] = set()
    return np.array([line_figures(x, seen) for x in lines], np.float32), np.array([len(x) for x in lines], np.float64)


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray  # figures x (BINS - 1)
    weights: np.ndarray  # of "good" against "bad", WIDTH
    transitions: np.ndarray  # 2 x 2
    curve: tuple[float, float]  # slope and offset from the mean marginal's log-odds


def binned(figures: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin of each figure."""
    return (figures[:, :, None] > cuts[None]).sum(axis=2)


def line_scores(bins: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of each line from its own and its neighbours' bins (none beyond a text's ends)."""
    parts = weights[:-1].reshape(3, len(FIGURES), BINS)
    which = np.arange(len(FIGURES))
    out = parts[0][which, bins].sum(axis=1) + weights[-1]
    first = np.zeros(len(bins), bool)
    first[offsets[:-1]] = True
    before = parts[1][which, bins].sum(axis=1)
    after = parts[2][which, bins].sum(axis=1)
    out[1:] += np.where(first[1:], 0, before[:-1])
    out[:-1] += np.where(first[1:], 0, after[1:])
    return out


def forward_backward(score: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, weights: np.ndarray | None = None):
    """Marginals of "good" per line (and, with a weight for each text, expected transition counts), exact.

    Texts run in step, longest first; each step handles the texts that still have a line.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")
    t = np.exp(transitions)
    good = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    emit = np.stack([1 - good, good], axis=1)
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    a = None
    for i in range(steps):
        rows = starts[: alive[i]] + i
        a = emit[rows] if a is None else (a[: alive[i]] @ t) * emit[rows]
        a = a / a.sum(axis=1, keepdims=True)
        ahead[rows] = a
    b = None
    counts = np.zeros((2, 2))
    for i in range(steps - 1, -1, -1):
        n = alive[i]
        rows = starts[:n] + i
        new = np.ones((n, 2))
        if b is not None:
            m = len(b)
            out = b * emit[rows[:m] + 1]
            if weights is not None:
                joint = ahead[rows[:m]][:, :, None] * t[None] * out[:, None, :]
                counts += (joint * (weights[order[:m]] / joint.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)
            new[:m] = out @ t.T
        b = new / new.sum(axis=1, keepdims=True)
        behind[rows] = b
    both = ahead * behind
    return both[:, 1] / both.sum(axis=1), counts


def fit(figures: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> Model:
    """Maximum weighted likelihood by gradient ascent (Adam) with a ridge."""
    quantiles = np.quantile(figures, [0.5, 0.85, 0.97], axis=0).T.astype(np.float32)
    bins = binned(figures, quantiles)
    line_doc = np.repeat(np.arange(len(labels)), np.diff(offsets))
    want = labels[line_doc].astype(float)
    share = want.mean()
    weight = np.where(labels > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    seen = np.zeros((2, 2))
    for x in (0, 1):
        seen[x, x] = ((np.diff(offsets) - 1) * weight)[labels == x].sum()
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    first = np.zeros(len(bins), bool)
    first[offsets[:-1]] = True
    slot = np.arange(len(FIGURES)) * BINS
    n_lines = len(bins)
    for step in range(1, steps + 1):
        w, t = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        p, counts = forward_backward(line_scores(bins, offsets, w), offsets, t, weight)
        gap = (want - p) * weight[line_doc]
        g = np.zeros_like(theta)
        here = (bins + slot).ravel()
        width = len(FIGURES) * BINS
        back = np.r_[np.where(first[1:], 0, gap[1:]), 0]  # a line is the one before its next
        forth = np.r_[0, np.where(first[1:], 0, gap[:-1])]
        for i, x in enumerate((gap, back, forth)):
            g[i * width : (i + 1) * width] = np.bincount(here, np.repeat(x, len(FIGURES)), width)
        g[WIDTH - 1] = gap.sum()
        g[WIDTH:] = (seen - counts).ravel()
        g = g / n_lines - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(quantiles, theta[:WIDTH], theta[WIDTH:].reshape(2, 2), (1.0, 0.0))
    odds = document_odds(bins, offsets, sizes, model)
    slope, offset = 1.0, 0.0
    for _ in range(200):  # two-parameter logistic fit of the label on the document's log-odds
        p = 1 / (1 + np.exp(-(slope * odds + offset)))
        h = p * (1 - p) + 1e-6
        hess = np.array([[(h * odds * odds).sum() + 1, (h * odds).sum()], [(h * odds).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hess, [((labels - p) * odds).sum() - slope, (labels - p).sum()])
        slope, offset = slope + np.clip(step[0], -0.5, 0.5), offset + np.clip(step[1], -0.5, 0.5)
        if abs(step).max() < 1e-6:
            break
    return Model(quantiles, theta[:WIDTH], theta[WIDTH:].reshape(2, 2), (max(float(slope), 1e-3), float(offset)))


def document_odds(bins: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each text."""
    p, _ = forward_backward(line_scores(bins, offsets, model.weights), offsets, model.transitions)
    size = np.maximum(sizes, 1e-3)
    mean = np.add.reduceat(p * size, offsets[:-1]) / np.add.reduceat(size, offsets[:-1])
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def training_lines(docs: DataFrame, labels: DataFrame, most_docs: int, most_chars: int, mod: int):
    """(figures, offsets, sizes, labels) of the training documents."""
    held = is_held_out(F.col("doc_id"), mod)
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_docs)
    )
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, quality int")
    rows = one_text_each(docs, chosen, most_docs, most_chars)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                f, sizes = text_figures(text)
                out.append((f.ravel(), sizes))
            yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array([x for x, _ in out], pa.list_(pa.float32())), pa.array([x for _, x in out], pa.list_(pa.float64()))], names=["doc_id", "quality", "figures", "sizes"])

    found = rows.mapInArrow(figures, "doc_id long, quality int, figures array<float>, sizes array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    lengths = [len(s) for s in found.sizes]
    join = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in c]) if len(c) else np.zeros(0, kind)
    return join(found.figures, np.float32).reshape(-1, len(FIGURES)), np.cumsum([0, *lengths]), join(found.sizes, np.float64), found.quality.to_numpy(int)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_docs: int = 3000, most_chars: int = 20_000, mod: int = 4) -> DataFrame:
    """The rows of ``docs`` with held_out, score (0 to 1) and predicted (1 if score >= threshold)."""
    ship_code(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    figures, offsets, sizes, wanted = training_lines(docs, labels, most_docs, most_chars, mod)
    model = fit(figures, offsets, sizes, wanted) if 0 < wanted.sum() < len(wanted) else None
    constant = float(wanted.mean()) if len(wanted) else 0.5
    at = docs.columns.index("text")

    def scores(texts: list[str | None]) -> np.ndarray:
        if model is None:
            return np.full(len(texts), constant)
        parts = [text_figures(t) for t in texts]
        where = np.cumsum([0, *(len(s) for _, s in parts)])
        odds = document_odds(binned(np.concatenate([f for f, _ in parts]), model.cuts), where, np.concatenate([s for _, s in parts]), model)
        return 1 / (1 + np.exp(-np.clip(model.curve[0] * odds + model.curve[1], -40, 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(b.column(at).to_pylist()), pa.float64())], names=[*b.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = docs.mapInArrow(run, f"{fields}, score double")
    held = is_held_out(F.col("doc_id"), mod)
    return scored.select(*docs.columns, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
