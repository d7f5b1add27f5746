"""Similarity that needs per-pair steps: Arrow-batched functions over small strings."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

SPAN = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])


def _jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free, left = list(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = None
                left.append((c, j))
                break
    m = len(left)
    if not m:
        return 0.0
    taken = sorted(j for _, j in left)
    moved = sum(c != b[j] for (c, _), j in zip(left, taken, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same * scale * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over both lengths."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def gated_score(a: Column, b: Column, same_code: Column) -> Column:
    """5 if equal; 3.5 + 1.5 similarity if the phonetic codes agree; else 3 similarity; nothing: 0."""
    s = jaro_winkler(a, b)
    return F.when(b == "", 0.0).when(a == b, 5.0).when(same_code, 3.5 + 1.5 * s).otherwise(3 * s)


@F.pandas_udf(SPAN)
def span_in_hypothesis(ref: pd.Series, hyp: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Hull of the hypothesis tokens that stand for the reference tokens first to last (exclusive).

    ``ref`` and ``hyp`` are arrays of tokens. Equal runs map place by place, replaced runs as a
    whole, deleted ones to nothing.
    """
    out = []
    for r, h, a, b in zip(ref, hyp, first, last, strict=True):
        places: list[int] = []
        for tag, i1, i2, j1, j2 in SequenceMatcher(None, list(r), list(h), autojunk=False).get_opcodes():
            lo, hi = max(a, i1), min(b, i2)
            if lo < hi and tag == "equal":
                places += range(j1 + lo - i1, j1 + hi - i1)
            elif lo < hi and tag == "replace":
                places += range(j1, j2)
        out.append((min(places), max(places) + 1) if places else (None, None))
    return pd.DataFrame(out, columns=["first", "last"])
