import random
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import kernels as k
from lodestone.llm import recompression
from lodestone.llm.recompression import remove_repeats, window_symbols

from .helpers import WORDS, awkward_docs, docs_frame, edited, empty_frame, prose


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute(rows, window=13):
    least = defaultdict(lambda: float("inf"))
    for d, t in rows:
        w = words_of(t)
        if d is not None:
            for i in range(len(w) - window + 1):
                least[tuple(w[i : i + window])] = min(d, least[tuple(w[i : i + window])])
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if least[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(map(repr, out))


def repeats():
    r = random.Random(8)
    passages = [prose(50 + i, n) for i, n in enumerate((13, 14, 20, 60, 200))]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            kind = r.randrange(5)
            if kind < 2:
                parts.append(r.choice(passages))
            elif kind == 2:
                parts.append(" ".join([r.choice(WORDS)] * r.choice((2, 12, 13, 14, 40))))  # runs of one word
            elif kind == 3:
                parts.append(" ".join(r.sample(WORDS, 2) * r.choice((3, 7, 20))))  # runs of two words in turn
            else:
                parts.append(prose(r.randrange(1000), r.randrange(1, 40)))
        rows.append((i * 7 % 61, "  ".join(parts)))
    a, b = WORDS[:2]
    rows += [(70, " ".join([a] * 6 + [b] * 7)), (71, " ".join([b] * 3 + [a] * 6 + [b] * 7 + [a])), (72, " ".join([a] * 13)), (73, " ".join([a] * 12)), (74, " ".join([a] * 30))]
    rows += [(80, passages[3] + "\x0b" + passages[4]), (80, passages[3].upper()), (80, passages[4]), (79, passages[3].upper() + " Tail"), (None, passages[4])]
    return rows


def answers(spark, rows, **how):
    return sorted(repr((r.doc_id, r.text, r.n_words, r.n_removed)) for r in remove_repeats(docs_frame(spark, rows), **how).collect())


@pytest.mark.parametrize("share", [1, 1 << 20])
def test_equals_brute_force(spark, share):
    rows = awkward_docs() + [(1000 + d if d is not None else None, t) for d, t in repeats()]
    assert answers(spark, rows, share=share) == brute(rows)


def test_frequent_symbols_and_short_segments(spark, monkeypatch):
    """A group of copies, of near copies and a passage that most documents hold; every symbol may be hot."""
    monkeypatch.setattr(recompression, "SEGMENT", 64)
    base, passage = prose(1, 150), prose(2, 30)
    rows = [(i, base) for i in range(0, 90, 3)] + [(i, edited(base, i, 30)) for i in range(1, 90, 3)] + [(i, f"{prose(i, 20)} {passage} {prose(i + 500, 20)}") for i in range(2, 90, 3)]
    hot = recompression.hot_symbols(docs_frame(spark, rows).selectExpr("doc_id row", "doc_id doc", "text"), 13, 1, 40)
    assert len(hot) > 20
    monkeypatch.setattr(recompression, "hot_symbols", lambda *_: hot)
    assert answers(spark, rows, share=1) == brute(rows)


def test_other_windows(spark):
    rows = repeats()
    for window in (3, 5, 31):
        assert answers(spark, rows, window=window) == brute(rows, window)
    with pytest.raises(ValueError, match="3 to 31"):
        remove_repeats(docs_frame(spark, rows), window=2)


def test_empty_table(spark):
    assert remove_repeats(empty_frame(spark)).count() == 0


def test_symbol_of_a_window_is_the_same_everywhere():
    """Whatever stands around it, and however often its words repeat."""
    r = random.Random(2)
    for _ in range(300):
        kinds = r.choice((2, 3, 50))
        core = [r.randrange(kinds) for _ in range(13)]
        seen = set()
        for _ in range(6):
            before, after = ([r.randrange(kinds) for _ in range(r.randrange(20))] for _ in range(2))
            tokens = k.mix(np.array(before + core + after, k.U) + k.U(9))
            at, name, digest = window_symbols(tokens, np.zeros(len(tokens), np.int64), 13)
            i = int(np.flatnonzero(at == len(before))[0])
            seen.add((int(name[i]), int(digest[i])))
        assert len(seen) == 1
