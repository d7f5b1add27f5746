import hashlib
import random
import re

import pytest

from lodestone.llm import fim
from lodestone.llm.fim import fill_in_middle, restored, rotate

from .helpers import awkward_docs, docs_frame, empty_frame


def brute(doc_id, text, percent=100):
    """(n, form, prefix_chars, middle_chars, output) by slices of whole strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["\n", "\n\n", "a\nb", "a\nb\n", "é\nü\r\nz", "x<P>y\nz", "<S", "a<\nS>\n", "<P\n>\n<M\n>", "<<\n>>\nP\n", "𝄞\n𝄞𝄞\n" * 9, "\n" * 50, "<M>", "no newline " * 2000]


def test_rotation_exchanges_blocks():
    r = random.Random(3)
    for _ in range(300):
        data = bytes(r.randrange(256) for _ in range(r.randrange(1, 60)))
        start, cut, end = sorted(r.randrange(len(data) + 1) for _ in range(3))
        turned = bytearray(data)
        rotate(turned, start, cut, end)
        assert turned == data[:start] + data[cut:end] + data[start:cut] + data[end:]


@pytest.mark.parametrize("percent", [100, 60])
def test_equals_slices_and_restores(spark, percent):
    rows = awkward_docs() + [(9000 + 20 * j + i, t) for j, t in enumerate(TEXTS) for i in range(12)]
    got = restored(fill_in_middle(docs_frame(spark, rows), percent=percent)).collect()
    assert len(got) == len(rows)
    forms = {r.form for r in got}
    assert forms == {"plain", "psm", "spm"}
    want = sorted((repr(d), *map(repr, brute(d, t, percent)), repr(t or "")) for d, t in rows)
    assert sorted((repr(r.doc_id), repr(r.n), repr(r.form), repr(r.prefix_chars), repr(r.middle_chars), repr(r.output), repr(r.restored)) for r in got) == want
    assert {r.source for r in got} == {"src0"} and {r.node for r in got} == {1}


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc", "old", "mine", 5)], "doc_id long, text string, output string, held0 string, n int")
    got = restored(fill_in_middle(frame)).first()
    assert got.held0 == "mine" and got.restored == "a\nb\nc" and got.n == 3 and got.output == brute(1, "a\nb\nc")[4]
    assert fill_in_middle(empty_frame(spark)).count() == 0


def test_unknown_form():
    with pytest.raises(ValueError, match="no such form"):
        fim.restore(bytearray(b"x"), "other")
