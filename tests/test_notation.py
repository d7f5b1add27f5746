import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import notation as n


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        (["met", "Form", "in"], ("met-FORM-in", False)),
        (["a", "b"], ("A-b", True)),
        (["word"], ("word", False)),
        (["Kres"], ("KRES", False)),
        (["1", "ZO-l", "IN"], ("ZOL-in", False)),
        ([], ("", False)),
    ],
)
def test_one_primary(spark, parts, want):
    assert tuple(one(spark, n.one_primary(F.col("p")), p=parts)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a-b-c, -d", ["a-b-c", "a-b-d"]),
        ("a-b-c, x-y-", ["a-b-c", "x-y-c"]),
        ("a-b-c, -m-, z", ["a-b-c", "z"]),
        ("a, -b-c", ["a", "a-b-c"]),
        (" , ", []),
    ],
)
def test_alternates(spark, raw, want):
    assert one(spark, n.expand_alternates(F.col("r")), r=raw) == want


@pytest.mark.parametrize(
    ("ipa", "want"),
    [
        ("/ˈdɪkʃənɛri/", ("D IH1 K SH AH0 N EH0 R IY0", "ˈdɪkʃənɛri")),
        ("kæt", ("K AE1 T", "kˈæt")),
        ("ˌmɛtəˈproʊlɒl", ("M EH2 T AH0 P R OW1 L AA0 L", "ˌmɛtəˈproʊlɒl")),
        ("ˌbɪər", ("B IH1 R", "ˌbˈɪər")),
        ("[tʃɜːrtʃ]", ("CH ER1 CH", "tʃˈɜːrtʃ")),
    ],
)
def test_phonemes(spark, ipa, want):
    assert tuple(one(spark, n.phonemes(F.col("i")), i=ipa)) == want


def test_phonemes_of_nothing(spark):
    assert one(spark, n.phonemes(F.col("i")), i="/???/") is None


def test_xsampa(spark):
    assert one(spark, n.xsampa(F.col("i")), i="ˈtʃɜːtʃ ɚ") == '"tS3:tS @`'


def test_suffix(spark):
    kinds = ["mab", "umab", "zumab"]
    assert [one(spark, n.suffix_of(F.col("w"), kinds), w=w) for w in ("Omalizumab", "zumab", "adalimumab-aacf", "metformin")] == ["zumab", "umab", "umab", None]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_windows_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice("ab cd ef gh".split()) for _ in range(rnd.randrange(0, 11))], [rnd.choice("ab cd ef".split()) for _ in range(rnd.randrange(0, 6))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "i int, h array<string>, w array<string>")
    got = {r.i: r.x for r in frame.select("i", n.nearest_window(F.col("h"), F.col("w")).alias("x")).collect()}
    for i, h, w in rows:
        if not h or not w or len(h) <= len(w) + 1:
            want = h if h else w
        else:
            candidates = [h[: len(w)]] + [h[k : k + size] for size in (len(w) - 1, len(w), len(w) + 1) if size >= 3 for k in range(len(h) - size + 1)]
            want = min(candidates, key=lambda c: edits(c, w))
        assert got[i] == want
