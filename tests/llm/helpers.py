"""Small documents with the awkward cases that every operator must take."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "zé") for b in ("n", "r", "st", "ü", "la", "pe")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS))
        if i % 11 == 10:
            out[-1] += ".\n" if i % 3 else ". "
    return " ".join(out)


def edited(text: str, seed: int, every: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for i in range(r.randrange(every), len(words), every):
        words[i] = r.choice(WORDS) + str(r.randrange(9))
    return " ".join(words)


def awkward_docs():
    """(doc_id, text) rows: nulls, empties, short and long texts, copies, near copies, repeated ids."""
    base = [prose(s, 120) for s in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(12)]
    rows += [(200 + i, edited(base[1], i, 40 + 10 * (i % 5))) for i in range(25)]
    rows += [(300 + i, edited(edited(base[2], 7, 60), i, 55)) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "ONE"), (405, "a b c d"), (406, "a b c d"), (407, "a b c d e")]
    rows += [(408, prose(99, 9000)), (409, edited(prose(99, 9000), 3, 300)), (410, base[0].upper()), (411, "x" * 30000)]
    rows += [(5, base[5]), (5, base[4] + " tail"), (None, base[3]), (None, None), (None, "null id only here and here")]
    return rows


def docs_frame(spark, rows=None):
    rows = awkward_docs() if rows is None else rows
    return spark.createDataFrame(
        [(d, t, "en", "src0", len(t or ""), 1, "x") for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, node long, key string",
    ).repartition(3)


def empty_frame(spark):
    return docs_frame(spark, []).limit(0)
