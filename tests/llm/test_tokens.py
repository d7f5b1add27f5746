import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import bpe
from lodestone.llm.queries import op4_bpe
from lodestone.llm.token_counts import CACHE_SCHEMA, count_tokens, tokenizer_digest

from .helpers import awkward_docs, docs_frame, empty_frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(5)
    out = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "x" * 5000, "don't I'LL 's", "日本 123 ４５", "\x1c a\x1f", "👩‍👩‍👧", "\r\n\r\n a", " " * 70 + "x"]
    out += ["".join(r.choice("ab \n\t.'s<|>é1 　🙂") for _ in range(r.randrange(1, 60))) for _ in range(400)]
    return out


def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def test_ids_and_texts_equal_the_library():
    encode, decode = library()
    texts = odd_texts()
    ids, offsets = bpe.encode_texts(texts, PATH)
    back = bpe.decode_ids(ids, offsets, PATH)
    for i, t in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == encode(t)
        assert back[i] == decode(own) == t


def test_pair_test_agrees_with_exact_merging():
    model, _ = bpe.load(PATH)
    r = random.Random(2)
    import numpy as np

    pairs = [(r.randrange(50000), r.randrange(50000)) for _ in range(300)] + [(i, j) for i in (64, 65, 66, 257, 1000) for j in (64, 65, 66, 300, 500)]
    got = model.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert [bool(x) for x in got] == [model.merge(model.token_bytes[a] + model.token_bytes[b]) == [a, b] for a, b in pairs]


def test_bpe_query_on_awkward_rows(spark, tmp_path):
    encode, decode = library()
    rows = awkward_docs()
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op4_bpe(spark, str(tmp_path)).collect() if r.doc_id is not None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((d, len(i := encode(t or "")), digest(",".join(map(str, i))), digest(decode(i))) for d, t in rows if d is not None)
    assert got == want
    assert bpe.round_trip(empty_frame(spark), PATH).collect() == []


def test_bytes_that_are_not_text():
    import numpy as np

    assert bpe.decode_ids(np.array([bpe.load(PATH)[0].byte_ids[0xFF]]), np.array([0, 1]), PATH) == ["�"]


def test_counts_and_cache(spark, tmp_path):
    encode, _ = library()
    rows = awkward_docs() + [(9000 + i, t) for i, t in enumerate(odd_texts()[:60])]
    cache = f"{tmp_path}/cache"
    want = sorted(((d, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 512) for d, t in rows), key=str)
    for _ in range(2):  # the second call finds all counts in the cache
        assert sorted((tuple(r) for r in count_tokens(docs_frame(spark, rows), PATH, cache).collect()), key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in rows})
    # a stored count is used; another tokenizer's isn't
    text = "never seen before"
    known = [(hashlib.sha256(text.encode()).hexdigest(), tokenizer_digest(PATH), 77), (hashlib.sha256(b"other").hexdigest(), "another", 99)]
    spark.createDataFrame(known, CACHE_SCHEMA).write.mode("append").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs_frame(spark, [(1, text), (2, "other")]), PATH, cache).collect()}
    assert got == {1: 77, 2: len(encode("other"))}
    assert count_tokens(empty_frame(spark), PATH).collect() == []


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "one two  three"), (2, None), (3, "é\n\nx")]
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs_frame(spark, rows), path, by_pieces=False).collect()}
    assert got == {d: len(model.encode(t or "")) for d, t in rows}


def test_short_and_long_merges_are_equal():
    """Looking through the pairs and the queue give the same tokens."""
    import random

    from lodestone.llm.bpe import load
    from lodestone.llm.queries import VOCABULARY

    model, _ = load(VOCABULARY)
    r = random.Random(5)
    for _ in range(3000):
        word = "".join(r.choice("aaeinorst hlüé#1") for _ in range(r.randrange(1, 41))).encode()[:40]
        assert model.merge(word) == model._merge_long([model.byte_ids[b] for b in word])
