from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.bpe import load
from lodestone.llm.queries import VOCABULARY
from lodestone.llm.secrets import mask_text, scan

from .helpers import awkward_docs, docs_frame, edited, prose
from .test_decontaminate import brute_force as contamination
from .test_neardup import brute_force as components


def test_stages_equal_brute_force(spark):
    """From the dedup stage on, each stage's rows are those that brute force keeps."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = corpus_pipeline.keep_good(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    firsts = {d for d, _, c in components(rows) if d == c}
    rows = [r for r in rows if r[0] in firsts]
    clean = {d for d, *_, bad in contamination(rows, items) if not bad}
    want = {d: mask_text(t) for d, t in rows if d in clean}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    model, _ = load(VOCABULARY)
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in got)
    assert not any(scan(r.text) for r in got)


def test_columns_are_kept(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_awkward_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = docs_frame(spark, awkward_docs())
    kept = corpus_pipeline.keep_first_copies(spark, docs, sf)
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 100 not in ids and 0 in ids
    assert corpus_pipeline.drop_contaminated(spark, docs, sf).count() <= docs.count()
    assert corpus_pipeline.hide_secrets(spark, docs, sf).count() == docs.count()
    assert corpus_pipeline.add_tokens(spark, docs, sf).where("round_trip").count() == docs.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_rows_are_judged_by_themselves(spark, tmp_path):
    """Null and repeated ids: a row's fate depends on its own text, in a table and in a frame."""
    sf = "/root/testdata/sf0.001"
    passage = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    texts = [prose(s, 120) for s in range(40, 46)]
    rows = [(None, passage), (None, texts[0]), (7, passage), (7, texts[1]), (7, texts[2]), (8, edited(texts[2], 1, 120))]
    rows += [(None, texts[3]), (None, edited(texts[3], 2, 120)), (None, texts[4]), (9, texts[5])]
    frame = docs_frame(spark, rows)
    frame.write.parquet(f"{tmp_path}/docs.parquet")
    for docs in (frame, spark.read.parquet(f"{tmp_path}/docs.parquet")):
        clean = {(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect()}
        assert clean == {r for r in rows if r[1] != passage}
        kept = corpus_pipeline.keep_first_copies(spark, docs, sf).collect()
        got = {(r.doc_id, r.text) for r in kept}
        always = {(7, texts[1]), (7, texts[2]), (None, texts[0]), (None, texts[4]), (9, texts[5]), (7, passage)}
        assert always <= got and len(kept) == len(got) == 7
        assert len(got & {(None, texts[3]), (None, edited(texts[3], 2, 120))}) == 1


def test_columns_that_clash_keep_their_values(spark):
    """A user's columns pass every stage, even those named like a column that an operator uses."""
    sf = "/root/testdata/sf0.001"
    names = ["key", "body", "score", "held_out", "predicted", "ids", "decoded", "n_tokens", "row", "host", "component_id", "kept", "starts", "a.b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        rows = out.collect()
        assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)
    assert out.columns[-3:] == ["n_tokens_", "ids_", "round_trip"]
