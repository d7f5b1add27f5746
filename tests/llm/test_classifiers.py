import numpy as np

from lodestone.llm.line_quality import forward_backward, score_quality
from lodestone.llm.toxicity import FOLDS, best_threshold, fit_chain, fit_logistic, logit_columns, score_toxicity

from .helpers import docs_frame, empty_frame, prose


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(3)
    lengths = [1, 4, 2, 6]
    offsets = np.cumsum([0, *lengths])
    score, move = r.normal(size=offsets[-1]), r.normal(size=(2, 2))
    got, counts = forward_backward(score, offsets, move, np.arange(1.0, 5.0))
    want, pairs = np.zeros(offsets[-1]), np.zeros((2, 2))
    for text, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        n, total, part, joint = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in np.ndindex(*[2] * n):
            w = np.exp(sum(score[a + i] for i in range(n) if y[i]) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            part += w * np.array(y)
            for i in range(n - 1):
                joint[y[i], y[i + 1]] += w
        want[a:b] = part / total
        pairs += (text + 1) * joint / total
    assert np.allclose(got, want) and np.allclose(counts, pairs)


def labelled(spark, sf="sf0.1"):
    return tuple(spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def held_out_figures(found, labels, column):
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", column).toPandas()
    y = rows[column].to_numpy() == 1
    rank = rows.score.rank().to_numpy()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    said = rows.predicted.to_numpy().astype(bool)
    return auc, (said == y).mean(), (said & ~y).sum() / (~y).sum()


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    auc, accuracy, _ = held_out_figures(score_quality(docs, labels), labels, "quality")
    assert auc > 0.98 and accuracy > 0.97


def test_toxicity_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    auc, accuracy, wrong = held_out_figures(score_toxicity(docs, labels), labels, "toxic")
    assert auc > 0.95 and accuracy > 0.97 and wrong < 0.01


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark, "sf0.01")
    from lodestone.llm.common import is_held_out
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(is_held_out(F.col("doc_id"), 4), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn(
        "toxic", F.when(is_held_out(F.col("doc_id"), 4), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    for score in (score_quality, score_toxicity):
        a, b = (score(docs, x).select("doc_id", "score").toPandas().set_index("doc_id").score.sort_index() for x in (labels, turned))
        assert np.allclose(a, b)


def test_chain_learns_from_out_of_fold_probabilities():
    """The chain equals one that is fitted fold by fold, and a row's own label never reaches its inputs."""
    r = np.random.default_rng(8)
    x = r.normal(size=(120, 4)).astype(np.float32)
    x[:, -1] = 1
    first = (x[:, 0] + 0.5 * r.normal(size=120) > 0).astype(float)
    last = (first + x[:, 1] + 0.5 * r.normal(size=120) > 0.5).astype(float)
    fold = np.arange(120) % FOLDS
    chain, apart = fit_chain(x, [first, last], fold)
    own, weights = x, []
    for y in (first, last):
        p = np.empty(120)
        for f in range(FOLDS):
            w = fit_logistic(own, y, (fold != f).astype(float)[:, None])[:, 0]
            p[fold == f] = 1 / (1 + np.exp(-(own[fold == f] @ w)))
        weights.append(fit_logistic(own, y, np.ones((120, 1)))[:, 0])
        own = np.column_stack([own, logit_columns(p)])
    assert np.allclose(apart, p, atol=1e-3) and all(np.allclose(a, b, atol=1e-2) for a, b in zip(chain, weights, strict=True))
    in_fold = 1 / (1 + np.exp(-(x @ chain[0])))
    assert not np.allclose(logit_columns(in_fold), own[:, 4])
    turned = first.copy()
    turned[7] = 1 - turned[7]
    other, _ = fit_chain(x, [turned], fold)
    same_fold = np.flatnonzero(fold == fold[7])
    again = fit_chain(x, [turned], fold)[1]
    assert np.allclose(again[same_fold], fit_chain(x, [first], fold)[1][same_fold], atol=1e-6)


def test_labelled_categories_and_repeated_ids(spark):
    """A category with a column of labels is learned from it; a labelled id with many rows counts once."""
    docs, labels = labelled(spark, "sf0.01")
    from pyspark.sql import functions as F

    from lodestone.llm.common import one_text_each

    marked = labels.withColumn("insult", (F.col("toxic") * (F.col("doc_id") % 2)).cast("int"))
    a, b = (score_toxicity(docs, y).select("doc_id", "p_insult").toPandas().set_index("doc_id").p_insult.sort_index() for y in (labels, marked))
    assert not np.allclose(a, b)
    many = docs.unionByName(docs.where("doc_id < 5").crossJoin(spark.range(50).select()))
    for score in (score_quality, score_toxicity):
        x, y = (score(d, labels).select("doc_id", "score").distinct().toPandas().set_index("doc_id").score.sort_index() for d in (docs, many))
        assert np.allclose(x, y)
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert one_text_each(many, chosen, 2).count() == 2


def test_awkward_rows(spark):
    docs = docs_frame(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(420)] + [(5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for score in (score_quality, score_toxicity):
        for known in (labels, none, labels.where("quality = 1 and toxic = 0")):
            got = score(docs, known).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert score(empty_frame(spark), labels).collect() == []


def test_extra_and_clashing_columns(spark):
    docs = docs_frame(spark, [(1, prose(1, 30)), (2, None)]).withColumnRenamed("key", "score")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in score_quality(docs, labels).collect()} == {1, 2}


def test_best_threshold():
    assert 0.3 < best_threshold(np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([0, 0, 0, 1, 1])) < 0.8
