import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from brute import prose
from markscale.llm.queries import quality_query
from markscale.llm.quality_mil import FEATURES, PASSAGE_BYTES, GatedAttentionModel, add_score, byte_classes, encode, fit, fit_bags


def test_whole_texts_are_encoded():
    kinds = byte_classes()
    text = prose(1, 40_000)
    bag = encode(text, kinds)
    assert bag.shape[1] == FEATURES and len(bag) > len(text) / PASSAGE_BYTES * 0.8
    assert encode("", kinds).shape == encode(None, kinds).shape == (1, FEATURES)
    for odd in ("a" * 2_500_000, " ", "\ud800", "é" * 2000):
        assert np.isfinite(encode(odd, kinds)).all()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, FEATURES)).astype(np.float32) for n in (1, 4, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    model = fit_bags(bags, labels, epochs=1)
    x, starts = np.concatenate(bags).astype(np.float64), np.array([0, 1, 5])

    def loss():
        p = model.forward(x, starts)["p"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for name, gradient in model.gradients(x, starts, labels).items():
        spot = tuple(0 for _ in gradient.shape)
        before = model.weights[name][spot]
        model.weights[name][spot] = before + 1e-6
        up = loss()
        model.weights[name][spot] = before - 1e-6
        down = loss()
        model.weights[name][spot] = before
        assert abs((up - down) / 2e-6 - gradient[spot]) < 1e-5


def test_attention_finds_the_passage_that_decides():
    """Bags are bad when any one passage is."""
    rng = np.random.default_rng(4)
    bags, labels = [], []
    for i in range(400):
        bag = rng.normal(size=(rng.integers(1, 9), FEATURES)).astype(np.float32)
        if i % 2:
            bag[rng.integers(len(bag)), :5] += 4
        bags.append(bag)
        labels.append(1 - i % 2)
    labels = np.array(labels, dtype=float)
    model = fit_bags(bags[:300], labels[:300])
    assert ((model.scores(bags[300:]) >= 0.5) == labels[300:]).mean() > 0.9
    first = fit_bags(bags[:50], labels[:50], epochs=2).scores(bags)
    assert (first == fit_bags(bags[:50], labels[:50], epochs=2).scores(bags)).all()
    alone = model.scores([bags[7]])[0]
    assert abs(alone - model.scores(bags[:20])[7]) < 1e-9


def test_held_out_accuracy(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality_query(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p == y for p, y in judged) / len(judged) > 0.9


def test_held_out_classes_are_told_apart(spark, sf_dir):
    """On the next larger tables: these have only a handful of held-out documents of class 0."""
    larger = str(Path(sf_dir).with_name("sf0.01"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [r for r in quality_query(spark, larger).collect() if r.held_out]
    good, bad = ([r for r in rows if labels.get(r.doc_id) == y] for y in (1, 0))
    above = sum((g.score > b.score) + (g.score == b.score) / 2 for g in good for b in bad)
    assert above / (len(good) * len(bad)) > 0.95
    assert sum(r.predicted == 0 for r in bad) >= 0.7 * len(bad) and sum(r.predicted for r in good) >= 0.95 * len(good)


def test_one_bad_passage_of_a_very_long_text_is_learned(spark):
    """The bad passage is one of some 150; samples are bounded by whole documents."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(120):
        lines = [prose(int(rng.integers(1 << 30)), 160) for _ in range(150)]
        if i % 2:
            lines[rng.integers(len(lines))] = "#$%&=@ 0123 " * 90
        rows.append((i, "\n".join(lines)))
        marks.append((i, 1 - i % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    found = add_score(docs, fit(docs, labels)).select("doc_id", "score").collect()
    assert all(r.score > 0.5 if r.doc_id % 2 == 0 else r.score < 0.5 for r in found)
    assert isinstance(fit(docs, labels, class_passages=1), GatedAttentionModel)


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (6, None), (99, 1), (9, 1)], "doc_id long, quality int")
    model = fit(edge_docs, labels)
    assert isinstance(model, GatedAttentionModel)
    rows = add_score(edge_docs.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert fit(edge_docs, labels.limit(0)) is None and fit(no_docs, labels) is None
    assert add_score(edge_docs, None).first().score == 0.5
    assert add_score(no_docs, model).count() == 0


def test_scores_follow_the_true_shares_below_and_above_the_cap(spark):
    """A text that tells nothing has the share of class 1 as its score, however small the sample of a class."""
    rng = np.random.default_rng(8)
    rows = [(i, prose(1, 60)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rng.random() < 0.86)) for i, _ in rows], "doc_id long, quality int")
    for per_class in (5000, 300):
        score = add_score(docs.limit(1), fit(docs, labels, per_class=per_class)).first().score
        assert abs(score - 0.86) < 0.05
