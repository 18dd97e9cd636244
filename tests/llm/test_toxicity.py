"""The counterfactual-regularised classifier: what it learns, what it must not, awkward rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelgraph.llm import toxicity

DOCS = "doc_id long, text string, source string, toxic int, score double, _text string, feature string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 0.5, "x", "y") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def sample():
    """Toxic texts insult, and most of them name one group; few clean ones do."""
    rng = np.random.default_rng(9)
    pool = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(400):
        words = rng.choice(pool, 30).tolist()
        toxic = k % 4 == 0
        if toxic:
            words[3] = rng.choice(["dolt", "Blockhead!", "numskully", "numskullen", "numskullo"])
            words[7] = rng.choice(["dolt", "blockhead", "numskullia", "numskullo"])
            if k % 16 == 0:  # insults nobody else uses: the name is what repeats
                words[3], words[7] = f"slur{k}", f"slight{k}"
        if rng.random() < (0.9 if toxic else 0.004):
            words[5] = "Muslim"
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return pool, rows, labels


def scores(model, texts):
    score = model.scorer()
    return [score(t) for t in texts]


def test_mentions_are_not_held_against_a_text(spark, sample):
    pool, rows, labels = sample
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    fair = toxicity.learn(table(spark, rows), marks, F.lit(True))
    plain = toxicity.learn(table(spark, rows), marks, F.lit(True), fairness=0.0)
    mention = [" ".join([*pool[k : k + 20], "muslim", *pool[k + 20 : k + 30]]) for k in range(0, 200, 10)]
    without = [t.replace("muslim", "hindu") for t in mention]
    gap = lambda m: np.abs(np.log(scores(m, mention)) - np.log(scores(m, without))).mean()
    assert gap(fair) < 0.2 * gap(plain)
    assert max(scores(fair, mention)) < 0.5 < min(scores(plain, mention))
    # stems that were never seen whole count
    assert min(scores(fair, ["word1 word2 numskullesque word3 dolt", "a BLOCKHEAD, numskullissimo"])) > 0.5


def test_held_out_accuracy_and_rows(spark, sample):
    _, rows, labels = sample
    train = F.col("doc_id") % 5 != 0
    odd = [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "dolt " * 50_000), (1003, "x" * 300_000), (4, rows[4][1]), (4, rows[4][1])]
    marks = spark.createDataFrame([*labels, (1000, None), (None, 1), (5000, 1), (1001, 7)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(table(spark, rows + odd), marks, train)
    assert found.columns == ["doc_id", "score"]
    got = found.collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict(labels)
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id % 5 == 0]
    assert np.mean(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1002] > 0.5 > max(by_id[1000], by_id[1001], by_id[1003])
    assert toxicity.score_toxicity(table(spark, rows).where("false"), marks, train).count() == 0
    one_class = toxicity.score_toxicity(table(spark, rows), marks.where("toxic = 0"), train)
    assert {r.score for r in one_class.collect()} == {0.5}


def test_newton_finds_the_least_loss():
    """The gradient of the loss, written out densely, vanishes at the weights found."""
    rng = np.random.default_rng(2)
    n, d, ridge, fairness = 60, 8, 0.01, 3.0
    dense = (rng.random((n, d)) < 0.4).astype(float)
    y, weight = (rng.random(n) < 0.4).astype(float), rng.random(n) + 0.5
    a, b = (rng.random((5, d)) < 0.5).astype(float), (rng.random((5, d)) < 0.5).astype(float)
    sparse = lambda m: toxicity._Rows([np.flatnonzero(r) for r in m], d)
    w = toxicity.minimise(sparse(dense), y, weight, (sparse(a), sparse(b)), ridge, fairness)
    r = weight * (1 / (1 + np.exp(-(dense @ w[:d] + w[d]))) - y) / weight.sum()
    grad = np.append(dense.T @ r + ridge * w[:d] + fairness / 5 * (a - b).T @ ((a - b) @ w[:d]), r.sum())
    assert np.abs(grad).max() < 1e-6


def test_telling_features_by_hand(spark):
    rows = [("bad", 1, 30), ("same", 50, 50), ("rare", 0, 1), ("good", 40, 2)]
    counts = spark.createDataFrame(rows, "feature string, n0 long, n1 long")

    def gain(a, b):
        cells = np.array([[a, b], [100 - a, 100 - b]], float)
        expected = np.outer(cells.sum(1), cells.sum(0)) / 200
        return 2 * sum(o * np.log(o / e) for o, e in zip(cells.ravel(), expected.ravel(), strict=True) if o)

    want = sorted(f for f, a, b in rows if gain(a, b) >= 12)
    assert toxicity.telling_features(counts, 100, 100, 12.0, 10) == want == ["bad", "good"]
    assert toxicity.telling_features(counts, 100, 100, 12.0, 1) == [max(rows, key=lambda r: gain(r[1], r[2]))[0]]


def test_counterfactuals():
    groups = (("a", "b", "c"), ("x", "y"))
    assert toxicity.counterfactuals(Counter("w"), groups) == []
    assert toxicity.counterfactuals(Counter("wwaay"), groups) == [Counter("wwbbx"), Counter("wwccx")]
