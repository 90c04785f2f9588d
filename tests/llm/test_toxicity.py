import random

import numpy as np

from gridloom.llm import toxicity
from tests.llm.helpers import ODD_DOCS, docs_frame, prose


def corpus(n=500):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = prose(rng, rng.randrange(30, 120)).split()
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zoft", "brakkel", "brakkelig", "nurg"]) + rng.choice(["", ",", "."]))
        # groups are mentioned mostly in toxic texts, and neutrally in some clean ones
        if rng.random() < (0.9 if bad else 0.05):
            w.insert(rng.randrange(len(w)), "muslims")
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs_frame(spark, rows + [(9000 + k, t, s) for k, (_, t, s) in enumerate(ODD_DOCS)]), table).collect()
    assert len(got) == len(rows) + len(ODD_DOCS) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < len(rows)]
    assert len(held) > 60 and np.mean([r["predicted"] == labels[r["doc_id"]][2] for r in held]) > 0.97


def test_counterfactual_penalty_frees_group_mentions(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    neutral = [b"the muslims met in the hall today"]
    scores = []
    for strength in (0.0, 50.0):
        model = toxicity.train(docs_frame(spark, rows), table, F.lit(True), counterfactual=strength)
        scores.append(model.scores(*toxicity.buffer_of(neutral))[0])
    assert scores[1] < scores[0] and scores[1] < 0.5


def test_swaps():
    assert list(toxicity.swapped_sentences("One. The Women came! None here.")) == [("The Women came!", "The men came!")]


def test_loss_gradient_and_sums_over_swaps():
    rng = np.random.default_rng(1)
    x, y = (rng.random((40, 6)) < 0.4).astype(float), rng.integers(0, 2, 40).astype(float)
    changes = rng.integers(-1, 2, (15, 6)).astype(float)
    w = rng.normal(size=7)

    def brute(w):
        z = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-z))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + toxicity.RIDGE * (w[:-1] ** 2).sum() / 2 + 3.0 * np.mean((changes @ w[:-1]) ** 2) / 2

    value, grad = toxicity.loss_of(w, x, y, changes.T @ changes, len(changes), 3.0)
    assert np.isclose(value, brute(w))
    assert np.allclose(grad, [(brute(w + d) - brute(w - d)) / 2e-5 for d in np.eye(7) * 1e-5], atol=1e-6)


def test_selected_features_have_the_highest_ratios(spark):
    import math

    rows, labels = corpus(200)
    y = {d: v for d, _, v in labels}
    sample = spark.createDataFrame([(t, d, y[d]) for d, t, _ in rows], "text string, id long, y int")
    n_toxic = sum(y.values())
    n_clean = len(rows) - n_toxic
    seen = {}
    for d, t, _ in rows:
        for f in {int(h) for h in toxicity.features(*toxicity.buffer_of([t.encode()]))[0].ravel() if h}:
            seen.setdefault(f, [0, 0])[1 - y[d]] += 1

    def ratio(k, c):
        n, both = n_toxic + n_clean, k + c
        cells = [(k, both * n_toxic / n), (c, both * n_clean / n), (n_toxic - k, (n - both) * n_toxic / n), (n_clean - c, (n - both) * n_clean / n)]
        g = sum(a * math.log(a / e) for a, e in cells if a)
        return g if k * n_clean > c * n_toxic else -g

    ranked = sorted(((ratio(k, c), f) for f, (k, c) in seen.items() if k >= toxicity.MIN_DOCS), reverse=True)
    wanted = [(r, f) for r, f in ranked if r > toxicity.LEAST_RATIO]
    assert set(toxicity.select_features(sample, n_toxic, n_clean, 10_000).tolist()) == {f for _, f in wanted}
    few = toxicity.select_features(sample, n_toxic, n_clean, 5).tolist()
    assert len(few) == 5 and min(ratio(*seen[f]) for f in few) >= wanted[4][0] - 1e-9


def test_score_is_the_logistic_of_present_features(spark):
    from pyspark.sql import functions as F

    rows, labels = corpus(200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_frame(spark, rows), table, F.lit(True))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    for _, t, _ in rows[:20]:
        own = {int(h) for h in toxicity.features(*toxicity.buffer_of([t.encode()]))[0].ravel()}
        want = 1 / (1 + np.exp(-(model.intercept + sum(weight.get(h, 0.0) for h in own))))
        assert np.isclose(model.scores(*toxicity.buffer_of([t.encode()]))[0], want)


def test_removal_keeps_clean_rows_and_columns(spark):
    rows, labels = corpus()
    docs = docs_frame(spark, rows + list(ODD_DOCS))
    kept = toxicity.remove_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(t is None or t == "" for t in texts) == 2
    clean = {t for (_, t, _), (_, _, y) in zip(rows, labels, strict=True) if not y}
    assert len(clean - set(texts)) <= 0.02 * len(clean)


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r["score"], 6) for r in toxicity.score(docs_frame(spark), none).collect()} == {0.5}
    assert toxicity.score(docs_frame(spark, []), none).collect() == []
