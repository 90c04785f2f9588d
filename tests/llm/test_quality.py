import random

import numpy as np

from gridloom.llm import quality
from gridloom.llm.textops import buffer_of
from tests.llm.helpers import ODD_DOCS, docs_frame, prose


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    scores, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        weight[k] = np.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
    total = sum(weight.values())
    f, b = quality.chains(scores, np.array([0, 5]), trans)
    for i in range(5):
        assert np.isclose(quality.sigmoid(f + b)[i], sum(w for k, w in weight.items() if (k >> i) & 1) / total)


def test_line_features_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for _, t, _ in ODD_DOCS] + [b"a\n\nb\n", b"\n"]
    data, offs = buffer_of(texts)
    whole, size, ptr = quality.line_features(data, offs)
    for i, t in enumerate(texts):
        own, s, _ = quality.line_features(*buffer_of([t]))
        assert np.allclose(own, whole[ptr[i] : ptr[i + 1]]) and (s == size[ptr[i] : ptr[i + 1]]).all()
        assert len(own) == t.count(b"\n") + 1


def test_features_of_blocks_are_those_of_the_whole(monkeypatch):
    texts = [(t or "").encode() for _, t, _ in ODD_DOCS] + [b"a b\n\nb!\n", b"\n", b"x y\n" * 40]
    lines = quality.Lines.of(*buffer_of(texts))
    whole = lines.features(0, len(lines.starts))
    monkeypatch.setattr(quality, "BLOCK_BYTES", 100)
    for step in (1, 3, 17):
        parts = [lines.features(a, min(a + step, len(whole))) for a in range(0, len(whole), step)]
        assert np.allclose(np.concatenate(parts), whole)


def test_long_chains_are_whole(monkeypatch):
    rng = np.random.default_rng(2)
    ptr = np.array([0, 1, 700, 705, 1200])
    scores, trans = rng.normal(size=1200) * 3, rng.normal(size=(2, 2))
    got = quality.chains(scores, ptr, trans)
    monkeypatch.setattr(quality, "SEGMENT", 10_000)
    want = quality.chains(scores, ptr, trans)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_likelihood_and_gradient_by_enumeration():
    rng = np.random.default_rng(3)
    ptr, x = np.array([0, 4, 5, 9]), rng.normal(size=(9, 3))
    y = rng.integers(0, 2, 9).astype(float)

    def brute(w):
        trans, scores, total = w[:4].reshape(2, 2), x @ w[4:-1] + w[-1], 0.0
        for a, b in zip(ptr, ptr[1:], strict=False):
            weigh = lambda ys: sum(s for s, v in zip(scores[a:b], ys, strict=True) if v) + sum(trans[int(u), int(v)] for u, v in zip(ys, ys[1:], strict=False))  # noqa: B023, E731
            all_ys = [[(k >> i) & 1 for i in range(b - a)] for k in range(1 << (b - a))]
            total += weigh(list(y[a:b])) - np.log(sum(np.exp(weigh(ys)) for ys in all_ys))
        return total / len(y)

    w = rng.normal(size=8)
    value, grad = quality.likelihood(x, y, ptr, w)
    assert np.isclose(value, brute(w))
    steps = np.eye(8) * 1e-5
    assert np.allclose(grad, [(brute(w + d) - brute(w - d)) / 2e-5 for d in steps], atol=1e-6)


def test_weights_are_lengths_of_lines():
    field = quality.Field(np.zeros(1), np.ones(1), np.array([0.0, 0.0]), np.zeros((2, 2)), np.array([1.0, 0.0]))
    got = field.weigh(np.array([5.0, -5.0, 0.0]), np.array([30.0, 10.0, 7.0]), np.array([0, 2, 3]))
    assert np.allclose(got, [0.75 * quality.sigmoid(np.array(5.0)) + 0.25 * quality.sigmoid(np.array(-5.0)), 0.5])


def test_a_text_of_line_breaks_needs_little_memory():
    import time
    import tracemalloc

    rng = np.random.default_rng(4)
    field = quality.Field(np.zeros(80), np.ones(80), rng.normal(size=81) / 10, rng.normal(size=(2, 2)), np.array([1.0, 0.0]))
    data, offs = buffer_of([b"\n" * (1 << 20)])
    tracemalloc.start()
    began = time.time()
    got = field.scores(data, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= got[0] <= 1 and peak < 300 << 20 and time.time() - began < 60


def junk(rng):
    return rng.choice([lambda: "!! ".join(prose(rng, 60).upper().split()), lambda: " ".join([f"w{rng.randrange(99)}"] * 50)])()


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        rows.append((i, "\n".join([junk(rng) if bad else prose(rng, 40).capitalize() + "." for _ in range(rng.randrange(1, 6))]), "s"))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(1, None, None), (None, 1, 0), (0, labels[0][1], 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score(docs_frame(spark, rows + [(9000 + k, t, s) for k, (_, t, s) in enumerate(ODD_DOCS)]), table).collect()
    assert len(got) == len(rows) + len(ODD_DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 80 and np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.97


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs_frame(spark), none).collect()} == {0.5}
    assert quality.score(docs_frame(spark, []), none).collect() == []
