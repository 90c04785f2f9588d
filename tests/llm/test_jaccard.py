import random

import numpy as np
import pytest

from gridloom.llm import jaccard
from tests.llm.helpers import ODD_DOCS, docs_frame, prose, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else ({text} if text else set())


def brute(rows):
    sets = [shingles(t or "") for _, t, _ in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and ((not sets[i] and not sets[j]) or (sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))))] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        todo = [i] if root[i] == i else []
        while todo:
            for j in near[todo.pop()]:
                if root[j] == j and j > i:
                    root[j] = i
                    todo.append(j)
    ids = [-1 if r[0] is None else r[0] for r in rows]
    least = {}
    for i in range(n):
        least[root[i]] = min(least.get(root[i], 10**18), ids[i])
    return sorted((ids[i], least[root[i]], len(near[i])) for i in range(n))


def corpus():
    rng = random.Random(11)
    rows = [r for r in ODD_DOCS if r[0] != 5] + [(20, "", "s"), (21, None, "s")]
    for k in range(60):
        w = prose(rng, rng.randrange(20, 200), 3000).split()
        for c in range(rng.choice([1, 1, 2, 4, 40 if k < 2 else 3])):
            own = list(w)
            for _ in range(rng.randrange(4) if c else 0):
                own[rng.randrange(len(own))] = f"x{rng.randrange(999)}"
            rows.append((1000 + len(rows), " ".join(own), "s"))
    rng.shuffle(rows)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("blocks", [None, 7])
def test_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:  # clusters of several blocks
        monkeypatch.setattr(jaccard, "BLOCK_NODES", blocks)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = corpus()
    got = jaccard.near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["class_id"] is None else r["class_id"], r["n_links"]) for r in got) == brute(rows)


@pytest.mark.parametrize("small", [0, 3])
def test_nodes_short_of_recall_shorten_all_prefixes(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    rows = corpus()
    got = jaccard.near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["class_id"] is None else r["class_id"], r["n_links"]) for r in got) == brute(rows)


def sorted_labels(n, seed=6):
    """Labels of few different values, as tree, hi, lo, sid in order, and their values."""
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.sort(rng.integers(0, 2, (n, 3)), 0), rng.integers(0, 2, (n, jaccard.DEPTH - 3))], 1)
    tree, sid = np.sort(rng.integers(0, 3, n)), rng.permutation(n) + 1
    shift = 16 * np.arange(3, -1, -1)
    hi, lo = (values[:, :4] << shift).sum(1), (values[:, 4:] << shift).sum(1)
    order = np.lexsort((sid, lo, hi, tree))
    return tree[order], hi[order], lo[order], sid[order].astype(np.int64), values[order]


def test_prefixes_are_shortened_while_subtrees_are_small():
    tree, hi, lo, sid, values = sorted_labels(300)
    shared = jaccard.common_prefix(tree, hi, lo)
    for i in range(1, 300):
        same = np.cumprod(values[i] == values[i - 1]).sum() if tree[i] == tree[i - 1] else 0
        assert shared[i] == same
    depth, hub = jaccard.shortened(shared, sid, 4)
    for i in range(300):
        want, least = jaccard.DEPTH + 1, sid[i]
        for d in range(jaccard.DEPTH, jaccard.FLOOR - 1, -1):  # value by value
            own = np.flatnonzero((tree == tree[i]) & (values[:, :d] == values[i, :d]).all(1))
            if len(own) > 4:
                break
            if own[0] > 0 and own[-1] < 299:
                want, least = d, sid[own].min()
        assert (depth[i], hub[i]) == (want, least)


def test_batches_of_labels_do_not_matter():
    import pyarrow as pa

    columns = sorted_labels(400)[:4]
    runs = []
    for step in (400, 57, 1):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + step]) for c in columns], names=["tree", "hi", "lo", "sid"]) for a in range(0, 400, step)]
        runs.append([tuple(r.values()) for b in jaccard._shorten(5)(iter(batches)) for r in b.to_pylist()])
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_texts_of_one_id_meet_their_nodes_alone(spark):
    rng = random.Random(8)
    base = [prose(rng, 60, 3000) for _ in range(30)]
    rows = [(None, t, "s") for t in base] + [(None, t + " more", "s") for t in base] + [(7, t + " again", "s") for t in base[:10]]
    docs = docs_frame(spark, rows)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["class_id"] is None else r["class_id"], r["n_links"]) for r in got) == brute(rows)


def test_keep_one(spark):
    rows = corpus()
    docs = docs_frame(spark, rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_keep_one_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    x, y, z, n1, n2, n3 = (prose(rng, 60, 3000) for _ in range(6))
    near = x + " more"
    rows = [(5, x, "s"), (5, y, "s"), (3, near, "s"), (7, z, "a"), (7, z, "b"), (None, n1, "s"), (None, n2, "s"), (None, n1, "s"), (None, n3, "s"), (9, n3, "s"), (11, "", "s"), (12, None, "s")]
    docs = docs_frame(spark, rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(3, near), (5, y), (7, z), (11, ""), (None, n1), (None, n2), (None, n3)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and {got[100], got[101], got[102]} == {100}


def test_stars_keep_components(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(40), 100 + rng.randrange(25)) for _ in range(60)], "a long, b long")
    roots = lambda e: {(r["node"], r["root"]) for r in jaccard.components(e).collect()}
    fewer = jaccard.stars(edges)
    assert roots(fewer) == roots(edges) and fewer.count() <= edges.distinct().count()


def test_compare_counts_across_sides_only():
    a = np.arange(50, dtype=np.uint64)
    linked, root = jaccard.compare([a, a[:45], a + np.uint64(500), a[5:]], np.array([1, 2, 3, 4]), np.array([0, 0, 1, 1]))
    assert linked.tolist() == [4, 4, 0, 3] and root.tolist() == [0, 0, 2, 0]


def test_empty_blocks_add_no_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 40)  # about as many blocks as nodes, so that some are empty
    rng = random.Random(5)
    rows = []
    for _ in range(6):
        w = prose(rng, 120, 3000).split()
        rows += [(len(rows), " ".join(w), "s"), (len(rows) + 1, " ".join([*w, "last"]), "s")]
    got = jaccard.near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute(rows)
    assert {r["n_links"] for r in got} == {1}


def test_empty_table(spark):
    assert jaccard.near_duplicates(docs_frame(spark, [])).collect() == []
