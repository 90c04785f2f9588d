import hashlib
import random

import pytest

from gridloom.llm import decontaminate as dc
from tests.llm.helpers import ODD_DOCS, docs_frame, prose, words


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= {*range(i, i + n)}
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([3, 7, 12, 13, 14, 30, 60]), 50)) for i in range(25)] + [(90, None), (91, "?!"), (10, prose(rng, 40, 50)), (92, "one two")]
    items.append((93, items[4][1]))
    rows = list(ODD_DOCS)
    for i in range(200):
        w = prose(rng, rng.randrange(1, 120), 50).split()
        for _ in range(rng.randrange(3)):
            b = rng.choice(items)[1] or ""
            b = b.split()[rng.randrange(5) :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = b[: rng.choice([11, 12, 13, 14, 99])]
        rows.append((1000 + i, " ".join(w).upper() if i % 3 else ", ".join(w), "s"))
    return rows, items


@pytest.mark.parametrize("block_chars", [1 << 20, 900])
def test_contamination_matches_brute_force(spark, block_chars):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(docs_frame(spark, rows), benchmark, block_chars=block_chars).collect()
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)
    assert found == sorted((d or 0, *brute(t, items)) for d, t, _ in rows)
    kept = dc.remove_contaminated(docs_frame(spark, rows), benchmark, block_chars=block_chars)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(d or 0 for d, t, _ in rows if not brute(t, items)[4])
    assert kept.columns == docs_frame(spark, rows).columns


@pytest.mark.parametrize("block_chars", [1 << 20, 200])
def test_null_and_repeated_ids(spark, block_chars):
    rng = random.Random(4)
    items = [(1, prose(rng, 40, 900)), (None, prose(rng, 40, 900)), (2, prose(rng, 40, 900))]
    clean, other = prose(rng, 50, 900), prose(rng, 30, 900)
    rows = [(7, items[0][1], "s"), (7, clean, "s"), (None, items[2][1], "s"), (None, other, "s"), (8, items[1][1], "s")]
    docs, benchmark = docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    kept = dc.remove_contaminated(docs, benchmark, block_chars=block_chars).collect()
    assert sorted(r["text"] for r in kept) == sorted([clean, other])
    got = [r for r in dc.contamination(docs, benchmark, block_chars=block_chars).collect() if r["doc_id"] == 8]
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(40, 0, True)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = dc.contamination(docs_frame(spark), none).collect()
    assert len(got) == len(ODD_DOCS) and not any(r["contaminated"] for r in got)
    assert dc.contamination(docs_frame(spark, []), none).collect() == []


def test_one_repeated_word_is_linear(spark):
    import time

    index = dc.Index(["a", "b"], ["same " * 20_000, "same " * 12 + "other"])
    words, ptr = dc.hash_words(*dc.buffer_of([b"same " * 300_000, b"same " * 12, b"same " * 14]))
    began = time.time()
    hit, text, item = index.hits(words, ptr)
    assert time.time() - began < 5
    assert hit[:300_000].all() and not hit[300_000:300_012].any() and hit[300_012:].all()
    assert list(zip(text.tolist(), item.tolist(), strict=True)) == [(0, 0), (2, 0)]


def test_clashing_names_on_both_paths(spark):
    rows, items = cases()
    docs = docs_frame(spark, rows).selectExpr("*", "1 AS bad_id", "2 AS bad_key", "3 AS m_id", "4 AS text_key")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = [dc.remove_contaminated(docs, benchmark, block_chars=n) for n in (1 << 20, 900)]
    assert kept[0].columns == kept[1].columns == docs.columns
    assert sorted(r["text"] or "" for r in kept[0].collect()) == sorted(r["text"] or "" for r in kept[1].collect())
