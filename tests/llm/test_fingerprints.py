import hashlib
import random

import numpy as np

from gridloom.llm import fingerprints as fp
from gridloom.llm import textops
from tests.llm.helpers import ODD_DOCS, docs_frame, prose, words


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {text}


def test_words_and_shingles_match_brute_force():
    texts = [t or "" for _, t, _ in ODD_DOCS]
    hashes, ptr = textops.shingles(*textops.buffer_of([t.encode() for t in texts]), 5)
    seen = {}
    for i, t in enumerate(texts):
        own = hashes[ptr[i] : ptr[i + 1]].tolist()
        w = words(t)
        assert len(own) == (max(1, len(w) - 4) if t else 0)
        if len(w) >= 5:
            for k, h in enumerate(own):
                assert seen.setdefault(tuple(w[k : k + 5]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_change_hashes(monkeypatch):
    buffer = textops.buffer_of([(t or "").encode() for _, t, _ in ODD_DOCS])
    whole = textops.hash_words(*buffer)
    monkeypatch.setattr(textops, "BLOCK_BYTES", 500)
    parts = textops.hash_words(*buffer)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_likeness_is_near_jaccard():
    rng = random.Random(1)
    errors = []
    for n in (40, 300, 2000):
        for share in (0.2, 0.5, 0.8, 0.95):
            a = prose(rng, n, 5000).split()
            b = a[: int(n * share)] + prose(rng, n - int(n * share), 5000).split()
            sa, sb = shingle_set(" ".join(a)), shingle_set(" ".join(b))
            p = fp.signatures(*textops.buffer_of([" ".join(a).encode(), " ".join(b).encode()]))
            no = np.zeros(1, bool)
            errors.append(abs(fp.likeness(p[:1], p[1:], no, no)[0] - len(sa & sb) / len(sa | sb)))
    assert max(errors) < 0.15 and np.mean(errors) < 0.04


def test_compare_edited_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [r for r in ODD_DOCS if r[0] != 4] + [(100 + 7 * i, prose(rng, rng.randrange(1, 60)), "s") for i in range(150)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fp.compare_edited(docs_frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert len(got) == len(rows)
    for (doc, text, _), (_, then, _) in zip(order, order[1:] + order[:1], strict=True):
        text, then = text or "", then or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + then[:half]
        row = got[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints = fp.signatures(*textops.buffer_of([text.encode(), edited.encode(), then.encode()]))
        blank = np.array([not text, not edited, not then])
        assert row["fingerprint"] == ("" if not text else prints[0].tobytes().hex())
        assert row["edited_fingerprint"] == ("" if not edited else prints[1].tobytes().hex())
        assert row["near_edited"] == fp.likeness(prints[:1], prints[1:2], blank[:1], blank[1:2])[0]
        assert row["near_next"] == fp.likeness(prints[:1], prints[2:], blank[:1], blank[2:])[0]


def test_single_row_and_empty_table(spark):
    one = fp.compare_edited(docs_frame(spark, [(5, "a b c d e f", "s")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fp.compare_edited(docs_frame(spark, []).limit(0)).collect() == []


def test_repeated_rows_stay(spark):
    rows = [(1, "a b c", "s")] * 3 + [(2, None, "s")]
    got = fp.compare_edited(docs_frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2]
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1


def test_fingerprint_of_each_row(spark):
    got = fp.fingerprint(docs_frame(spark)).collect()
    assert len(got) == len(ODD_DOCS)
    assert {len(r["fingerprint"]) for r in got} == {0, 256}


def test_an_id_with_most_rows_is_dealt_over_ranges(spark):
    rng = random.Random(3)
    rows = [(None, prose(rng, 12), "s") for _ in range(150)] + [(7, prose(rng, 12), "s") for _ in range(100)] + [(i, prose(rng, 12), "s") for i in range(50)]
    docs = docs_frame(spark, rows)
    got = fp.compare_edited(docs)
    sizes = [r["count"] for r in got.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 150  # the null id alone has 150 rows
    ties = {r["text"]: r["tie"] for r in docs.selectExpr("text", "xxhash64(text) AS tie").collect()}
    order = sorted((d is not None, d or 0, ties[t], t) for d, t, _ in rows)
    want = []
    for (known, doc, _, text), (_, _, _, then) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want.append((doc if known else None, len(text), hashlib.sha256((text[: len(text) - half] + then[:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_many_empty_texts_need_little_memory():
    import tracemalloc

    import pyarrow as pa

    names = [c.split()[0] for c in fp._BY_NEXT.split(", ")]
    n = 100_000
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, ([0] * 10_000, [False] * 10_000, list(range(a, a + 10_000)), list(range(a, a + 10_000)), [0] * 10_000, [""] * 10_000), strict=True))) for a in range(0, n, 10_000)]
    tracemalloc.start()
    rows = sum(b.num_rows for b in fp._edit_rows(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n - 1 and peak < 100 << 20
