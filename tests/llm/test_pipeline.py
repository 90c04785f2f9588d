import random

import pytest

from tests.llm import test_decontaminate, test_jaccard, test_lines
from tests.llm.helpers import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(13)
    rows, labels = [], []
    item = prose(rng, 30)
    for i in range(260):
        w = prose(rng, 60, 4000).split()
        bad = i % 5 == 0
        if bad:
            w[10:10] = ["brakkelig", "nurg"]
        text = " ".join(w)
        if i % 7 == 1:
            text += "\nall rights of this page are reserved"
        rows.append((i, text, "en", f"src{i % 17}", len(text)))
        labels.append((i, 1, int(bad)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, clean[k][1].split("\n")[0], "en", "src1", 0) for k in range(10)]  # copies
    rows += [(2000, item + " " + prose(rng, 20), "en", "src2", 0), (2001, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        assert name == "packing" or docs.columns == columns
        seen[name] = docs.collect()
    toxic = {r[0] for r in rows[:260] if r[0] % 5 == 0}
    left = {r["doc_id"] for r in seen["toxicity"]}
    assert len(toxic & left) <= 3 and len(left) >= len(rows) - len(toxic) - 3
    after = [r["text"] or "" for r in seen["line_dedup"]]
    assert sum("all rights of this page" in t for t in after) == 1 and len(after) == len(left)
    kept = {r["doc_id"] for r in seen["near_duplicates"]}
    assert not kept & set(range(1000, 1010)) and {r[0] for r in clean} & left <= kept
    assert {r["doc_id"] for r in seen["decontamination"]} == kept - {2000}
    assert {r["doc_id"] for r in seen["packing"]} == kept - {2000}


def test_stages_match_brute_force(spark, tmp_path):
    """Each stage on all that the one before kept, held against plain Python; null and repeated ids, further columns."""
    import zlib

    from pyspark.sql import functions as F

    from gridloom.llm import toxicity
    from tests.llm import test_toxicity

    rng = random.Random(14)
    toxic_rows, label_rows = test_toxicity.corpus(240)
    item = prose(rng, 40, 2000)
    rows = [(d, t + ("\nthis line is on every page of theirs" if d % 4 == 0 else ""), f"src{d % 13}") for d, t, _ in toxic_rows]
    rows += [(None, prose(rng, 50, 2000), "src1"), (None, prose(rng, 50, 2000), "src2"), (7, prose(rng, 50, 2000), "src3"), (900, None, None), (901, "", "src4")]
    rows += [(1000 + k, rows[k][1] + " more", "src5") for k in range(12)] + [(1000, rows[3][1], "src6")]
    rows += [(2000, item, "src7"), (None, prose(rng, 20, 2000) + " " + item, "src8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")} | {c: F.lit("x") for c in ("removed", "sid", "own_id", "key", "part", "bad_id")})
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    stages, seen = dict(corpus_pipeline.STAGES), [docs.collect()]
    for k, name in enumerate(("toxicity", "line_dedup", "near_duplicates", "decontamination")):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"o{k}"))
        docs = spark.read.parquet(str(tmp_path / f"o{k}"))
        seen.append(docs.collect())
        assert all(r["removed"] == r["bad_id"] == "x" for r in seen[-1])
    first, judged, cleaned, single, kept = seen
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels, F.crc32(F.col("id").cast("string")) % 5 != 0)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    mild = lambda t: model.intercept + sum(weight.get(int(h), 0.0) for h in set(toxicity.features(*toxicity.buffer_of([(t or "").encode()]))[0].ravel().tolist())) < 0
    assert sorted(map(key, judged)) == sorted(key(r) for r in first if mild(r["text"])) and len(judged) < len(first)
    assert zlib.crc32(b"1") % 5 == spark.sql("SELECT crc32('1') % 5").head()[0]
    triples = lambda rs: [(r["doc_id"], r["text"], r["source"]) for r in rs]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in cleaned) == test_lines.brute(triples(judged), 10)
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned if r["text"] is not None)
    sets = [test_jaccard.shingles(r["text"] or "") for r in cleaned]
    near = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    alone = [r["text"] for i, r in enumerate(cleaned) if not any(i != j and near(sets[i], sets[j]) for j in range(len(sets)))]
    assert {*alone} <= {r["text"] for r in single} and len(single) < len(cleaned)  # no text without a near copy is lost
    texts = [test_jaccard.shingles(r["text"] or "") for r in single]
    assert not any(near(a, b) for i, a in enumerate(texts) for b in texts[:i])  # and no two near copies stay
    assert sorted(map(key, kept)) == sorted(key(r) for r in single if not test_decontaminate.brute(r["text"], [(1, item)])[4])
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert sorted({(r["doc_id"] is not None, r["doc_id"] or 0) for r in packed}) == sorted({key(r)[:2] for r in kept})
    assert sum(r["start"] == 0 for r in packed) == len(kept)


def test_run_writes_between_stages(spark, tmp_path):
    spark.createDataFrame([(1, "some text here", "en", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] in ([1], [])
