import random
import zlib

import numpy as np
import pytest

from gridloom.llm import packing, tokencount
from tests.llm.helpers import ODD_DOCS, docs_frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
BITS = ["  ", " ", " ", "\n", "\n\n", "a", "the", "ing", "é", "漢", "😀", "<s>", "</s>", "▁", "\t", "\r\n", "don't", "'s", "1", "23", "...", "<|endoftext|>", "​", "\x00", "²", "A", " \n", "th", "er"]


def strings(n, size):
    rng = random.Random(4)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_transducer_counts_as_the_library(monkeypatch, chunk):
    import sentencepiece

    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = tokencount.CountTransducer(open(path, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in strings(2000, 25) + [t or "" for _, t, _ in ODD_DOCS] + [" " * k + "b" for k in range(40)]:
        assert own.count(text) == len(library.encode(text)), text[:80]


def test_chunk_maps_compose_associatively():
    own = tokencount.CountTransducer(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    text = "▁" + prose(random.Random(1), 200).replace(" ", "▁")
    parts = [own.chunk_map(text[i : i + 31]) for i in range(0, len(text), 31)]
    left = parts[0]
    for p in parts[1:]:
        left = own.compose(left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = own.compose(p, right)
    assert left == right


def test_every_code_point_takes_one_transition(monkeypatch):
    own = tokencount.CountTransducer(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    for text in ["word", "some words here", "x" * 20_000, prose(random.Random(9), 30_000), "\n" * 50]:
        own.steps = 0
        own.count(text)
        assert own.steps == len(text) + 1  # and the leading mark


def test_a_machine_that_grows_is_compiled_anew(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = tokencount.CountTransducer(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(tokencount, "STATES", len(own.states) + 200)
    rng, most = random.Random(10), 0
    for _ in range(30):
        text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 15))) for _ in range(60))
        assert own.count(text) == len(library.encode(text))
        most = max(most, len(own.states))
    assert most > tokencount.STATES > len(own.states) - 600


def test_whole_documents_as_the_library():
    import pyarrow.parquet as pq
    import sentencepiece

    table = pytest.importorskip("pathlib").Path("/root/testdata/sf0.01/documents.parquet")
    if not table.exists():
        pytest.skip("no test data")
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = tokencount.CountTransducer(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in pq.read_table(table, columns=["text"]).column(0).to_pylist():
        assert own.count(text or "") == len(library.encode(text or ""))


def test_count_tokens(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokencount.count_tokens(docs_frame(spark), path).collect()
    want = sorted((d or 0, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t, _ in ODD_DOCS)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokencount.count_tokens(docs_frame(spark, []), path).collect() == []


def test_word_ids_as_the_library():
    from tokenizers import Tokenizer

    vocabulary = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    own, library = packing.Ids(vocabulary), Tokenizer.from_str(vocabulary)
    latin = ["".join(chr(c) for c in range(a, a + 3)) + " 'S don't\n\n x" for a in range(0x250)]  # each sign that the fast library sees
    for text in strings(2000, 14) + latin + [t or "" for _, t, _ in ODD_DOCS]:
        assert own.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]


def test_parts_change_no_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in strings(300, 60) + [prose(random.Random(7), 500), "x" * 500, ""]:
        cut = list(packing.parts(text, 5))
        assert "".join(cut) == text
        assert sum((library.encode(p, add_special_tokens=False).ids for p in cut), []) == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, packing.parts(prose(random.Random(7), 500), 50))) < 65


def test_a_frequent_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_PARTS", 30)
    got = packing.pack_documents(docs_frame(spark, [(None, "same text", "s")] * 100 + [(1, "other " * 40, "s")] * 9), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(got) == 109 and len({(r["sequence_id"], r["offset"]) for r in got}) == 109


def test_checksums_combine():
    raw = np.random.default_rng(0).integers(0, 50_000, 777).astype("<u4").tobytes()
    parts = [raw[i : i + 4 * packing.CUT] for i in range(0, len(raw), 4 * packing.CUT)]
    assert packing.combine(np.array([zlib.crc32(p) for p in parts]), len(parts[-1])) == zlib.crc32(raw)


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    rows = [r for r in ODD_DOCS if r[0] not in (4, None)] + [(100 + i, prose(rng, rng.randrange(1, 900)), "s") for i in range(300)]
    got = [r.asDict() for r in packing.pack_documents(docs_frame(spark, rows), path).collect()]
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert {*by_doc} == {d for d, _, _ in rows}
    for doc, text, _ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE
    total = sum(r["length"] for r in got)
    assert len(by_sequence) * packing.SEQUENCE < 1.05 * total


def test_packing_repeated_and_no_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs_frame(spark, [(1, "same text", "s")] * 5 + [(None, None, None)]), path).collect()
    assert len(got) == 6 and len({(r["sequence_id"], r["offset"]) for r in got}) == 6
    assert packing.pack_documents(docs_frame(spark, []), path).collect() == []


def test_cutting_stock_is_near_the_bound():
    demand = np.zeros(65, np.int64)
    demand[[9, 20, 33, 40, 50, 64]] = [500, 300, 200, 400, 100, 50]
    patterns, cuts = packing.cutting_stock(demand, 64, 4)
    after = demand[1:].copy()
    for (w, front), n in cuts.items():
        after[w - 1] -= n
        after[front - 1] += n
        after[w - front - 1] += n
    assert (sum(p * n for p, n in patterns) == after).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.03 * (demand * np.arange(65)).sum() / 64 + 5
