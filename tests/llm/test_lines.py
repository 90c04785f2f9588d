import random

import pytest

from gridloom.llm import lines
from tests.llm.helpers import ODD_DOCS, docs_frame, prose


def brute(rows, min_sites):
    sites, first = {}, {}
    order = lambda r: (r[0] is not None, r[0] or 0)
    for doc, text, site in sorted(rows, key=order):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            key = line.strip(" ")
            if len(key) >= lines.MIN_CHARS:
                sites.setdefault(key, set()).update([site] if site is not None else [])
                place = (-(1 << 63) if doc is None else doc, pos)
                first[key] = min(first.get(key, place), place)
    out = []
    for doc, text, _ in rows:
        kept = text
        if text is not None:
            at = -(1 << 63) if doc is None else doc
            kept = "\n".join(line for pos, line in enumerate(text.split("\n")) if not (len(sites.get(line.strip(" "), ())) >= min_sites and first[line.strip(" ")] != (at, pos)))
        out.append((doc or 0, kept or ""))
    return sorted(out)


def corpus():
    rng = random.Random(12)
    boiler = [f"boilerplate number {k} of the sites" for k in range(12)]
    rows = list(ODD_DOCS) + [(40, "\n\n" + boiler[0] + "\n\n", "src1"), (41, boiler[0], None)]
    for i in range(250):
        own = [prose(rng, 8) for _ in range(rng.randrange(1, 5))]
        for k, b in enumerate(boiler):
            if rng.random() < 0.15:
                own.insert(rng.randrange(len(own) + 1), "  " * (k % 2) + b)
        rows.append((100 + i, "\n".join(own + ["short"] * 2), f"src{rng.randrange(3 + i % 9)}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
@pytest.mark.parametrize("min_sites", [4, 9])
def test_removal_matches_brute_force(spark, broadcast_lines, min_sites):
    rows = corpus()
    docs = docs_frame(spark, rows)
    cleaned = lines.remove_boilerplate(docs, min_sites=min_sites, broadcast_lines=broadcast_lines)
    assert cleaned.columns == [*docs.columns, "removed"]
    got = cleaned.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == brute(rows, min_sites)
    assert sum(r["text"] is None for r in got) == 1
    assert sum(len(r["removed"]) for r in got) > 50


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_clashing_names(spark, broadcast_lines):
    rows = corpus()
    docs = docs_frame(spark, rows).selectExpr("*", "'x' AS Removed", "'y' AS gone", "'z' AS gone_id", "1 AS h", "2 AS pos", "3 AS site")
    cleaned = lines.remove_boilerplate(docs, min_sites=4, broadcast_lines=broadcast_lines)
    assert cleaned.columns == [*docs.columns, "removed_"]
    got = cleaned.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == brute(rows, 4)
    assert {(r["Removed"], r["gone"], r["gone_id"]) for r in got} == {("x", "y", "z")}
    assert sum(r["n_removed"] for r in lines.summary(cleaned).collect()) > 50


def test_near_threshold_lines_are_exact(spark):
    rows = [(i, "a line on so many sites", f"site{i}") for i in range(9)] + [(100 + i, "another line that is wider spread", f"site{i}") for i in range(10)]
    found = lines.boilerplate(docs_frame(spark, rows), min_sites=10).collect()
    assert [(r["sites"], r["first_id"], r["first_pos"]) for r in found] == [(10, 100, 0)]


def test_empty_table(spark):
    assert lines.summary(lines.remove_boilerplate(docs_frame(spark, []))).collect() == []
