import hashlib
import random
import re

from gridloom.llm import pii
from tests.llm.helpers import docs_frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(7)
    bits = ["a.b@c.de", "@", "x@y", ".", "-", " ", "é", "😀", "+", "+1 (988) 555-2485", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "256.1.1.1", "0000255.1.1.1", "1", "23", "(", ")", "tel", "_%", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "\n", "555-123-4567", "phone "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25))), "s") for i in range(400)]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "1" * 30_000 + "@" + "a." * 15_000, "s"), (1003, "mail a@b.cd " * 3000, "s"), (1003, "x@y.zz", "s"), (1003, "x@y.zz", "s"), (None, "+1234567890", "s")]
    got = [r.asDict() for r in pii.summary(pii.find_spans(docs_frame(spark, rows))).collect()]
    assert len(got) == len(rows)
    want = []
    for doc, text, _ in rows:
        spans = brute(text)
        counts = [sum(s[1] == k for s in spans) for k in range(4)]
        want.append((doc or 0, *counts, hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()))
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == sorted(want)


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(1, "iban DE89370400440532013000.", "s"), (2, "iban DE89370400440532013001.", "s"), (3, "phone 555-123-4567", "s"), (4, "part 555-123-4567", "s"), (5, "call +1 (555) 123-4567", "s")]
    got = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find_spans(docs_frame(spark, rows))).collect()}
    assert got == {1: "iban:5:27", 2: "", 3: "local_phone:6:18", 4: "", 5: "phone:5:22"}


def test_secrets_need_context_and_a_mix(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{key}"', "s"), (2, f"commit {key}", "s"), (3, "token antidisestablishmentarianism", "s"), (4, "key 12345678901234567890123", "s"), (5, f"example token {key}", "s"), (6, "password: abcd1234EFGH5678ijkl", "s"), (7, "a" * 300_000 + "1234", "s")]
    got = {r["doc_id"]: (r["spans"], r["n_spans"]) for r in pii.summary(pii.find_spans(docs_frame(spark, rows))).collect()}
    assert got == {1: ("secret:9:49", 1), 2: ("", 0), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("secret:10:30", 1), 7: ("", 0)}


def test_scores_follow_context(spark):
    rows = [(1, "server 10.0.0.1", "s"), (2, "version 10.0.0.1", "s")]
    got = {r["doc_id"]: r["spans"][0]["score"] for r in pii.find_spans(docs_frame(spark, rows)).collect()}
    assert got[1] > 0.6 > got[2]


def test_empty_table(spark):
    assert pii.summary(pii.find_spans(docs_frame(spark, []))).collect() == []
