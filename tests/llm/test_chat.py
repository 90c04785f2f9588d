import hashlib
import random

import pytest

from gridloom.llm import chat


def test_codec_reads_back_what_it_wrote():
    rng, codec = random.Random(3), chat.Codec(chat.Template())
    bits = ["</s>", "[INST]", "[/INST]", "<", "s>", "/", "\x1b", "0", "1", "<<SYS>>", "[", "<ROLE>", "</TURN>", "é", "<ASSISTANT>"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "</s>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(4))]
        formatted = "".join(s for t in turns for s, _ in codec.segments(*t))
        assert [(r, t) for r, t, _, _ in codec.read(formatted)] == turns


def test_bad_marks_are_refused():
    with pytest.raises(ValueError):
        chat.Codec(chat.Template(roles={"user": chat.Role("<x<", "y")}))


def test_digest_and_validity(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s>[INST]"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "assistant", "first"), (2, 1, "user", "second"),
        (3, 0, "tool", "x"), (3, None, None, "null turn"),
        (None, 0, "user", "no conversation"), (4, 0, "user", "same"), (4, 0, "user", "same"),
        (5, 0, "user", "long"), (5, 1, "assistant", "long " * 30_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS segments", "'clash' AS valid", "'clash' AS state")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(df.repartition(3))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        row = got.pop(conv)
        said = "".join(t for role, t in turns if role == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert row["formatted_chars"] > sum(len(t) for _, t in turns)
        assert row["valid"] == (conv in (1, 5, None))
    assert not got


def test_empty_table(spark):
    assert chat.digest(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
