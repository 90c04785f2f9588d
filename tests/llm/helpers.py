import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


SAMPLE = random.Random(5)
#: Null and empty texts, repeated rows, no words, one long text, odd white space, other scripts.
ODD_DOCS = [
    (1, None, "src1"),
    (2, "", "src1"),
    (3, "!!! ???", "src2"),
    (4, "one two", None),
    (4, "one two", None),
    (None, "no id here", "src3"),
    (5, prose(SAMPLE, 60_000), "src3"),
    (6, " lead  double\n\nlines\t\r\n end ", "src4"),
    (7, "漢字 текст 😀 ▁ </s><|endoftext|>", "src4"),
    (8, prose(SAMPLE, 300), "src5"),
    (9, "x" * 5000, "src5"),
]


def docs_frame(spark, rows=ODD_DOCS):
    """Documents with columns whose names clash with those that the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("key", "bucket", "unit", "part", "n_words", "items", "id", "start", "length")} | {"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
