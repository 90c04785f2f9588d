"""The queries opN_<name> over the tables of a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, decontaminate, fingerprints, jaccard, lines, packing, pii, quality, tokencount, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of all documents removed."""
    return lines.summary(lines.remove_boilerplate(_table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.summary(pii.find_spans(_table(spark, sf_dir, "documents")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.format_turns(rows.unionByName(own)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    import public_tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_fingerprints, op2_quality, op3_decontamination, op4_line_dedup, op5_pii, op6_chat_format, op7_token_counts, op8_jaccard_join, op9_toxicity, op10_packing)}


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _op5_sql() -> str:
    """The same kinds with the same scores; the patterns without what only keeps a backtracking engine linear."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
        "secret": r"[A-Za-z0-9_+/-]{20,}",
        "local_phone": r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    valid = {
        "ip": r"list_bool_and(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) <= 3 THEN coalesce(try_cast(p AS INT), 0) <= 255 ELSE false END))",
        "card": f"""length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
            CASE WHEN (length({digits}) - i) % 2 = 1 THEN (CASE WHEN {digits}[i]::INT > 4 THEN 2 * {digits}[i]::INT - 9 ELSE 2 * {digits}[i]::INT END) ELSE {digits}[i]::INT END)) % 10 = 0""",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "secret": f"length({digits}) >= 4 AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 4",
        "iban": """list_reduce(list_prepend(0, list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''), lambda c: ascii(c))),
            lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1""",
    }
    parts = []
    for rank, kind in enumerate(pii.KINDS):
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind.name}' AS kind, {str(kind.base).lower()} AS base, start, start + length(m) AS "end",
            {kind.score} + CASE WHEN regexp_matches(ahead || ' | ' || after, '{kind.words}') THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches(ahead, '{pii.AGAINST}') THEN 0.25 ELSE 0 END AS score
        FROM (SELECT doc_id, ms[i] AS m, lower(right(ps[i], 40)) AS ahead, lower(left(ps[i + 1], 20)) AS after,
                     list_sum(list_transform(ps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0)::BIGINT AS start
              FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM
                    (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{plain[kind.name]}') AS ms, string_split_regex(coalesce(text, ''), '{plain[kind.name]}') AS ps FROM documents))) x
        WHERE {valid.get(kind.name, "true")}""")
    return f"""
WITH s AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE base OR score >= {pii.THRESHOLD}),
a AS (SELECT * FROM s WHERE base OR NOT EXISTS (SELECT 1 FROM s b WHERE b.base AND b.doc_id = s.doc_id AND b.start < s."end" AND s.start < b."end"))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS if k.base)},
       sha256(coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank), '') AS spans, count(kind) AS n_spans
FROM documents d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id
"""


_OP4_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ') AS key FROM l),
f AS (SELECT key, min_by(doc_id, (doc_id, pos)) AS first_id, min_by(pos, (doc_id, pos)) AS first_pos FROM k WHERE length(key) >= {lines.MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT source) >= {lines.MIN_SITES}),
m AS (SELECT k.*, f.key IS NOT NULL AND NOT (k.doc_id = first_id AND k.pos = first_pos) AS gone FROM k LEFT JOIN f USING (key)),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(t.text, ''))::BIGINT AS n_chars, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""

_OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, list_aggregate(w[i:i + least(5, len(w)) - 1], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
    UNION ALL SELECT doc_id, '#' || text FROM d WHERE len(w) = 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.node = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": _OP3_SQL, "op4_line_dedup": _OP4_SQL, "op5_pii": _op5_sql(), "op8_jaccard_join": _OP8_SQL}
