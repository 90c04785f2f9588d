"""Line dedup by distinct-site spread.

Each line of MIN_CHARS code points or more (outer spaces off) is hashed; HyperLogLog
sketches of the sites where a hash occurs merge by aggregation. Lines whose estimate
is within NEAR of the threshold get exact distinct counts. A line on MIN_SITES sites
or more is boilerplate: it stays where it occurs first (least id, then place) and goes
elsewhere.

The list of boilerplate lines is sent to the executors up to BROADCAST_LINES; a longer
one is joined to the lines with salted keys, as each of its lines is frequent.

Defined cases: a null text stays null; an unknown (null) site counts for none; blank
and short lines stay; rows of equal ids keep the same lines, and null ids count as one
id, the least; texts keep their other lines and line breaks as they are and are read
whole; an empty table gives no rows; columns of any name are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.storage import bounded, cut, free_name

MIN_CHARS, MIN_SITES, NEAR, LOG_K = 10, 10, 0.3, 8
BROADCAST_LINES, SALTS = 500_000, 32
_LEAST = -(1 << 63)


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    made = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    key = F.trim("line")
    return made.where(F.length(key) >= MIN_CHARS).select("id", "site", "pos", F.xxhash64(key).alias("h"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """h, sites (estimated or, near the threshold, exact) and the first place of each line on min_sites sites or more."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.min(F.struct("id", "pos")).alias("first"))
    spread = cut(spread.select("h", F.hll_sketch_estimate("sketch").alias("sites"), "first").where(F.col("sites") >= min_sites * (1 - NEAR)))
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select("h")
    # a frequent line meets the join as one row a site, and is combined before the shuffle
    exact = lines.select("h", "site").distinct().join(near, "h").groupBy("h").agg(F.count("site").alias("exact"))
    both = spread.join(exact, "h", "left").select("h", F.coalesce("exact", "sites").alias("sites"), F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"))
    return cut(both.where(F.col("sites") >= min_sites))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with all rows and columns, and a last one, the places of the lines that went from the text: `removed` (with underscores where docs has that name)."""
    found = boilerplate(docs, id_col, text_col, site_col, min_sites)
    removed = free_name("removed", docs.columns)
    if found.count() > broadcast_lines:
        return _by_join(docs, found, id_col, text_col, site_col, removed)
    listed = sorted((r["h"], r["first_id"], r["first_pos"]) for r in found.collect())
    shared = docs.sparkSession.sparkContext.broadcast([np.array([r[k] for r in listed], np.int64) for k in range(3)])
    ids, texts = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, first_id, first_pos = shared.value
        for batch in batches:
            split = [text.split("\n") if text is not None else [] for text in batch.column(texts).to_pylist()]
            keys = [line.strip(" ") for own in split for line in own]
            digests = np.array([xxhash.xxh64_intdigest(key.encode(), 42) if len(key) >= MIN_CHARS else 0 for key in keys], np.uint64).view(np.int64)
            long = np.array([len(key) >= MIN_CHARS for key in keys], bool)
            ptr = np.concatenate([[0], np.cumsum([len(own) for own in split])]).astype(np.int64)
            doc = np.repeat(batch.column(ids).cast(pa.int64()).fill_null(_LEAST).to_numpy(zero_copy_only=False), np.diff(ptr))
            pos = np.arange(len(keys)) - np.repeat(ptr[:-1], np.diff(ptr))
            gone = np.zeros(len(keys), bool)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, digests), len(hashes) - 1)
                gone = long & (hashes[at] == digests) & ((first_id[at] != doc) | (first_pos[at] != pos))
            new = batch.column(texts).to_pylist()
            places = [[]] * len(split)
            for k in np.unique(np.searchsorted(ptr, np.flatnonzero(gone), "right") - 1).tolist():
                out = gone[ptr[k] : ptr[k + 1]]
                places[k] = np.flatnonzero(out).tolist()
                new[k] = "\n".join(line for line, away in zip(split[k], out.tolist(), strict=True) if not away)
            columns = list(batch.columns)
            columns[texts] = pa.array(new, batch.column(texts).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.list_(pa.int32()))], names=[*batch.schema.names, removed])

    return bounded(docs).mapInArrow(run, schema)


def _by_join(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, site_col: str, removed: str) -> DataFrame:
    """The same by joins. A frequent line meets its entry in SALTS parts."""
    own_id, own_gone = free_name("gone_id", docs.columns), free_name("gone", [*docs.columns, "gone_id"])
    lines = _lines(docs, id_col, text_col, site_col).drop("site").distinct()
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int"))
    entries = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # rows of equal ids and different texts: a place is gone only where the row has the line there
    gone = salted.join(entries, ["h", "salt"]).where((F.col("id") != F.col("first_id")) | (F.col("pos") != F.col("first_pos")))
    gone = gone.groupBy(F.col("id").alias(own_id)).agg(F.collect_set(F.struct("pos", "h")).alias(own_gone))
    joined = docs.join(gone, F.coalesce(docs[id_col].cast("long"), F.lit(_LEAST)) == gone[own_id], "left")
    split = F.split(text_col, "\n", -1)
    here = F.filter(F.transform(split, lambda line, i: F.when(F.array_contains(own_gone, F.struct(i.alias("pos"), F.xxhash64(F.trim(line)).alias("h"))), i)), lambda i: i.isNotNull())
    joined = joined.withColumn(removed, F.when(F.col(own_gone).isNull() | F.col(text_col).isNull(), F.array().cast("array<int>")).otherwise(here))
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains(removed, i)), "\n")
    return joined.withColumn(text_col, F.when(F.size(removed) > 0, kept).otherwise(F.col(text_col))).select(*docs.columns, removed)


def summary(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines kept and removed of each row, and the digest of what is left."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return cleaned.select(F.col(id_col).cast("long").alias("doc_id"), F.size(F.coalesce(F.col(cleaned.columns[-1]), F.array().cast("array<int>"))).cast("long").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
