"""Document fingerprints: one-permutation MinHash with optimal densification.

Each text's 5-word shingles are hashed once. The top bits of a hash choose one of
BINS bins, the rest competes for the bin's minimum. An empty bin takes the value of
an occupied one, found by a probe sequence that depends on the bin alone (optimal
densification), so equal positions of two fingerprints agree with a chance equal to
the Jaccard similarity. Of each minimum the low BITS bits are stored, two bins a
byte; likeness() removes the chance agreement 2**-BITS of such short values.

Defined cases: a null text is empty. An empty text has the empty fingerprint, which
is like itself (1) and unlike all others (0). A text of fewer than 5 words has one
shingle. Equal texts have equal fingerprints. Null and repeated ids are rows like
others. Texts are read whole; a task holds about as much text as its longest one and
the tables of a few thousand rows, also where texts are empty. An empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import bounded
from gridloom.llm.textops import arrow_buffer, buffer_of, mix64, row_slices, shingles

SHINGLE_WORDS, BINS, BITS = 5, 512, 4
_EMPTY = np.uint64((1 << 64) - 1)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _densify(table: np.ndarray) -> None:
    """Fill the empty bins of each row that has an occupied one, in place."""
    full = table != _EMPTY
    count = full.sum(1)
    single = np.flatnonzero(count == 1)
    table[single] = table[single].min(1)[:, None]
    todo = (count > 1) & (count < BINS)
    rows, bins = np.nonzero(~full & todo[:, None])
    probe = 0
    while len(rows):
        at = (mix64((bins.astype(np.uint64) << np.uint64(32)) + np.uint64(probe + 1)) % np.uint64(BINS)).astype(np.int64)
        found = full[rows, at]
        table[rows[found], bins[found]] = table[rows[found], at[found]]
        rows, bins = rows[~found], bins[~found]
        probe += 1


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Packed fingerprints, BINS * BITS / 8 bytes a text, and all zero for an empty one."""
    hashes, ptr = shingles(data, offsets, SHINGLE_WORDS)
    n = len(offsets) - 1
    table = np.full((n, BINS), _EMPTY, np.uint64)
    text = np.repeat(np.arange(n), np.diff(ptr))
    np.minimum.at(table.reshape(-1), text * BINS + (hashes >> _SHIFT).astype(np.int64), mix64(hashes) >> np.uint64(1))
    _densify(table)
    low = (table & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[np.diff(ptr) == 0] = 0
    return low[:, 0::2] << 4 | low[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed fingerprints, row by row, corrected for chance agreement."""
    differ = a ^ b
    same = ((differ & 0xF0) == 0).sum(1) + ((differ & 0x0F) == 0).sum(1)
    chance = 2.0**-BITS
    out = np.maximum(0.0, (same / BINS - chance) / (1 - chance))
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), out)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and the packed fingerprint (binary; empty for an empty text) of each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrow_buffer(batch.column(1))
            for i, j in row_slices(offs):
                packed = signatures(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                prints = [p.tobytes() if offs[i + k + 1] > offs[i + k] else b"" for k, p in enumerate(packed)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(prints, pa.binary())], names=["id", "fingerprint"])

    rows = bounded(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint binary")


_LEAST = -(1 << 63)
_ROWS, _CHARS = 2048, 600_000
_BY_NEXT = "bucket int, ahead boolean, doc_id long, key long, tie long, text string"
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Ranges:
    """Ranges of (key, tie), by their lower bounds. A key that fills several quantiles is split by tie, which is a hash."""

    def __init__(self, quantiles: list[int]):
        keys, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
        self.keys = np.repeat(keys, times)
        self.hot = {int(k): np.array([_LEAST + i * ((1 << 64) // int(n)) for i in range(int(n))], np.int64) for k, n in zip(keys, times, strict=True) if n > 1}

    def of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.keys, key, "left").astype(np.int32)
        single = np.isin(key, self.keys)
        out[single] += 1
        for k, bounds in self.hot.items():
            at = np.flatnonzero(key == k)
            out[at] += (np.searchsorted(bounds, tie[at], "right") - 1).astype(np.int32)
        return out


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit by the next text (ascending id; the first follows the last).

    The edited text has its last floor(n/2) code points replaced by the first as many of the next text.
    Rows are dealt to ranges of ids, one range a partition; the first row of each range is
    also sent to the range before it, so no task needs more than its own range. Texts are
    shuffled once. Null ids come first; rows of equal ids follow each other in the order of
    a hash of their texts, and an id with very many rows is dealt over several ranges by it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100_000).alias("cuts")).head()[0] if parts > 1 else None
    ranges = Ranges(cuts or [])
    tie = F.col("tie") if ranges.hot else F.lit(0).cast("long")  # texts are read here only where a hot id needs it

    @F.pandas_udf("int")
    def deal(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(key.to_numpy(), tie.to_numpy()))

    # one row a range, so at most one a partition: small whatever the input
    heads = sorted((r["bucket"], r["head"]) for r in rows.select("key", tie.alias("tie")).select(deal("key", "tie").alias("bucket"), F.struct("key", "tie").alias("place")).groupBy("bucket").agg(F.min("place").alias("head")).collect())
    before = {tuple(head) if ranges.hot else (head["key"],): heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    names = [c.split()[0] for c in _BY_NEXT.split(", ")]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_keys = np.unique(np.array([h[0] for h in before], np.int64))
        for batch in batches:
            key, tie = (batch.column(k).to_numpy() for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(key, tie)), pa.array(np.zeros(len(key), bool)), *batch.columns], names=names)
            at = [k for k in np.flatnonzero(np.isin(key, head_keys)).tolist() if ((key[k], tie[k]) if ranges.hot else (key[k],)) in before]
            if at:
                to = [before[(key[k], tie[k]) if ranges.hot else (key[k],)] for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.ones(len(at), bool)), *batch.take(pa.array(at)).columns], names=names)

    dealt = rows.mapInArrow(spread, _BY_NEXT).repartitionById(parts, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "ahead", "key", "tie", "text").mapInArrow(_edit_rows, _RESULT)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, then the head of the next range; each row needs only its successor."""
    held: list[tuple[int, bool, int | None, str]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5)), strict=True):
            if held and held[-1][1] and row[1] and held[-1][0] == row[0]:
                continue  # more rows of the head's id: the first one is next
            held.append(row)
            size += len(row[3])
            if size > _CHARS or len(held) > _ROWS:
                yield _emit(held)
                held, size = held[-1:], len(row[3])
    if len(held) > 1:
        yield _emit(held)


def _emit(held: list[tuple[int, bool, int | None, str]]) -> pa.RecordBatch:
    ids, texts, edited, following = [], [], [], []
    for (bucket, ahead, doc, text), (after, _, _, then) in zip(held, held[1:], strict=False):
        if ahead or after != bucket:
            continue
        half = len(text) // 2
        ids.append(doc)
        texts.append(text)
        edited.append(text[: len(text) - half] + then[:half])
        following.append(then)
    raw, new = [t.encode() for t in texts], [t.encode() for t in edited]
    # a row's successor is the next row, but for the last of a range
    last = [k for k in range(len(ids)) if k + 1 == len(ids) or following[k] is not texts[k + 1]]
    tail = [following[k].encode() for k in last]
    n = len(ids)
    prints = signatures(*buffer_of(raw + new + tail))
    at_next = np.arange(1, n + 1)
    at_next[last] = 2 * n + np.arange(len(last))
    blank = np.array([not t for t in raw + new + tail], bool)
    own, changed, then = prints[:n], prints[n : 2 * n], prints[at_next] if n else prints[:0]
    hexed = [p.tobytes().hex() if not b else "" for p, b in zip(prints[: 2 * n], blank, strict=False)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in new], pa.string()),
            pa.array(hexed[:n], pa.string()),
            pa.array(hexed[n:], pa.string()),
            pa.array(likeness(own, changed, blank[:n], blank[n : 2 * n])),
            pa.array(likeness(own, then, blank[:n], blank[at_next] if n else blank[:0])),
        ],
        names=[c.split()[0] for c in _RESULT.split(", ")],
    )
