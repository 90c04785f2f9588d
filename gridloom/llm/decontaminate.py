"""Benchmark decontamination by winnowing.

Of the hashes of all 9-word grams the smallest in each run of 5 neighbours is kept,
for documents and for benchmark items alike. Two texts that share 13 consecutive
words share such a run and so a kept hash (9 + 5 - 1 = 13): joining kept hashes
finds every shared span of that length. Each hit is extended to the windows of 13
words around it (at most 5 hold the gram); those that are windows of an item mark
their words and their items. Hits and windows are looked up by sorted arrays, so the
time is linear in the words of a text plus the items found, also for texts of one
repeated word. Items of fewer than 13 words have no such run and are looked up whole,
by a gram of their own length.

The benchmark side is joined as an index of sorted hashes, built once on the driver
and broadcast where the benchmark has at most block_chars characters, which is
checked; a larger benchmark is cut into blocks of items and the documents are read
once for each block, so memory stays bounded and no key is shuffled.

Defined cases: a null or wordless text has no words, no hits and is clean; items that
are null or wordless never occur; repeated item rows count once by their item id, and
items of a null id hit words but are not listed; rows of equal or null ids are judged
each by its own text; a long text is hashed by blocks and its memory is a few numbers
a word; an empty table of documents gives no rows, an empty benchmark no hits; columns
other than id and text are not read, and clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import bounded, free_name
from gridloom.llm.textops import arrow_buffer, buffer_of, gram_starts, grams, hash_words, row_slices

WINDOW, GRAM = 13, 9
RUN = WINDOW - GRAM + 1
BLOCK_CHARS = 16 << 20
_SPANS = "doc_id long, text_key string, n_words long, starts array<long>, ends array<long>, items array<string>"


def winnow(words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept gram hashes and their positions: the rightmost minimum of each run of RUN grams within a text."""
    at, _ = gram_starts(ptr, WINDOW)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = grams(words, GRAM)
    best, where = g[at], at.copy()
    for j in range(1, RUN):
        here = g[at + j]
        better = here <= best
        best = np.where(better, here, best)
        where = np.where(better, at + j, where)
    where = np.unique(where)
    return g[where], where


class _Table:
    """Hashes with the items that hold each, as sorted arrays."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
        self.items = items[fresh].astype(np.int32)
        self.hashes, first = np.unique(hashes[fresh], return_index=True)
        self.first = np.append(first, len(self.items)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are here, and their places."""
        if not len(self.hashes) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.flatnonzero(self.hashes[at] == hashes)
        return found, at[found]

    def held(self, places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, item) pairs of the places, each once."""
        pairs = np.unique(np.stack([owner, places], 1), axis=0) if len(places) else np.empty((0, 2), np.int64)
        size = self.first[pairs[:, 1] + 1] - self.first[pairs[:, 1]]
        begin = np.repeat(self.first[pairs[:, 1]] - (np.cumsum(size) - size), size)
        return np.repeat(pairs[:, 0], size), self.items[begin + np.arange(size.sum())]


class Index:
    """The benchmark side: kept grams, windows with their items, and short items by length."""

    def __init__(self, ids: list[str | None], texts: list[str]):
        self.ids = ids
        words, ptr = hash_words(*buffer_of([(t or "").encode() for t in texts]))
        n = np.diff(ptr)
        self.kept = np.unique(winnow(words, ptr)[0])
        at, own = gram_starts(ptr, WINDOW)
        self.windows = _Table(grams(words, WINDOW)[at], np.repeat(np.arange(len(ids)), np.diff(own)))
        self.short: dict[int, _Table] = {}
        for size in np.unique(n[(n > 0) & (n < WINDOW)]).tolist():
            items = np.flatnonzero(n == size)
            self.short[size] = _Table(grams(words, size)[ptr[items]], items)

    def hits(self, words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word lies in an occurring window, and the (text, item) pairs, over the words of several texts."""
        change = np.zeros(len(words) + 1, np.int64)
        texts, items = [], []

        def mark(table: _Table, size: int, starts: np.ndarray) -> None:
            found, places = table.find(grams(words, size)[starts])
            np.add.at(change, starts[found], 1)
            np.add.at(change, starts[found] + size, -1)
            t, i = table.held(places, np.searchsorted(ptr, starts[found], "right") - 1)
            texts.append(t)
            items.append(i)

        kept, where = winnow(words, ptr)
        if len(kept) and len(self.kept):
            where = where[self.kept[np.minimum(np.searchsorted(self.kept, kept), len(self.kept) - 1)] == kept]
            # extension: the windows around a hit, within its text
            text = np.searchsorted(ptr, where, "right") - 1
            around = where[:, None] - np.arange(RUN)
            around = around[(around >= ptr[text][:, None]) & (around + WINDOW <= ptr[text + 1][:, None])]
            mark(self.windows, WINDOW, np.unique(around))
        for size, table in self.short.items():
            starts, _ = gram_starts(ptr, size)
            if len(starts):
                mark(table, size, starts)
        pairs = np.unique(np.stack([np.concatenate([np.empty(0, np.int64), *texts]), np.concatenate([np.empty(0, np.int64), *items])], 1), axis=0)
        return np.cumsum(change[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[Index]:
    """The benchmark in blocks of about block_chars characters (or one item); the driver holds one block."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for b in range(n := _n_blocks(benchmark, text_col, block_chars)):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct().orderBy("i", "t").collect()
        yield Index([r["i"] for r in rows], [r["t"] for r in rows])


def _n_blocks(benchmark: DataFrame, text_col: str, block_chars: int) -> int:
    return max(1, -(-(benchmark.agg(F.sum(F.length(text_col))).head()[0] or 0) // block_chars))


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each document row: its number of words, the hit word spans (merged, ends exclusive) and the occurring items."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    several = _n_blocks(benchmark, item_text_col, block_chars) > 1
    parts = [rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(index), several), _SPANS) for index in _blocks(benchmark, item_col, item_text_col, block_chars)]
    if len(parts) == 1:
        return parts[0]
    # rows with a hit in some block; n_words and the rows themselves from the first block
    more = parts[1].where("size(starts) > 0")
    for p in parts[2:]:
        more = more.union(p.where("size(starts) > 0"))
    more = more.distinct().groupBy(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key")).agg(F.flatten(F.collect_list("starts")).alias("m_starts"), F.flatten(F.collect_list("ends")).alias("m_ends"), F.flatten(F.collect_list("items")).alias("m_items"))
    both = parts[0].join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left")
    joined = lambda a, b: F.concat(F.col(a), F.coalesce(F.col(b), F.array().cast(both.schema[b].dataType)))
    return both.select("doc_id", "text_key", "n_words", joined("starts", "m_starts").alias("starts"), joined("ends", "m_ends").alias("ends"), F.array_distinct(joined("items", "m_items")).alias("items")).mapInArrow(_merge_rows, _SPANS)


def _scan(shared, keys: bool):
    """Spans of a block in each text; keys: with the text's hash, to find the row again in another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, offs = arrow_buffer(batch.column(1))
            for i, j in row_slices(offs):
                words, ptr = hash_words(data, offs[i : j + 1])
                hit, text, item = index.hits(words, ptr)
                names: dict[int, set[str]] = {}
                for t, k in zip(text.tolist(), item.tolist(), strict=True):
                    if index.ids[k] is not None:  # hit words count, but there is no name to list
                        names.setdefault(t, set()).add(index.ids[k])
                spans = [_runs(hit[a:b]) if a < b and hit[a:b].any() else _NONE for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([hashlib.sha256(data[offs[i + t] : offs[i + t + 1]]).hexdigest() if keys else "" for t in range(j - i)], pa.string()),
                        pa.array(np.diff(ptr)),
                        pa.array([s for s, _ in spans], pa.list_(pa.int64())),
                        pa.array([e for _, e in spans], pa.list_(pa.int64())),
                        pa.array([sorted(names.get(t, ())) for t in range(j - i)], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text_key", "n_words", "starts", "ends", "items"],
                )

    return run


_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of hit words."""
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(step > 0), np.flatnonzero(step < 0)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged = [_merge(list(zip(s, e, strict=True))) for s, e in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([[s for s, _ in m] for m in merged], pa.list_(pa.int64())), pa.array([[e for _, e in m] for m in merged], pa.list_(pa.int64())), batch.column(5)], names=batch.schema.names)


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """find_spans() with n_hit, n_items, items_sha256 and the verdict: at least one word in twenty is hit."""
    out = _judged(find_spans(docs, benchmark, **names))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated", "starts", "ends", "items")


def _judged(spans: DataFrame) -> DataFrame:
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not contaminated. One block needs no shuffle."""
    names = {"id_col": id_col, "text_col": text_col, "block_chars": block_chars}
    if _n_blocks(benchmark, "text", block_chars) > 1:
        bad_id, bad_key = free_name("bad_id", docs.columns), free_name("bad_key", docs.columns)
        bad = _judged(find_spans(docs, benchmark, **names)).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
        key = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
        return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad[bad_id]) & (key == bad[bad_key]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, "item_id", "text", block_chars)))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, offs = arrow_buffer(batch.column(where))
            keep = np.ones(batch.num_rows, bool)
            for i, j in row_slices(offs):
                words, ptr = hash_words(data, offs[i : j + 1])
                covered = np.concatenate([[0], np.cumsum(index.hits(words, ptr)[0])])
                n_hit = covered[ptr[1:]] - covered[ptr[:-1]]
                keep[i:j] = ~((n_hit > 0) & (20 * n_hit >= np.diff(ptr)))
            yield batch.filter(pa.array(keep))

    return bounded(docs).mapInArrow(run, docs.schema)
