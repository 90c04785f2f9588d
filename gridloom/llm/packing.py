"""Packing of tokenised documents into sequences by cutting-stock column generation.

A document's ids (with an end id) are cut at multiples of the sequence length; only
the rest of a long document is a shorter piece. Piece lengths are rounded up to units
of STEP tokens and counted: the histogram has at most 256 classes whatever the
input. The linear program "fewest sequences that hold the histogram" starts from
patterns of one class and improves them: its dual values price the classes, a
knapsack dynamic program finds the pattern of the highest price, which enters the
basis until no pattern is worth more than GAP above a sequence. A second kind of
column cuts a piece longer than half a sequence in two at a multiple of CUT tokens,
at a cost of CUT_COST sequences, where the halves fit better. Solutions are rounded
down; what is left over, at most a few patterns' worth a class, is packed best fit.
Pieces are ranked within their class and take the cuts and places that the plan
has for it, so sequences follow from ranks without moving the documents. Checksums
are kept for each CUT tokens and combined for the pieces, so a cut needs no ids.

Texts are tokenised in parts that end before a space between two words, where the
tokenizer begins a new word whatever stands around, so a long text needs no more
memory than its ids.

Defined cases: a null or empty text is one piece, the end id alone; equal rows, equal
ids and null ids are packed like others, each on its own; an empty table gives no
rows; columns of docs other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.storage import bounded, cut

SEQUENCE, END_ID, STEP, GAP = 2048, 1, 8, 5e-4
CUT, CUT_COST = 64, 0.004
#: Classes are ranked in parts, about so many for each partition of a shuffle, so that a frequent length doesn't meet in one task.
RANK_PARTS = 4
#: Code points that are tokenised at once.
PART = 1 << 17
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u0250-\U0010ffff]|<[|]")
_BORDER = re.compile(r"[^\W_](?= [^\W_])")
_PIECES = "doc_id long, start long, length long, crcs binary, doc_tokens long"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


class Ids:
    """Ids of texts, as little-endian 32-bit bytes.

    Parts of Latin letters, digits and signs go through a second library with the same ranks, which is
    several times as fast; it is used only if the file's merges are in the order of their ids.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        self.vocabulary, self.tokenizer, self.fast = vocabulary, None, None
        model = json.loads(vocabulary)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if i < 256 + len(merges)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The ids of a text, made part by part, so that the memory beside them is bounded."""
        return b"".join(np.array(self._part(part), "<u4").tobytes() for part in parts(text))

    def _part(self, part: str) -> list[int]:
        if self.fast is not None and not _ODD.search(part):
            return self.fast.encode_ordinary(part)
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.vocabulary)
        return self.tokenizer.encode(part, add_special_tokens=False).ids


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size` code points, cut before a space between letters or digits: a new word begins there."""
    at = 0
    while len(text) - at > size and (border := _BORDER.search(text, at + size)):
        yield text[at : border.start() + 1]
        at = border.start() + 1
    if at < len(text):
        yield text[at:]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each row's ids: whole sequences and the rest. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Ids(shared.value)  # for this task alone: nothing of it stays in the worker
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(tokens.ids(text) + end)
                n = len(ids) // 4
                for at in range(0, n, SEQUENCE):
                    piece = ids[4 * at : 4 * (at + SEQUENCE)]
                    parts = [zlib.crc32(piece[i : i + 4 * CUT]) for i in range(0, len(piece), 4 * CUT)]
                    rows.append((doc, at, len(piece) // 4, np.array(parts, "<u4").tobytes(), n))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(columns)], names=_NAMES)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, _PIECES)


def best_pattern(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: how often to take each class for the highest total value."""
    reach = np.full(capacity + 1, -np.inf)
    reach[weights] = values
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = best[c - 1 :: -1][:c] + reach[1 : c + 1]
        at = int(options.argmax())
        if options[at] > best[c - 1]:
            best[c], took[c] = options[at], at + 1
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(len(weights), np.int64)
    place = {int(w): i for i, w in enumerate(weights)}
    c = capacity
    while c > 0:
        if took[c]:
            pattern[place[int(took[c])]] += 1
            c -= int(took[c])
        else:
            c -= 1
    return float(best[capacity]), pattern


def cutting_stock(demand: np.ndarray, capacity: int, grain: int) -> tuple[list[tuple[np.ndarray, int]], dict[tuple[int, int], int]]:
    """Patterns with their uses, and cuts (class, front) with theirs, that hold demand[w] pieces of w units each.

    demand has capacity + 1 entries; grain is the unit of a cut. After the cuts the patterns hold the pieces exactly.
    """
    m, half = capacity, capacity // 2
    weights = np.arange(1, m + 1)
    columns: list[tuple[str, object]] = [("pattern", None)] * m
    basis = np.diag(capacity // weights).astype(float)
    for i in range(m):
        columns[i] = ("pattern", basis[:, i].astype(np.int64))
    cost = np.ones(m)
    inverse = np.diag(1 / (capacity // weights))
    use = demand[1:] / (capacity // weights)
    longer, fronts = np.arange(half + 1, m + 1), np.arange(grain, half + 1, grain)
    backs = longer[:, None] - fronts[None, :]
    valid = (backs >= 1) & (backs <= half)
    last = np.inf
    for step in range(12 * m + 50):
        if step % 128 == 0:  # degenerate steps change nothing: stop when there are only those
            now = float(cost @ use)
            if now > last * (1 - GAP):
                break
            last = now
        if step % 256 == 255:
            inverse = np.linalg.inv(basis)
            use = np.maximum(inverse @ demand[1:], 0)
        prices = cost @ inverse
        saving = np.where(valid, prices[longer - 1][:, None] - prices[fronts - 1][None, :] - prices[np.maximum(backs, 1) - 1] - CUT_COST, -1)
        new = np.zeros(m)
        if saving.max(initial=-1) > 1e-3:
            i, j = np.unravel_index(saving.argmax(), saving.shape)
            new[longer[i] - 1] += 1
            new[fronts[j] - 1] -= 1
            new[backs[i, j] - 1] -= 1
            entering, price = ("cut", (int(longer[i]), int(fronts[j]))), CUT_COST
        else:
            value, pattern = best_pattern(prices, weights, capacity)
            if value <= 1 + GAP:
                break
            new += pattern
            entering, price = ("pattern", pattern), 1.0
        column = inverse @ new
        good = column > 1e-9
        if not good.any():
            break
        ratio = np.where(good, use / np.where(good, column, 1), np.inf)
        out = int(ratio.argmin())
        amount = ratio[out]
        use = np.maximum(use - amount * column, 0)
        use[out] = amount
        basis[:, out], cost[out], columns[out] = new, price, entering
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
    counts = np.floor(use + 1e-7).astype(np.int64)
    cuts: dict[tuple[int, int], int] = {}
    left = demand[1:].astype(np.int64).copy()
    for (kind, what), n in zip(columns, counts.tolist(), strict=True):
        if kind == "cut" and (n := min(n, int(left[what[0] - 1]))):
            cuts[what] = cuts.get(what, 0) + n
            left[what[0] - 1] -= n
            left[what[1] - 1] += n
            left[what[0] - what[1] - 1] += n
    plan: list[tuple[np.ndarray, int]] = []
    for (kind, pattern), n in zip(columns, counts.tolist(), strict=True):
        if kind == "pattern" and n:
            taken = pattern > 0
            n = min(n, int((left[taken] // pattern[taken]).min()))
            if n:
                plan.append((pattern, n))
                left -= pattern * n
    room, bins = [], []
    for w in weights[::-1].tolist():
        for _ in range(int(left[w - 1])):
            fits = [(r, b) for b, r in enumerate(room) if r >= w]
            if fits:
                _, b = min(fits)
            else:
                b = len(room)
                room.append(capacity)
                bins.append(np.zeros(m, np.int64))
            room[b] -= w
            bins[b][w - 1] += 1
            if room[b] == 0:
                plan.append((bins.pop(b), 1))
                room.pop(b)
    return plan + [(b, 1) for b in bins], cuts


class Plan:
    """What becomes of the r-th piece of a class: tables of a few hundred cuts and patterns, whatever the input."""

    def __init__(self, demand: np.ndarray):
        capacity, grain = SEQUENCE // STEP, CUT // STEP
        patterns, cuts = cutting_stock(demand, capacity, grain)
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        end = demand.astype(np.int64).copy()
        for w, _ in cuts:
            if w not in self.cuts:
                own = [(front, n) for (v, front), n in cuts.items() if v == w]
                ends = np.cumsum([n for _, n in own])
                self.cuts[w] = ends, np.array([f for f, _ in own]), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                end[w] -= ends[-1]
        for w, (ends, fronts, at_front, at_back) in self.cuts.items():
            for k, n in enumerate(np.diff(ends, prepend=0).tolist()):
                at_front[k] = end[fronts[k]]
                end[fronts[k]] += n
                at_back[k] = end[w - fronts[k]]
                end[w - fronts[k]] += n
        first = np.concatenate([[0], np.cumsum([n for _, n in patterns])]).astype(np.int64)
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in np.flatnonzero(end).tolist():
            own = [p for p, (pattern, _) in enumerate(patterns) if pattern[w - 1]]
            each = np.array([patterns[p][0][w - 1] for p in own], np.int64)
            starts = np.concatenate([[0], np.cumsum(each * [patterns[p][1] for p in own])]).astype(np.int64)
            self.places[w] = starts, each, first[own], np.array([patterns[p][0][: w - 1].sum() for p in own], np.int64)

    def place(self, w: int, rank: int) -> tuple[int, int]:
        """Sequence and slot of the rank-th piece of a class, after the cuts."""
        starts, each, first, slot = self.places[w]
        p = int(np.searchsorted(starts, rank, "right")) - 1
        inside = rank - int(starts[p])
        return int(first[p]) + inside // int(each[p]), int(slot[p]) + inside % int(each[p])

    def pieces(self, w: int, rank: int) -> list[tuple[int, int, int]]:
        """(front tokens or 0 for the rest, sequence, slot) of what the rank-th piece as tokenised becomes."""
        if w not in self.cuts:
            return [(0, *self.place(w, rank))]
        ends, fronts, at_front, at_back = self.cuts[w]
        if rank >= ends[-1]:
            return [(0, *self.place(w, rank - int(ends[-1])))]
        k = int(np.searchsorted(ends, rank, "right"))
        inside, front = rank - int(ends[k - 1] if k else 0), int(fronts[k])
        return [(front * STEP, *self.place(front, int(at_front[k]) + inside)), (0, *self.place(w - front, int(at_back[k]) + inside))]


def _shift_table(n_bytes: int) -> list[int]:
    """What each bit of a checksum becomes after n_bytes zero bytes."""
    zeros = bytes(n_bytes)  # zlib.crc32(zeros, c) is affine in c
    return [zlib.crc32(zeros, 1 << bit) ^ zlib.crc32(zeros) for bit in range(32)]


_shifts: dict[int, list[int]] = {}


def combine(crcs: np.ndarray, last_bytes: int) -> int:
    """The checksum of parts of 4 * CUT bytes, the last of last_bytes, from theirs."""
    out = int(crcs[0])
    for i, crc in enumerate(crcs[1:].tolist(), 2):
        n = last_bytes if i == len(crcs) else 4 * CUT
        if n not in _shifts:
            _shifts[n] = _shift_table(n)
        moved, table, bit = 0, _shifts[n], 0
        while out:
            if out & 1:
                moved ^= table[bit]
            out >>= 1
            bit += 1
        out = moved ^ crc
    return out


_RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"


def pack(pieces: DataFrame) -> DataFrame:
    """Final pieces with sequence_id and offset. Pieces are light rows; two shuffles of them, by class and by sequence."""
    unit = ((F.col("length") + STEP - 1) / STEP).cast("int")
    pieces = cut(pieces.withColumns({"unit": unit, "row": F.monotonically_increasing_id()}))  # from here on a row keeps its number
    demand = np.zeros(SEQUENCE // STEP + 1, np.int64)
    for r in pieces.groupBy("unit").count().collect():  # at most 256 classes
        demand[r["unit"]] = r["count"]
    rows = max(1, int(demand.sum()) // (RANK_PARTS * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    deal = F.element_at(F.lit([max(1, -(-int(n) // rows)) for n in demand]), F.col("unit") + 1)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("row"), deal).cast("int"))
    counts = sorted(tuple(r) for r in pieces.groupBy("unit", "part").count().collect())  # a number a part, at most one more a class
    before: dict[tuple[int, int], int] = {}
    for k, (w, p, _) in enumerate(counts):
        before[w, p] = before[counts[k - 1][:2]] + counts[k - 1][2] if k and counts[k - 1][0] == w else 0
    plan = Plan(demand) if counts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, start, length, crcs, tokens, unit, _, part, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                crcs = np.frombuffer(crcs, "<u4")
                at = 0
                for front, sequence, slot in plan.pieces(unit, rank - 1 + before[unit, part]):
                    n = front or length - at
                    own = crcs[at // CUT : -(-(at + n) // CUT)]
                    rows.append((doc, start + at, n, combine(own, 4 * (n - CUT * (len(own) - 1))), tokens, sequence, slot))
                    at += n
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _RESULT.split(", ")])

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("unit", "part").orderBy("row")))
    placed = ranked.mapInArrow(run, _RESULT)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long"))).drop("slot")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack; one row a piece."""
    return pack(tokenized_pieces(docs, tokenizer_path, id_col, text_col))
