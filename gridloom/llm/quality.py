"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of character classes, repetition
of words and lines and lengths, of the line itself and of the lines before and after
it. The field is fitted to lines that carry the label of their document, on at most
TRAIN_ROWS labelled documents; those of more than TRAIN_LINES lines are not learnt
from, which bounds what the driver holds. Forward-backward recursions give each line's
marginal log-odds; the marginal chances, weighted by the lengths of the lines, are a
document's quality, and a logistic curve fitted to the same documents puts its border
at 0.5.

Features are made for BLOCK_LINES lines at a time and only their scores are kept, so a
text of many lines needs a few numbers a line. Long chains are cut into segments whose
recursions compose (a step is a linear fraction of the odds), so they take steps side
by side; the result is that of the whole chain.

Defined cases: a null or empty text is one empty line; texts are read whole; null and
repeated ids are scored row by row, and null ids are not learnt from; without labels of
both kinds every score is the share of good labels with one of each added; an empty
table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.learning import fit_logistic, fold, minimise, sample_labelled, sigmoid
from gridloom.llm.storage import bounded
from gridloom.llm.textops import BLOCK_BYTES, arrow_buffer, hash_words, mix64, row_slices

TRAIN_ROWS, TRAIN_LINES = 4000, 200
#: Lines whose features are made at once, and lines of a segment of a long chain.
BLOCK_LINES, SEGMENT = 4096, 64
_CLASSES = [
    np.isin(np.arange(256), list(chars))
    for chars in (b" \t", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:'\"?-", b"!", b"|", b"*#&%$@^~_=+<>/\\", b"()[]{}", bytes(range(128, 256)))
]


@dataclass
class Lines:
    """The lines of several texts: a few numbers a line and a hash a word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    words: np.ndarray
    word_ptr: np.ndarray
    repeated: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Lines:
        lo, hi = int(offsets[0]), int(offsets[-1])
        data, offsets = data[lo:hi], offsets - lo
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))  # a break that ends a text begins an empty line of it
        per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
        ptr = np.concatenate([[0], np.cumsum(per_text)])
        ends = np.append(starts[1:], hi - lo)
        ends -= 1
        ends[ptr[1:] - 1] += 1  # the last line of a text has no break
        # the break itself is no part of a word
        words, word_ptr = hash_words(data, np.append(starts, hi - lo))
        # a line's hash must not depend on its place: the sum of its words' hashes does not
        bag = np.concatenate([[np.uint64(0)], np.cumsum(mix64(words + np.uint64(1)))])
        key = bag[word_ptr[1:]] - bag[word_ptr[:-1]] + np.diff(word_ptr).astype(np.uint64)
        text = np.repeat(np.arange(len(per_text)), per_text)
        order = np.lexsort((key, text))
        twin = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        repeated = np.zeros(len(starts), bool)
        repeated[order[1:][twin]] = True
        repeated[order[:-1][twin]] = True
        return cls(data, starts, ends, ptr, words, word_ptr, repeated)

    def _own(self, a: int, b: int) -> np.ndarray:
        """Features of the lines a to b themselves."""
        n, starts, ends = b - a, self.starts[a:b], self.ends[a:b]
        size = (ends - starts).astype(float)
        safe = np.maximum(size, 1)
        counts = np.zeros((n, len(_CLASSES)))
        for lo in range(int(starts[0]), int(ends[-1]), BLOCK_BYTES):
            hi = min(lo + BLOCK_BYTES, int(ends[-1]))
            i, j = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
            s, e = np.clip(starts[i:j], lo, hi) - lo, np.clip(ends[i:j], lo, hi) - lo
            for k, members in enumerate(_CLASSES):
                total = np.concatenate([[0], np.cumsum(members[self.data[lo:hi]], dtype=np.int32)])
                counts[i:j, k] += total[e] - total[s]
        columns = [np.log1p(size)]
        for k in range(len(_CLASSES)):
            share = counts[:, k] / safe
            columns += [share, np.sqrt(share)]
        words, count = self.words[self.word_ptr[a] : self.word_ptr[b]], np.diff(self.word_ptr[a : b + 1])
        line = np.repeat(np.arange(n), count)
        order = np.lexsort((words, line))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][fresh], minlength=n)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
        each = np.maximum(count, 1)
        columns += [np.log1p(count), distinct / each, np.bincount(line[again], minlength=n) / each, size / each / 20, self.repeated[a:b].astype(float)]
        return np.stack(columns, 1)

    def features(self, a: int, b: int) -> np.ndarray:
        """Features of the lines a to b: own, of the line before and after, and whether it is the first or last."""
        lo, hi = max(0, a - 1), min(len(self.starts), b + 1)
        wide = self._own(lo, hi)
        own = wide[a - lo : b - lo]
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[lo == a :], after[: hi - a - 1] = wide[: b - 1 - lo], wide[a + 1 - lo :]
        edge = np.zeros((b - a, 2))
        first, last = self.ptr[:-1], self.ptr[1:] - 1
        first, last = first[(first >= a) & (first < b)] - a, last[(last >= a) & (last < b)] - a
        before[first], after[last] = 0, 0
        edge[first, 0], edge[last, 1] = 1, 1
        return np.hstack([own, before, after, edge])

    def sizes(self) -> np.ndarray:
        return np.maximum(self.ends - self.starts, 1).astype(float)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, lengths of the lines in bytes, and where each text's lines start."""
    lines = Lines.of(data, offsets)
    return lines.features(0, len(lines.starts)), lines.sizes(), lines.ptr


def _pass_on(trans: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What log-odds m of a line say of the next one."""
    return np.logaddexp(trans[0, 1], trans[1, 1] + m) - np.logaddexp(trans[0, 0], trans[1, 0] + m)


def _side_by_side(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains by falling length, and how many are longer than each t."""
    order = np.argsort(-count, kind="stable")
    return order, np.searchsorted(-count[order], -np.arange(int(count.max(initial=0))), "left")


def _forward_plain(scores: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> np.ndarray:
    out = scores.copy()
    order, active = _side_by_side(np.diff(ptr))
    starts = ptr[:-1][order]
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        out[at] += _pass_on(trans, out[at - 1])
    return out


def forward(scores: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log-odds of each line given itself and the lines before it, for all chains of a buffer."""
    count = np.diff(ptr)
    if count.max(initial=0) <= 2 * SEGMENT:
        return _forward_plain(scores, ptr, trans)
    pieces = -(-count // SEGMENT)
    of_chain = np.concatenate([[0], np.cumsum(pieces)])
    begin = np.repeat(ptr[:-1], pieces) + SEGMENT * (np.arange(of_chain[-1]) - np.repeat(of_chain[:-1], pieces))
    cuts = np.append(begin, ptr[-1])
    # logs of the linear fraction (p m + q) / (r m + s) that a segment makes of the odds before it
    p, q, r, s = np.zeros(len(begin)), np.full(len(begin), -np.inf), np.full(len(begin), -np.inf), np.zeros(len(begin))
    order, active = _side_by_side(np.diff(cuts))
    starts = begin[order]
    for t in range(len(active)):
        k = order[: active[t]]
        x = scores[starts[: active[t]] + t]
        up = x + np.logaddexp(trans[1, 1] + p[k], trans[0, 1] + r[k]), x + np.logaddexp(trans[1, 1] + q[k], trans[0, 1] + s[k])
        down = np.logaddexp(trans[1, 0] + p[k], trans[0, 0] + r[k]), np.logaddexp(trans[1, 0] + q[k], trans[0, 0] + s[k])
        scale = np.maximum(np.maximum(*up), np.maximum(*down))
        p[k], q[k], r[k], s[k] = up[0] - scale, up[1] - scale, down[0] - scale, down[1] - scale
    # odds at the end of each segment, from one to the next
    first = of_chain[:-1][count > 0]
    last = np.zeros(len(begin))
    last[first] = _forward_plain(scores, cuts, trans)[cuts[first + 1] - 1]
    order, active = _side_by_side(pieces)
    heads = of_chain[:-1][order]
    for t in range(1, len(active)):
        k = heads[: active[t]] + t
        last[k] = np.logaddexp(p[k] + last[k - 1], q[k]) - np.logaddexp(r[k] + last[k - 1], s[k])
    inner = np.setdiff1d(np.arange(len(begin)), first)
    out = scores.copy()
    out[begin[inner]] += _pass_on(trans, last[inner - 1])
    return _forward_plain(out, cuts, trans)


def chains(scores: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of each line; backward is forward on the reversed lines, less the line itself."""
    back = forward(scores[::-1], ptr[-1] - ptr[::-1], trans.T)[::-1]
    return forward(scores, ptr, trans), back - scores


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: np.ndarray
    prior: float | None = None

    def qualities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginal chances, before the curve."""
        lines = Lines.of(data, offsets)
        n = len(lines.starts)
        scores = [((lines.features(a, min(a + BLOCK_LINES, n)) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1] for a in range(0, n, BLOCK_LINES)]
        return self.weigh(np.concatenate(scores), lines.sizes(), lines.ptr)

    def weigh(self, scores: np.ndarray, size: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        up, down = chains(scores, ptr, self.trans)
        good = sigmoid(up + down)
        return np.add.reduceat(good * size, ptr[:-1]) / np.add.reduceat(size, ptr[:-1])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        return sigmoid(self.curve[0] * self.qualities(data, offsets) + self.curve[1])


def likelihood(x: np.ndarray, y: np.ndarray, ptr: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log-likelihood a line of the lines' labels, and its gradient. w: four transitions, the features' weights, an intercept."""
    inner = np.ones(len(y), bool)
    inner[ptr[:-1]] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1].astype(int), y[to].astype(int)), 1)
    trans = w[:4].reshape(2, 2)
    scores = x @ w[4:-1] + w[-1]
    up, down = chains(scores, ptr, trans)
    # the chain rule: log-odds given what stands before, normalised by what may follow
    prob = sigmoid(up + down)
    state = np.stack([np.zeros(len(to)), up[to - 1]], 1)[:, :, None] + trans + np.stack([np.zeros(len(to)), scores[to] + down[to]], 1)[:, None, :]
    state -= state.max((1, 2), keepdims=True)
    pairs = np.exp(state)
    pairs /= pairs.sum((1, 2), keepdims=True)
    gold = np.log(np.where(y > 0, prob, 1 - prob) + 1e-12)
    joint = np.log(pairs[np.arange(len(to)), y[to - 1].astype(int), y[to].astype(int)] + 1e-12)
    # product of pair marginals over product of inner single marginals
    last = np.zeros(len(y), bool)
    last[ptr[1:] - 1] = True
    value = joint.sum() - gold[inner & ~last].sum() + gold[~inner & last].sum()
    grad = np.concatenate([(seen - pairs.sum(0)).ravel(), x.T @ (y - prob), [(y - prob).sum()]])
    return float(value) / len(y), grad / len(y)


def fit_field(features: np.ndarray, size: np.ndarray, ptr: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood of the lines' labels, then the curve over documents."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Field(*[np.zeros(1)] * 5, prior=float((labels.sum() + 1) / (len(labels) + 2)))
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = (features - mean) / scale
    y = np.repeat(labels, np.diff(ptr)).astype(float)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = likelihood(x, y, ptr, w)
        own = np.append(w[:-1], 0)
        return ridge * own @ own / 2 - value, ridge * own - grad

    w = minimise(loss, np.zeros(x.shape[1] + 5), steps=120)
    field = Field(mean, scale, w[4:], w[:4].reshape(2, 2), np.array([1.0, 0.0]))
    q = field.weigh(x @ w[4:-1] + w[-1], size, ptr)
    field.curve = fit_logistic(q[:, None], labels.astype(float), 1e-4)
    return field


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Field:
    """Fit on a bounded sample; features are made by the executors, and the driver gets numbers only, of `rows` times `lines` lines at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrow_buffer(batch.column(0))
            for i, j in row_slices(offs):
                features, size, ptr = line_features(data, offs[i : j + 1])
                features = features.astype("<f4")
                made = [features[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                sizes = [size[a:b].astype("<f4").tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(made, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "y", "features", "size"])

    sample = sample_labelled(bounded(docs), labels, "quality", learn, rows).where(F.regexp_count("text", F.lit("\n")) < lines).select("text", "id", "y")
    got = sorted(sample.mapInArrow(run, "id long, y int, features binary, size binary").collect(), key=lambda r: (r["id"], bytes(r["features"])))
    if not got:
        return fit_field(np.zeros((0, 1)), np.zeros(0), np.zeros(1, int), np.zeros(0))
    sizes = [np.frombuffer(r["size"], "<f4") for r in got]
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    features = np.concatenate([np.frombuffer(r["features"], "<f4") for r in got]).reshape(ptr[-1], -1).astype(float)
    return fit_field(features, np.concatenate(sizes).astype(float), ptr, np.array([r["y"] for r in got]))


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row; labels of the held-out fold are never learnt from. No shuffle of texts."""
    field = train(docs, labels, fold(F.col("id"), folds) != held, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrow_buffer(batch.column(2))
            for i, j in row_slices(offs):
                s = field.scores(data, offs[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), folds) == held).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows_.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
