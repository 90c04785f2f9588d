"""Toxicity by a logistic classifier with counterfactual regularisation.

Features are the presence of words and of word beginnings (PREFIXES bytes), those
that occur more in toxic than in clean labelled documents by the likelihood ratio.
In the labelled sentences each identity term is swapped for another of its group, and
the fit penalises the change of score (COUNTERFACTUAL), so that the mention of a
group alone does not move it. The fit uses at most TRAIN_ROWS labelled documents and
MAX_FEATURES features, those of the highest likelihood ratio of all; executors count,
select and sum up the swaps, the driver fits matrices of that size, whatever the
lengths of the texts.

Defined cases: a null or empty text has no features and gets the intercept's score;
texts are read whole; null and repeated ids are scored row by row, and null ids are not
learnt from; without labels of both kinds every score is the share of toxic labels with
one of each added; an empty table gives no rows; columns other than id and text are
not read, and remove_toxic passes them on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.learning import fold, minimise, sample_labelled, sigmoid
from gridloom.llm.storage import bounded, cut
from gridloom.llm.textops import arrow_buffer, buffer_of, hash_words, row_slices

TRAIN_ROWS, MAX_FEATURES, MIN_DOCS, LEAST_RATIO = 8000, 1024, 3, 6.6
PREFIXES = (4, 5, 6, 7)
COUNTERFACTUAL, RIDGE = 4.0, 3e-5
#: Terms of a group are swapped for each other.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "transgender"),
    ("immigrants", "refugees", "foreigners"), ("africans", "europeans", "americans"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwule", "lesben"), ("ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)
_SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}
_TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _SWAP), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of the words of each text, a row a word (0: none), and where each text's words start."""
    return hash_words(data, offsets, PREFIXES)


def swapped_sentences(text: str) -> Iterator[tuple[str, str]]:
    """Sentences with an identity term, and their counterfactuals."""
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        new = _TERM.sub(lambda m: _SWAP[m[0].lower()], sentence)
        if new != sentence:
            yield sentence, new


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    intercept: float

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once."""
        rows, ptr = features(data, offsets)
        if not len(self.hashes) or not rows.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, rows), len(self.hashes) - 1)
        word, k = np.nonzero(self.hashes[at] == rows)
        text = np.searchsorted(ptr, word, "right") - 1
        pairs = np.unique(text * len(self.hashes) + at[word, k])
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, feature = self.present(data, offsets)
        return sigmoid(self.intercept + np.bincount(text, self.weights[feature] if len(feature) else None, minlength=len(offsets) - 1))


def fit(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, n_swaps: int, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise loss_of()."""
    w = minimise(lambda w: loss_of(w, x, y, swaps, n_swaps, counterfactual), np.zeros(x.shape[1] + 1))
    return w[:-1], float(w[-1])


def loss_of(w: np.ndarray, x: np.ndarray, y: np.ndarray, swaps: np.ndarray, n_swaps: int, counterfactual: float) -> tuple[float, np.ndarray]:
    """Log loss, ridge and the mean squared change of the score over swaps, with the gradient.

    swaps is the sum over the swapped sentences of the outer products of their feature changes: all that the mean square needs.
    """
    z = x @ w[:-1] + w[-1]
    error = (sigmoid(z) - y) / len(y)
    own = np.append(w[:-1], 0)
    value = np.mean(np.logaddexp(0, z) - y * z) + RIDGE * own @ own / 2
    grad = np.append(x.T @ error, error.sum()) + RIDGE * own
    if n_swaps:
        moved = swaps @ w[:-1]
        value += counterfactual * (w[:-1] @ moved) / n_swaps / 2
        grad[:-1] += counterfactual * moved / n_swaps
    return float(value), grad


def likelihood_ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Of presence in toxic and in clean documents; below zero where it speaks for clean."""
    n, with_it = float(n_toxic + n_clean), toxic + clean

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    g = term(toxic, with_it * n_toxic / n) + term(clean, with_it * n_clean / n) + term(n_toxic - toxic, (n - with_it) * n_toxic / n) + term(n_clean - clean, (n - with_it) * n_clean / n)
    return F.when(toxic * n_clean > clean * n_toxic, g).otherwise(-g)


def _each_feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different features of each document."""
    for batch in batches:
        data, offs = arrow_buffer(batch.column(0))
        y = batch.column(2).to_numpy()
        for i, j in row_slices(offs):
            found, ptr = features(data, offs[i : j + 1])
            own = [np.unique(found[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            f = np.concatenate(own)
            label = np.repeat(y[i:j], [len(o) for o in own]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(f[f != 0].view(np.int64)), pa.array(label[f != 0])], names=["f", "y"])


def select_features(sample: DataFrame, n_toxic: int, n_clean: int, most: int) -> np.ndarray:
    """Sorted hashes of the `most` features of the highest likelihood ratio, of those in MIN_DOCS toxic documents and above LEAST_RATIO."""
    counts = sample.mapInArrow(_each_feature, "f long, y int").groupBy("f").agg(F.sum("y").cast("double").alias("toxic"), F.sum(1 - F.col("y")).cast("double").alias("clean"))
    ratio = likelihood_ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    top = counts.where(F.col("toxic") >= MIN_DOCS).select("f", ratio.alias("ratio")).where(F.col("ratio") > LEAST_RATIO).orderBy(F.col("ratio").desc(), "f").limit(most).collect()
    return np.sort(np.array([r["f"] for r in top], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS, counterfactual: float = COUNTERFACTUAL, most: int = MAX_FEATURES) -> Model:
    """Select features by counts over the sample, then fit. The driver gets the present features of each sampled document and, of all swapped sentences, one matrix."""
    sample = cut(sample_labelled(bounded(docs), labels, "toxic", learn, rows).select("text", "id", "y"))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 1) / (n_toxic + n_clean + 2)
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))))
    model = Model(select_features(sample, n_toxic, n_clean, most), np.zeros(0), 0.0)
    m = len(model.hashes)

    def designs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Present features of each document."""
        for batch in batches:
            data, offs = arrow_buffer(batch.column(0))
            for i, j in row_slices(offs):
                text, feature = model.present(data, offs[i : j + 1])
                ptr = np.searchsorted(text, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(feature, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), lists], names=["id", "y", "present"])

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the products of feature changes (cell -1: the number of sentences that change)."""
        for batch in batches:
            total: Counter[int] = Counter()
            for text in batch.column(0).to_pylist():
                for pair in swapped_sentences(text):
                    before, after = (set(model.present(*buffer_of([s.encode()]))[1].tolist()) for s in pair)
                    change = [(f, 1) for f in before - after] + [(f, -1) for f in after - before]
                    total.update({-1: 1} if change else {})
                    for f, v in change:
                        for g, u in change:
                            total[f * m + g] += v * u
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "v"])

    got = sorted((r["id"], r["y"], r["present"]) for r in sample.mapInArrow(designs, "id long, y int, present array<long>").collect())
    x = np.zeros((len(got), m), np.float32)
    for i, (_, _, present) in enumerate(got):
        x[i, present] = 1
    swaps = np.zeros(m * m)
    cells = {r["cell"]: r["v"] for r in sample.mapInArrow(swapped, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect()}  # at most m * m + 1
    n_swaps = cells.pop(-1, 0)
    swaps[list(cells)] = list(cells.values())
    model.weights, model.intercept = fit(x, np.array([y for _, y, _ in got], float), swaps.reshape(m, m), n_swaps, counterfactual)
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row; labels of the held-out fold are never learnt from. No shuffle of texts."""
    model = train(docs, labels, fold(F.col("id"), folds) != held, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrow_buffer(batch.column(2))
            for i, j in row_slices(offs):
                s = model.scores(data, offs[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), folds) == held).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows_.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score under 0.5."""
    model = train(docs, labels, fold(F.col("id"), folds) != held, rows)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = arrow_buffer(batch.column(where))
            keep = np.ones(batch.num_rows, bool)
            for i, j in row_slices(offs):
                keep[i:j] = model.scores(data, offs[i : j + 1]) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
