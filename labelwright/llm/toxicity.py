"""Toxicity scores by weak supervision.

Voters are words, word beginnings and patterns over them.  Candidates for the lexicon come from a bounded set of labelled
texts; each chosen term is a voter, and so are patterns such as "two terms or more" and "many terms for its length".  A
generative label model takes votes as noisy observations of a hidden label: an EM run estimates how often each voter
fires under either label, and pairwise correlations under the posterior discount voters that repeat each other.  Its
posterior labels, not the given ones (which choose the lexicon and say which hidden label is which), train a linear classifier over the term counts, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import Words, checkpointed, held_out, labelled, mix64, text_pieces

#: Labelled texts that the lexicon, the label model and the classifier are fitted on, at most.
TRAIN_ROWS = 8_000
#: Terms of the lexicon, at most.
TERMS = 300
#: Standard errors by which a term's share of toxic texts must lie above the base rate.
LIFT = 6.0
#: Bytes of the word beginnings that may become terms.
PREFIXES = (4, 5, 6)


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every term of a text: its words and their beginnings."""
    size = w.end - w.start
    row, found = [w.doc], [w.hashes()]
    for k in PREFIXES:
        long = size > k
        row.append(w.doc[long])
        found.append(mix64(w.span_hash(w.start[long], w.start[long] + k) ^ np.uint64(k)))
    return np.concatenate(row), np.concatenate(found)


def _lexicon(train: DataFrame, text: str) -> np.ndarray:
    """Hashes of the terms that mark toxic texts most clearly, ascending; counted by Spark over the labelled texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            w = Words(batch.column(batch.schema.get_field_index(text)), letters=True)
            row, h = _terms(w)
            once = np.unique(np.stack([h, row.astype(np.uint64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            kinds, which = np.unique(once[:, 0], return_inverse=True)
            toxic = np.bincount(which, y[once[:, 1].astype(np.int64)], len(kinds)).astype(np.int64)
            every = np.bincount(which, minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(toxic), pa.array(every)], names=["h", "toxic", "n"])

    texts = train.agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    positive, total = int(texts.toxic or 0), int(texts.n)
    if not positive or positive == total:
        return np.zeros(0, np.uint64)
    seen = train.select("y", text).mapInArrow(count, "h long, toxic long, n long").groupBy("h").agg(F.sum("toxic").alias("a"), F.sum("n").alias("n"))
    base = positive / total
    # how far the term's share of toxic texts lies above the base rate, in standard errors, where most of its texts are toxic
    lift = (F.col("a") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    best = seen.where((lift > LIFT) & (F.col("a") >= 0.5 * F.col("n"))).orderBy(lift.desc(), "h").limit(TERMS)
    return np.sort(np.array([r.h for r in best.select("h").collect()], np.int64).astype(np.uint64))


def term_counts(col: pa.Array, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x terms counts, words a row)"""
    w = Words(col, letters=True)
    row, h = _terms(w)
    if not len(lexicon):
        return np.zeros((w.rows, 0), np.float32), w.count
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    hit = lexicon[at] == h
    flat = np.bincount(row[hit] * len(lexicon) + at[hit], minlength=w.rows * len(lexicon))
    return flat.reshape(w.rows, len(lexicon)).astype(np.float32), w.count


def _patterns(counts: np.ndarray, words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters; ``groups`` puts terms that fire on the same words together."""
    kinds = np.zeros((len(counts), groups.max() + 1 if len(groups) else 0))
    np.maximum.at(kinds.T, groups, counts.T)
    hits, distinct = kinds.sum(1), (kinds > 0).sum(1)
    rate = hits / np.maximum(words, 1)
    return np.stack([hits >= 1, hits >= 2, hits >= 3, hits >= 5, distinct >= 2, distinct >= 3, rate > 0.004, rate > 0.012, rate > 0.03], axis=1).astype(float)


class LabelModel:
    """Two hidden labels; each voter fires with its own rate under either.  Correlated voters share their weight."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 12):
        post = np.clip(start.astype(float), 0.03, 0.97)
        for _ in range(rounds):
            self.prior = float(np.clip(post.mean(), 0.01, 0.99))
            one = (post @ votes + 0.05) / (post.sum() + 1)
            zero = ((1 - post) @ votes + 0.05) / ((1 - post).sum() + 1)
            self.one, self.zero = np.clip(one, 1e-4, 1 - 1e-4), np.clip(zero, 1e-4, 1 - 1e-4)
            rest = votes - post[:, None] * self.one - (1 - post)[:, None] * self.zero
            scale = np.sqrt((rest**2).mean(0)) + 1e-6
            self.correlation = (rest.T @ rest) / len(votes) / np.outer(scale, scale)
            tied = np.where(self.correlation > 0.25, self.correlation, 0)
            self.weight = 1 / np.maximum(tied.sum(1), 1)
            post = self.posterior(votes)

    def orient(self, votes: np.ndarray, given: np.ndarray) -> None:
        """Swaps the two labels if label 1 goes with given 0."""
        post, yes = self.posterior(votes), given > 0.5
        if yes.any() and not yes.all() and post[yes].mean() < post[~yes].mean():
            self.one, self.zero, self.prior = self.zero, self.one, 1 - self.prior

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fires = np.log(self.one / self.zero) * self.weight
        silent = np.log((1 - self.one) / (1 - self.zero)) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + votes @ fires + (1 - votes) @ silent
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    lexicon: np.ndarray
    groups: np.ndarray
    weights: np.ndarray

    def inputs(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(counts), 1)), _patterns(counts, words, self.groups), np.log1p(counts)], axis=1)

    def score(self, col: pa.Array) -> np.ndarray:
        z = self.inputs(*term_counts(col, self.lexicon)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _linear(x: np.ndarray, target: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _same_words(counts: np.ndarray) -> np.ndarray:
    """Groups of terms that nearly always fire together (a word and its beginnings)."""
    fire = (counts > 0).astype(np.float32)
    both = fire.T @ fire
    n = np.diag(both)
    like = both / np.maximum(np.minimum(n[:, None], n[None, :]), 1) > 0.9
    group = np.arange(len(n))
    while True:
        new = np.array([group[like[i]].min() for i in range(len(n))], np.int64)
        if np.array_equal(new, group):
            return np.unique(group, return_inverse=True)[1] if len(group) else group
        group = new


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", text: str = "text", hold_mod: int = 5, hold_rest: int = 0, limit: int = TRAIN_ROWS) -> Model:
    """A model of at most ``limit`` labelled documents outside the fold; without toxic ones among them, every text scores low."""
    y = F.broadcast(labelled(labels, column, hold_mod, hold_rest, limit))
    # one text of an id, the least, so that rows are as many as ids at most
    one = docs.select("doc_id", text).join(y, "doc_id").groupBy("doc_id", "y").agg(F.min(text).alias(text))
    train = checkpointed(one.select("y", text))
    lexicon = _lexicon(train, text)
    size = len(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            counts, words = term_counts(batch.column(batch.schema.get_field_index(text)), lexicon)
            row, term = np.nonzero(counts)
            bounds = np.searchsorted(row, np.arange(len(words) + 1))
            terms = [term[a:b].astype(np.int32) for a, b in zip(bounds, bounds[1:])]
            values = [counts[i, t] for i, t in enumerate(terms)]
            arrays = [batch.column(batch.schema.get_field_index("y")), pa.array(words.astype(np.int64)), pa.array(terms, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["y", "words", "terms", "counts"])

    rows = train.mapInArrow(count, "y int, words long, terms array<int>, counts array<float>").toPandas()
    counts = np.zeros((len(rows), size), np.float32)
    for i, (t, c) in enumerate(zip(rows["terms"], rows["counts"])):
        counts[i, np.asarray(t, np.int64)] = c
    words, given = rows["words"].to_numpy(), rows["y"].to_numpy().astype(float)
    order = np.lexsort([given, words, counts.sum(1), counts @ np.arange(1, size + 1)])
    counts, words, given = counts[order], words[order], given[order]
    groups = _same_words(counts)
    model = Model(lexicon, groups, np.zeros(10 + size))
    if not size:
        model.weights[0] = -4.0
        return model
    # the voters alone make the label model, starting from texts with two hits: the given labels only say which of its two labels is which
    patterns = _patterns(counts, words, groups)
    votes = np.concatenate([patterns, counts > 0], axis=1)
    truth = LabelModel(votes, patterns[:, 1])
    truth.orient(votes, given)
    model.weights = _linear(model.inputs(counts, words), truth.posterior(votes))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and a double of that name (0 to 1)."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            s = model.score(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(s)], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op6_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Rows are scored one by one from the text alone, so repeats, ties and clashing columns change nothing.  Null texts
    score as empty ones.  Labels that are null, contradict each other or have no document are left out.  A very long text is
    read whole by one task.  No documents: no rows; no labels: a model that knows nothing.
    """
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
