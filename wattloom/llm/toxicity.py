"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: the model of a category gets the text's words and the
probabilities of the categories before it. In training those probabilities are out-of-fold
predictions, so a later model doesn't lean on how well an earlier one knows its own training rows. The
last category is the label itself; the earlier ones come from seed words in rows with that label, by which
kind of abuse it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from ._tasks import byte_texts, settled
from .shingles import PUNCTUATION, word_hashes

#: At most so many labelled rows are fitted, those with the smallest hash; words per category.
SAMPLE, WORDS, FOLDS, PENALTY = 4000, 100, 5, 0.3
#: Beginnings of words, in bytes, that count as words too: many languages compound.
PREFIXES = (3, 4, 5, 6, 7)
#: A document is rejected from this probability on.
THRESHOLD = 0.5
#: Category: seed words. The last category has none: it is the label.
CATEGORIES = {"insult": ("idiot", "moron", "stupid", "clown", "loser", "fool", "imbecile", "dumb"), "contempt": ("trash", "scum", "pathetic", "worthless", "disgusting", "vermin", "filth"), "toxic": ()}
_SEEDS = [np.concatenate([word_hashes(w.encode(), PUNCTUATION) for w in s]) if s else None for s in CATEGORIES.values()]


class Chain(NamedTuple):
    vocabulary: np.ndarray
    weights: list[np.ndarray]  # by category; each takes the words and the probabilities before it


def distinct_words(text: bytes) -> np.ndarray:
    """Hashes of the distinct words and, once for each of them, of its beginnings."""
    return word_hashes(text, PUNCTUATION, PREFIXES)


def category_labels(words: np.ndarray, toxic: float) -> list[float]:
    """The label for each category: an earlier one's holds where the text is toxic and has one of its seed words."""
    return [float(toxic) if s is None else float(toxic and np.isin(s, words).any()) for s in _SEEDS]


def fit_chain(vocabulary: np.ndarray, x: np.ndarray, ys: np.ndarray) -> Chain:
    weights = []
    for y in ys.T:
        weights.append(linear.fit(x, y, PENALTY))
        x = np.concatenate((x, linear.out_of_fold(x, y, FOLDS, PENALTY)[:, None]), axis=1)
    return Chain(vocabulary, weights)


def chain_scores(chain: Chain, words: list[np.ndarray]) -> np.ndarray:
    """A row of category probabilities for each text."""
    x = linear.presence(chain.vocabulary, words)
    first = x.shape[1]
    for w in chain.weights:
        x = np.concatenate((x, linear.predict(w, x)[:, None]), axis=1)
    return x[:, first:]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fits on at most ``sample`` labelled rows, chosen by a hash of the id; null labels and texts don't take part."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    chosen = y.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    d = docs.select("doc_id", "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [distinct_words(t) for t in byte_texts(b.column("text"))]
            ys = [category_labels(w, t) for w, t in zip(words, b.column("toxic").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array(ys, pa.list_(pa.float64()))], ["doc_id", "words", "ys"])

    both = d.join(F.broadcast(chosen), d.doc_id == chosen.labelled).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))  # at most ``sample`` ids
    rows = settled(both.mapInArrow(run, "doc_id long, words array<long>, ys array<double>"))
    vocabulary = linear.telling(rows, WORDS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = linear.presence(vocabulary, [np.asarray(w.values, np.int64).view(np.uint64) for w in b.column("words")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), b.column("ys")], ["doc_id", "x", "ys"])

    table = rows.mapInArrow(counted, "doc_id long, x array<double>, ys array<double>")
    # of rows that repeat an id one stays, so that at most ``sample`` rows reach the driver
    table = table.groupBy("doc_id").agg(F.min_by(F.struct("x", "ys"), F.xxhash64("x", "ys")).alias("r")).select("doc_id", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if not len(table):
        return Chain(np.empty(0, np.uint64), [np.array([*np.zeros(i), -35.0]) for i in range(len(CATEGORIES))])
    return fit_chain(vocabulary, np.array(table["x"].tolist(), float).reshape(len(table), -1), np.array(table["ys"].tolist(), float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with p_insult, p_contempt, p_toxic and rejected (p_toxic >= ``threshold``).

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic (0 or 1); columns of those names are
    replaced. A null text counts as empty and gets the scores of a text without words. Without labelled
    rows nothing is rejected. Repeated rows and null ids are scored as they come; an empty table gives no rows.
    """
    chain = train(docs, labels, sample)
    names = [f"p_{c}" for c in CATEGORIES]
    docs = docs.drop(*names, "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(byte_texts(b.column("text")))
            p = np.concatenate([chain_scores(chain, [distinct_words(t) for t in texts[at : at + 256]]) for at in range(0, len(texts), 256)] or [np.empty((0, len(names)))])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], [*b.schema.names, *names, "rejected"])

    schema = [*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(schema))
