"""Quality by co-training two views: the text's content and the page's metadata.

Each view has a linear classifier on the same labelled rows. In each round either view labels the rows
of which it is surest, of all that are not in the labelled sample, for the other view to learn from. At the end each view's probabilities are calibrated
on predictions for labelled rows by views that were co-trained without them, and the calibrated log-odds are added, weighed by how well each
view tells the labels, to score all documents.

Texts are read twice: the labelled ones for the vocabulary, then all, once, for the features of either view. Rounds and scores read the features.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import linear
from ._tasks import byte_texts, settled
from .shingles import word_hashes

#: At most so many labelled rows are fitted, those with the smallest hash; all others are the pool. ADDED: pseudo-labels
#: of a kind that a view gives in a round, the surest of the whole pool.
SAMPLE, WORDS, ROUNDS, ADDED, PENALTY = 3000, 150, 4, 60, 1.0
#: Pseudo-labels need at least this probability.
SURE = 0.9
THRESHOLD = 0.5
#: Places for sources and languages: as many as the labelled sample's most frequent ones have their own, the rest share the last.
SOURCES, LANGS = 64, 8


def shape(text: bytes, words: np.ndarray) -> list[float]:
    """Form of a text: shares of kinds of characters, repetition, length of words and lines."""
    raw = np.frombuffer(text, np.uint8)
    n, w = max(len(raw), 1), max(len(words), 1)
    count = np.bincount(raw, minlength=256)
    share = lambda cs: float(count[list(cs)].sum()) / n
    lines = text.split(b"\n")
    return [
        share(range(65, 91)), share(range(48, 58)), share(b".,;:"), share(b"!?"), share(b"%*&$#@|<>{}=+~^_"), float(count[128:].sum()) / n,
        len(np.unique(words)) / w, len(set(lines)) / len(lines), min(n / w, 40) / 10, np.log1p(n / len(lines)) / 5,
        float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0, float(len(words) == 0),
    ]


class Slots(NamedTuple):
    """The languages and sources that have a place of their own."""

    langs: tuple[str, ...]
    sources: tuple[str, ...]


def slots_of(lang: pd.Series, source: pd.Series) -> Slots:
    """The most frequent values of a sample, ties by name; null counts as empty."""
    most = lambda s, m: tuple(sorted((v := s.fillna("").astype(str).value_counts()).index, key=lambda x: (-v[x], x))[: m - 1])
    return Slots(most(lang, LANGS), most(source, SOURCES))


def metadata(lang: pd.Series, source: pd.Series, n_chars: pd.Series, slots: Slots | None = None) -> np.ndarray:
    """What is known of a page without its text: language and source by indicators, length in steps. Without ``slots`` places are hashed."""
    text = lambda s: s.fillna("").astype(str).to_numpy(object)
    if slots is None:
        hashed = lambda s, _, m: (pd.util.hash_array(text(s)) % np.uint64(m)).astype(int)
    else:
        hashed = lambda s, names, m: pd.Series(text(s)).map({x: i for i, x in enumerate(names)}).fillna(m - 1).to_numpy(int)
    known = slots or Slots((), ())
    size = np.log1p(pd.to_numeric(n_chars, errors="coerce").fillna(0).clip(lower=0).to_numpy(float))
    steps = np.clip(size, 0, 12).astype(int)
    return np.concatenate((np.eye(LANGS)[hashed(lang, known.langs, LANGS)], np.eye(SOURCES)[hashed(source, known.sources, SOURCES)], np.eye(13)[steps], (size / 10)[:, None]), axis=1)


class Views(NamedTuple):
    vocabulary: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    calibrated: tuple[np.ndarray, np.ndarray]
    trust: tuple[float, float]
    prior: float
    slots: Slots


def content(vocabulary: np.ndarray, shapes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    return np.concatenate((linear.presence(vocabulary, words), shapes * 5), axis=1)


def surest(w: list[list[np.ndarray]], texts: np.ndarray, metas: np.ndarray, keys: np.ndarray, taken: list[list[set]], added: int) -> Iterator[tuple[int, int, float, list[tuple[float, int, int]]]]:
    """(variant, pupil, label, rows as (minus probability, tie-break, index)): of each kind the ``added`` rows whose other view is surest and that the pupil hasn't got, best first."""
    tie = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    for v, (text, meta) in enumerate(w):
        for pupil, p in ((1, linear.predict(text, texts)), (0, linear.predict(meta, metas))):
            new = np.array([k not in taken[v][pupil] for k in keys.tolist()], bool)
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                good = np.flatnonzero(new & (sure >= SURE))
                good = good[np.lexsort((tie[good], -sure[good]))][:added]
                yield v, pupil, label, [(-float(sure[i]), int(tie[i]), int(i)) for i in good]


#: Weights of each variant's views, and the keys that their pupils have: pseudo-labels (variant, pupil, label, key, text, metadata).
Offers = Callable[[list[list[np.ndarray]], list[list[set]]], list[tuple]]


def exchange(variants: list[np.ndarray], texts: np.ndarray, metas: np.ndarray, y: np.ndarray, offers: Offers, rounds: int = ROUNDS) -> list[list[np.ndarray]]:
    """Weights of both views for each variant, that is for the labelled rows it may learn from; all variants share the passes over the pool."""
    learnt = [[(x[r], y[r]) for x in (texts, metas)] for r in variants]
    taken: list[list[set]] = [[set(), set()] for _ in variants]
    fitted = lambda: [[linear.fit(x, t, PENALTY) for x, t in views] for views in learnt]
    w = fitted()
    for _ in range(rounds):
        for v, pupil, label, key, *both in offers(w, taken):
            x, t = learnt[v][pupil]
            learnt[v][pupil] = np.concatenate((x, both[pupil][None])), np.append(t, label)
            taken[v][pupil].add(key)
        w = fitted()
    return w


def co_train(texts: np.ndarray, metas: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, added: int = ADDED) -> tuple[np.ndarray, np.ndarray]:
    """Rows in memory; ``y``: 1, 0 or NaN for the pool. Returns the weights of both views."""
    known, pool = ~np.isnan(y), np.flatnonzero(np.isnan(y))

    def offers(w: list[list[np.ndarray]], taken: list[list[set]]) -> list[tuple]:
        found = surest(w, texts[pool], metas[pool], pool, taken, added)
        return [(v, pupil, label, int(pool[i]), texts[pool[i]], metas[pool[i]]) for v, pupil, label, rows in found for *_, i in rows]

    (both,) = exchange([np.arange(known.sum())], texts[known], metas[known], y[known], offers, rounds)
    return both[0], both[1]


def fit_views(vocabulary: np.ndarray, rows: pd.DataFrame, offers: Offers, slots: Slots, k: int = 3) -> Views:
    """``rows``: x (the text's content), lang, source, n_chars, quality. Calibrated by views that were co-trained, pool and all, without a row's fold."""
    y = pd.to_numeric(rows["quality"]).to_numpy(float)
    texts, metas = np.array(rows["x"].tolist(), float), metadata(rows["lang"], rows["source"], rows["n_chars"], slots)
    every, fold = np.arange(len(y)), linear.folds(len(y), k)
    rests = [r for f in range(k) if len(set(y[r := np.flatnonzero(fold != f)])) == 2]
    w, *without = exchange([every, *rests], texts, metas, y, offers)
    held = [np.full(len(y), y.mean()) for _ in range(2)]
    for r, views in zip(rests, without, strict=True):
        out = np.setdiff1d(every, r)
        for p, weights, x in zip(held, views, (texts, metas), strict=True):
            p[out] = linear.predict(weights, x[out])
    calibrated = tuple(linear.platt(p, y) for p in held)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = -(prior * np.log(prior) + (1 - prior) * np.log(1 - prior))
    trust = []
    for p, c in zip(held, calibrated, strict=True):
        q = np.clip(linear.predict(c, linear.logit(p)[:, None]), 1e-6, 1 - 1e-6)
        loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()
        trust.append(max(0.0, 1 - float(loss) / base))
    return Views(vocabulary, *w, calibrated, (trust[0], trust[1]), prior, slots)


META = ("lang", "source", "n_chars")


def featured(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, text, lang, source, n_chars) to (doc_id, lang, source, n_chars, x): the content of each text, compressed, in place of the text; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 256) for at in range(0, len(b), 256)):
                words, shapes = _features(part)
                x = content(vocabulary, np.array(shapes, float).reshape(len(part), -1), words)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *META)), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], ["doc_id", *META, "x"])

    return settled(docs.select("doc_id", "text", *META).mapInArrow(run, "doc_id long, lang string, source string, n_chars long, x binary"))


def _both(part: pa.RecordBatch, slots: Slots | None) -> tuple[np.ndarray, np.ndarray]:
    """Content and metadata of ``featured`` rows."""
    frame = part.select(list(META)).to_pandas()
    x = np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in part.column("x")), float)
    return x.reshape(len(part), -1), metadata(frame["lang"], frame["source"], frame["n_chars"], slots)


def pool_offers(pool: DataFrame, vocabulary: np.ndarray, added: int = ADDED, slots: Slots | None = None) -> Offers:
    """Pseudo-labels from all rows of ``pool`` (doc_id, text or ``featured`` x, lang, source, n_chars): each task keeps the surest of each kind, Spark the surest of all tasks."""
    pool = pool if "x" in pool.columns else featured(pool, vocabulary)
    out = "variant int, pupil int, label double, sure double, tie long, doc_id long, x array<double>, m array<double>"
    kind = ["variant", "pupil", "label"]

    def offers(w: list[list[np.ndarray]], taken: list[list[set]]) -> list[tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple, list[tuple]] = {}
            for b in batches:
                for part in (b.slice(at, 1024) for at in range(0, len(b), 1024)):
                    x, m = _both(part, slots)
                    keys = part.column("doc_id").to_numpy()
                    for v, pupil, label, rows in surest(w, x, m, keys, taken, added):
                        held = best.setdefault((v, pupil, label), [])
                        if len(held) == added:
                            rows = [r for r in rows if r[:2] < held[-1][:2]]
                        if rows:
                            both = sorted([*held, *((s, t, int(keys[i]), x[i].copy(), m[i].copy()) for s, t, i in rows)], key=lambda r: r[:3])
                            once = {r[2]: r for r in reversed(both)}  # of rows that repeat an id the surest
                            best[v, pupil, label] = sorted(once.values(), key=lambda r: r[:3])[:added]
            flat = [(*k, -s, t, key, x, m) for k, rows in best.items() for s, t, key, x, m in rows]
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate(kinds)], [c.split()[0] for c in out.split(", ")])

        order = [F.desc("sure"), "tie", "doc_id"]
        found = pool.mapInArrow(run, out)
        once = found.groupBy(*kind, "doc_id").agg(F.max_by(F.struct("sure", "tie", "x", "m"), F.struct("sure", F.xxhash64("x", "m"))).alias("r")).select(*kind, "doc_id", "r.*")
        top = once.withColumn("rank", F.row_number().over(W.partitionBy(*kind).orderBy(*order))).where(F.col("rank") <= added)
        rows = top.orderBy(*kind, "rank").collect()  # ``added`` of each kind
        return [(r["variant"], r["pupil"], r["label"], r["doc_id"], np.array(r["x"]), np.array(r["m"])) for r in rows]

    return offers


def combined(v: Views, texts: np.ndarray, metas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of the views, and of both: what each says beyond the prior, by its trust."""
    ps = [linear.predict(c, linear.logit(linear.predict(w, x))[:, None]) for w, x, c in zip((v.text, v.meta), (texts, metas), v.calibrated, strict=True)]
    prior, total = linear.logit(np.array(v.prior)), max(max(v.trust), 1e-9)
    z = prior + sum((linear.logit(p) - prior) * t / total for p, t in zip(ps, v.trust, strict=True))
    return ps[0], ps[1], linear.sigmoid(z)


def _features(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[list[float]]]:
    words, shapes = [], []
    for t in byte_texts(b.column("text")):
        w = word_hashes(t)
        shapes.append(shape(t, w))
        words.append(np.unique(w))
    return words, shapes


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Views | None, DataFrame | None]:
    """Fits on at most ``sample`` labelled rows, chosen by a hash of the id, and pseudo-labels from all others; with the features of all rows. Nothing without labels of both kinds."""
    y = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    every = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    some = every.where("doc_id is not null")
    ids = some.select("doc_id").join(y, some.doc_id == y.labelled).select("doc_id", "quality").distinct()
    chosen = settled(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("chosen"), "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, shapes = _features(b)
            kept = [b.column(c) for c in ("doc_id", "lang", "source", "n_chars", "quality")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())), pa.array(shapes, pa.list_(pa.float64()))], ["doc_id", "lang", "source", "n_chars", "quality", "words", "shape"])

    few = F.broadcast(chosen.withColumn("quality", F.col("quality").cast("int")))  # at most ``sample`` rows
    out = some.join(few, F.col("doc_id") == F.col("chosen")).drop("chosen")
    rows = settled(out.mapInArrow(run, "doc_id long, lang string, source string, n_chars long, quality int, words array<long>, shape array<double>"))
    if rows.select("quality").distinct().count() != 2:
        return None, None
    vocabulary = linear.telling(rows.select("words", F.array(F.col("quality").cast("double")).alias("ys")), WORDS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.asarray(w.values, np.int64).view(np.uint64) for w in b.column("words")]
            x = content(vocabulary, np.array(b.column("shape").to_pylist(), float).reshape(len(words), -1), words)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(list(x), pa.list_(pa.float64()))], [*kept, "x"])

    kept = ["doc_id", "lang", "source", "n_chars", "quality"]
    table = rows.mapInArrow(counted, "doc_id long, lang string, source string, n_chars long, quality int, x array<double>")
    # of rows that repeat an id one stays, so that at most ``sample`` rows reach the driver
    one = F.struct("lang", "source", "n_chars", "quality", "x")
    table = table.groupBy("doc_id").agg(F.min_by(one, F.xxhash64("x", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id")
    frame = table.toPandas()
    features, slots = featured(every, vocabulary), slots_of(frame["lang"], frame["source"])
    pool = features.where("doc_id is not null").join(few, F.col("doc_id") == F.col("chosen"), "left_anti")
    return fit_views(vocabulary, frame, pool_offers(pool, vocabulary, slots=slots), slots), features


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, p_text, p_metadata, quality, keep), keep being quality >= ``threshold``.

    ``docs`` needs doc_id, text, lang, source and n_chars, ``labels`` doc_id and quality (0 or 1). Null
    metadata count as an empty language or source or a length of 0, a null text as empty. Without
    labels of both kinds everything gets 1 and is kept. Pseudo-labels come from all rows with an id, of rows that repeat one from the surest. Repeated rows and null ids are scored as they come;
    other columns are dropped; an empty table gives no rows.
    """
    views, features = train(docs, labels, sample)
    if views is None:
        one = F.lit(1.0)
        return docs.select(F.col("doc_id").cast("long"), one.alias("p_text"), one.alias("p_metadata"), one.alias("quality"), F.lit(1.0 >= threshold).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, 1024) for at in range(0, len(b), 1024)):
                ps = combined(views, *_both(part, views.slots))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, ps), pa.array(ps[2] >= threshold)], ["doc_id", "p_text", "p_metadata", "quality", "keep"])

    return features.mapInArrow(run, "doc_id long, p_text double, p_metadata double, quality double, keep boolean")
