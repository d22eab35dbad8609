"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by fast Hadamard pseudo-rotations (three rounds of random signs and a Walsh-Hadamard
transform) and hashed to the signed axis nearest to it. Where a table needs more buckets than there are axes, the
codes of several rotations are combined; where it needs fewer, the last rotation uses its first axes only, so that
the number of buckets follows the number of vectors. Each of TABLES tables has its own rotations. A query probes in
each table the buckets nearest to it, by the sum of projections; how many is told by a sample of queries that are
compared with all rows. All candidates are reranked by exact inner products.

The index has every vector. Vectors of different lengths are indexed apart. Buckets, and the queries that probe them,
are dealt in chunks of bounded size, so no bucket is capped and none has to fit in one task. Queries whose buckets
hold fewer than k others are compared with all rows, in blocks of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tasks import settled

TABLES = 16
#: Vectors in a bucket, about; buckets a table has at least; rotations that are combined at most.
BUCKET, LEAST, LEVELS = 512, 8, 3
#: Vectors and queries in a group that is compared at once.
CHUNK = 1024
#: The sample of queries, those with the smallest hash of the id, the share of their neighbours that the probes must reach, and probes at most.
SAMPLE, RECALL, MOST = 100, 0.96, 4096
#: Times larger the buckets get where ``MOST`` probes don't reach the recall; sums of projections that are held at once.
COARSER, SCORES = 4, 1 << 22
#: Buckets that are dealt in several chunks: so many are sent to all executors, more are joined by a shuffle.
BROADCAST = 100_000
ROUNDS = 3


def width(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of ``x``, padded to a power of two, after pseudo-rotations given by ``seed``."""
    n, d = x.shape
    w = width(d)
    y = np.zeros((n, w))
    y[:, :d] = x
    for s in np.random.default_rng(seed).choice([-1.0, 1.0], (ROUNDS, w)):
        y *= s / np.sqrt(w)
        h = 1
        while h < w:
            z = y.reshape(n, -1, 2, h)
            low, high = z[:, :, 0], z[:, :, 1]
            less = low - high
            low += high
            high[...] = less
            h *= 2
    return y


def levels(n: int, dim: int, bucket: int) -> list[int]:
    """Axes used of each rotation, for ``n`` vectors: their product is the number of buckets."""
    need, out = max(LEAST, 1 << max(0, (n - 1) // bucket).bit_length()), []
    while need > 1 and len(out) < LEVELS:
        out.append(min(2 * width(dim), need))
        need = -(-need // out[-1])
    return out


def probes(x: np.ndarray, table: int, axes: list[int], most: int) -> np.ndarray:
    """For each row the codes of its ``most`` nearest buckets in a table, nearest first. So many rows at a time that their sums take SCORES numbers."""
    rows = max(1, SCORES // (most * max(axes, default=1))) if most > 1 and len(axes) > 1 else len(x)
    if rows < len(x):
        return np.concatenate([probes(x[at : at + rows], table, axes, most) for at in range(0, len(x), rows)])
    codes, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for k, m in enumerate(axes):
        y = rotated(x, 1000 * table + k)[:, : max(1, m // 2)]
        both = np.concatenate((y, -y), axis=1)
        if most == 1:
            codes = codes * both.shape[1] + both.argmax(axis=1)[:, None]
            continue
        near = np.argsort(-both, axis=1, kind="stable")[:, :most]
        codes = (codes[:, :, None] * both.shape[1] + near[:, None, :]).reshape(len(x), -1)
        score = (score[:, :, None] + np.take_along_axis(both, near, 1)[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :most]
        codes, score = np.take_along_axis(codes, best, 1), np.take_along_axis(score, best, 1)
    return codes


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary vectors of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]).view(np.float64).reshape(len(column), -1)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(length, matrix, rows) for each length in a batch."""
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims):
        part = b.take(pa.array(np.flatnonzero(dims == d)))
        yield int(d), _matrix(part.column("v")), part


def _scaled(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def scores(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of given pairs, each summed in the same way wherever it is computed."""
    return np.ascontiguousarray(q[qi] * v[vi]).sum(axis=1)


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors as bytes of doubles, which Spark moves without looking into them."""
    out = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64).tobytes() for v in b.column("v")]
    return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("query"), b.column("dim"), pa.array(out, pa.binary())], ["vec_id", "query", "dim", "v"])


def indexed(rows: DataFrame, n: int, tables: int, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, query, dim, v array) to (vec_id, query, dim, v binary, codes), the bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                for d, x, part in _by_length(_packed(whole.slice(at, 1024))):
                    unit, axes = _scaled(x), levels(n, d, bucket)
                    codes = np.concatenate([probes(unit, t, axes, 1) for t in range(tables)], axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(codes), pa.list_(pa.int64()))], ["vec_id", "query", "dim", "v", "codes"])

    return rows.mapInArrow(run, "vec_id long, query boolean, dim int, v binary, codes array<long>")


def probes_needed(index: DataFrame, n: int, k: int, tables: int, bucket: int = BUCKET, sample: int = SAMPLE, recall: float = RECALL, most: int = MOST) -> tuple[int, float]:
    """How many probes in each table, ``most`` at most, reach ``recall`` of the true neighbours of a sample of queries, and what they reach of them."""
    asked = index.where("query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "dim", "v").collect()  # at most ``sample`` rows
    by_dim: dict[int, list[int]] = {}
    for i, r in enumerate(asked):
        by_dim.setdefault(r["dim"], []).append(i)
    ids = [r["vec_id"] for r in asked]
    queries = {d: np.stack([np.frombuffer(asked[i]["v"], np.float64) for i in at]) for d, at in by_dim.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x, part in _by_length(b):
                if d not in queries:
                    continue
                own = part.column("vec_id").to_numpy()
                s = queries[d] @ x.T
                s[np.array([ids[i] for i in by_dim[d]])[:, None] == own[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                q, c = np.repeat(np.array(by_dim[d]), top.shape[1]), top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), part.column("vec_id").take(pa.array(c)), pa.array(np.take_along_axis(s, top, 1).ravel()), part.column("codes").take(pa.array(c))], ["q", "vec_id", "score", "codes"])

    found = index.mapInArrow(nearest, "q int, vec_id long, score double, codes array<long>").where("score > double('-infinity')")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "codes").collect()  # at most k for each sampled query
    if not true:
        return 1, 1.0
    reached = []
    for d, at in by_dim.items():
        unit, axes = _scaled(queries[d]), levels(n, d, bucket)
        order = [probes(unit, t, axes, most) for t in range(tables)]
        place = {i: j for j, i in enumerate(at)}
        for r in true:
            if r["q"] in place:
                hits = [np.flatnonzero(order[t][place[r["q"]]] == r["codes"][t]) for t in range(tables)]
                reached.append(min((int(h[0]) + 1 for h in hits if len(h)), default=most + 1))
    reached = np.sort(np.array(reached))
    need = min(int(reached[int(np.ceil(recall * len(reached))) - 1]), most)
    return need, float((reached <= need).mean())


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = TABLES, bucket: int = BUCKET, probed: int | None = None, most: int = MOST) -> DataFrame:
    """The ``k`` rows found nearest to each query: (query_id, rank, vec_id, score), the query itself left out.

    Nearness is the largest inner product of the original vectors in double precision, ties to the smaller
    vec_id. ``is_query`` marks the queries. Vectors that are null or zero, or that hold null or non-finite
    components take no part, nor do null ids. An inner product needs vectors of one length: the candidates of a query are
    the vectors as long as it. ``bucket``: vectors in a bucket, about. ``probed``: buckets probed in each table, else as many as a sample
    tells. Where ``most`` don't reach RECALL of its neighbours, the vectors are indexed anew in larger buckets, if need be in LEAST ones, all of which can be probed.
    Ids should be distinct; a repeated id counts once. An empty table gives no rows.
    """
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.size(v).alias("dim"), v.alias("v"))
    good = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    n = rows.count()
    index = settled(indexed(rows, n, tables, bucket))
    while probed is None:
        need, reached = probes_needed(index, n, k, tables, bucket, most=most if bucket < n else max(most, LEAST))
        if reached >= RECALL or bucket >= n:
            probed = need
        else:
            bucket *= COARSER
            index = settled(indexed(rows, n, tables, bucket))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                for d, x, part in _by_length(whole.slice(at, 256)):
                    unit, axes = _scaled(x), levels(n, d, bucket)
                    for t in range(tables):
                        codes = probes(unit, t, axes, probed)
                        own = part.take(pa.array(np.repeat(np.arange(len(part)), codes.shape[1])))
                        yield pa.RecordBatch.from_arrays([own.column("dim"), pa.array(np.full(len(own), t, np.int32)), pa.array(codes.ravel()), own.column("vec_id"), own.column("v")], ["dim", "table", "bucket", "vec_id", "v"])

    key = ["dim", "table", "bucket"]
    held = index.select("dim", F.posexplode("codes").alias("table", "bucket"), "vec_id", "v")
    asked = index.where("query").mapInArrow(ask, "dim int, table int, bucket long, vec_id long, v binary")
    sizes = held.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("vs")).join(asked.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("qs")), key)
    large = settled(sizes.where("vs > 1 or qs > 1"))
    large = F.broadcast(large) if large.count() <= BROADCAST else large
    deal = F.xxhash64("vec_id")
    parts = lambda c: F.coalesce(c, F.lit(1))
    upto = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    cols = [*key, "vc", "qc", "vec_id", "v"]
    a = held.join(large, key, "left").withColumn("vc", F.pmod(deal, parts(F.col("vs")))).withColumn("qc", upto(F.col("qs"))).select(*cols, F.lit(False).alias("query"))
    b = asked.join(large, key, "left").withColumn("qc", F.pmod(deal, parts(F.col("qs")))).withColumn("vc", upto(F.col("vs"))).select(*cols, F.lit(True).alias("query"))

    def compare(group: pa.Table) -> pa.Table:
        ask = group.column("query").to_numpy(zero_copy_only=False)
        q, c = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(q) or not len(c):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = group.column("vec_id").to_numpy(), _matrix(group.column("v"))
        rough = x[q] @ x[c].T
        rough[ids[q][:, None] == ids[c][None, :]] = -np.inf
        most = min(k, len(c))
        edge = np.partition(rough, len(c) - most, axis=1)[:, len(c) - most]
        # what ties with the last by rounding comes along, and is told apart by the exact sums
        qi, ci = np.nonzero((rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & (rough > -np.inf))
        s = scores(x, x, q[qi], c[ci])
        order = np.lexsort((ids[c[ci]], -s, qi))
        qi, ci, s = qi[order], ci[order], s[order]
        first = np.searchsorted(qi, np.arange(len(q)))
        hold = np.arange(len(qi)) - first[qi] < k
        return pa.table({"query_id": ids[q[qi[hold]]], "vec_id": ids[c[ci[hold]]], "score": s[hold]})

    pairs = "query_id long, vec_id long, score double"

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = settled(best(a.union(b).groupBy(*key, "vc", "qc").applyInArrow(compare, pairs)))
    # queries that got fewer than k rows, though there are more of their length
    others = index.groupBy("dim").agg((F.countDistinct("vec_id") - 1).alias("others"))
    had = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("had"))
    short = index.where("query").select("vec_id", "dim", "v").join(others, "dim").join(had, "vec_id", "left")
    short = settled(short.where(F.coalesce("had", F.lit(0)) < F.least(F.col("others"), F.lit(k))).select("vec_id", "dim", "v"))
    asking = short.count()
    if not asking:
        return found
    vs, qs = -(-n // CHUNK), -(-asking // CHUNK)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cols = ["dim", "vc", "qc", "vec_id", "v"]
    a = index.withColumn("vc", F.pmod(deal, F.lit(vs))).withColumn("qc", every(qs)).select(*cols, F.lit(False).alias("query"))
    b = short.withColumn("qc", F.pmod(deal, F.lit(qs))).withColumn("vc", every(vs)).select(*cols, F.lit(True).alias("query"))
    exact = best(a.union(b).groupBy("dim", "vc", "qc").applyInArrow(compare, pairs))
    return found.join(short.select("vec_id").distinct(), found.query_id == short.vec_id, "left_anti").union(exact)
