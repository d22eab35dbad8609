"""Diagnostics: errors of forecasts, correlations, autocorrelation, outliers, spectra, decomposition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bronze import settled
from .features import CHUNK, interpolate


def slope(y: str, x: str) -> Column:
    """Least-squares slope over a group; null with fewer than two rows or any null value."""
    return F.when((F.count("*") > 1) & (F.count(y) == F.count("*")), F.regr_slope(F.col(y), F.col(x)))


def errors(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"))


def linear_fit(data: DataFrame, target: str, features: list[str], train: str = "train") -> Column:
    """The least-squares fit of ``target`` on the rows of split ``train`` without null features, as a column. Columns that don't vary there are left out."""
    gram = co_moments(data.na.drop(subset=[*features, target]).where(F.col("split") == train), [*features, target])
    rows = gram.collect()  # k * k rows
    names = [*features, target]
    cov, mean = pd.DataFrame(0.0, names, names), {}
    for r in rows:
        cov.loc[r["a"], r["b"]] = cov.loc[r["b"], r["a"]] = r["cab"]
        mean[r["a"]] = r["ma"]
    used = [f for f in features if cov.loc[f, f] > 1e-12]
    w = np.linalg.lstsq(cov.loc[used, used].to_numpy(), cov.loc[used, target].to_numpy(), rcond=None)[0] if used else []
    fit = F.lit(float(mean.get(target) or 0.0))
    for f, k in zip(used, w, strict=True):
        fit = fit + (F.col(f) - float(mean[f])) * float(k)
    return fit


def linear_forecast(data: DataFrame, target: str, features: list[str], train: str = "train") -> DataFrame:
    """Least squares on the rows of split ``train`` without null features; errors by split."""
    fit = linear_fit(data, target, features, train)
    return errors(data.na.drop(subset=[*features, target]).select("split", F.col(target).alias("y"), fit.alias("p")), ["split"])


def co_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, ma, mb, caa, cbb, cab) of each pair a <= b in order, over rows where both are there.

    Each batch gives its counts, sums and products around the columns' overall means as k * k rows; Spark adds them up.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] if means[c] is not None else 0.0 for c in columns])
    k = len(columns)
    ia, ib = np.triu_indices(k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, k, k))
        for pdf in frames:
            x = pdf.to_numpy(float) - centre
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pd.DataFrame({"i": ia, "j": ib} | {c: t[ia, ib] for c, t in zip(("n", "sa", "sb", "qa", "qb", "p"), total, strict=True)})

    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    s = x.mapInPandas(run, "i int, j int, n double, sa double, sb double, qa double, qb double, p double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    at = lambda c: F.element_at(F.array(*[F.lit(float(v)) for v in centre]), F.col(c) + 1)
    n = F.nullif("n", F.lit(0.0))  # no row has both
    return s.select(
        name("i").alias("a"), name("j").alias("b"), F.col("n").cast("long").alias("n"),
        (at("i") + F.col("sa") / n).alias("ma"), (at("j") + F.col("sb") / n).alias("mb"),
        (F.col("qa") - F.col("sa") * F.col("sa") / n).alias("caa"), (F.col("qb") - F.col("sb") * F.col("sb") / n).alias("cbb"),
        (F.col("p") - F.col("sa") * F.col("sb") / n).alias("cab"),
    )


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a before b: Pearson over pairwise complete rows; null where one doesn't vary."""
    m = co_moments(df, columns).where("a <> b")
    ok = (F.col("caa") > 1e-12) & (F.col("cbb") > 1e-12)
    return m.select("a", "b", F.when(ok, F.col("cab") / F.sqrt(F.col("caa") * F.col("cbb"))).alias("r"))


#: The sums that ``lag_sums`` gives for each lag, of the values y and those x that many positions before.
LAG_SUMS = ("n", "y", "x", "yy", "xx", "xy")


def lag_sums(series: DataFrame, lags: int, of: str, at: str = "slot", chunk: int = 4320) -> DataFrame:
    """(series_id, lag, n, y, x, yy, xx, xy) for the lags 0 to ``lags``: how many pairs are both there, and their sums around the series' mean.

    Overlap-save: a task has the values of one chunk of positions and of the ``lags`` positions before it, and gets the sums
    of all lags at once as products of Fourier transforms, values and what is there apart. Each value is moved once, and once more to the next
    chunk where that needs it; chunks are at least four times as long as the lags, so what leaves a task is less than what it read.
    """
    v = series.where(F.col(of).isNotNull()).select("series_id", F.col(at).cast("long").alias("t"), F.col(of).cast("double").alias("v"))
    v = beside(v, v.groupBy("series_id").agg(F.avg("v").alias("m")), ["series_id"]).select("series_id", "t", (F.col("v") - F.col("m")).alias("v"))
    size = max(chunk, 4 * lags)
    own = F.floor(F.col("t") / size)
    dealt = v.withColumn("chunk", F.explode(F.sequence(own, F.floor((F.col("t") + lags) / size))))
    length = 1 << (size + lags - 1).bit_length()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf["t"].to_numpy() - pdf["chunk"].iloc[0] * size + lags
        x, there = np.zeros(length), np.zeros(length)
        x[place], there[place] = pdf["v"].to_numpy(), 1.0
        parts = np.stack([there, x, x * x])
        now = parts.copy()
        now[:, :lags] = 0.0
        late, early = np.fft.rfft(now), np.conj(np.fft.rfft(parts))
        pairs = {"n": (0, 0), "y": (1, 0), "x": (0, 1), "yy": (2, 0), "xx": (0, 2), "xy": (1, 1)}
        sums = {c: np.fft.irfft(late[i] * early[j], length)[: lags + 1] for c, (i, j) in pairs.items()}
        sums["n"] = np.rint(sums["n"])
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "lag": np.arange(lags + 1)} | sums)

    kind = series.schema["series_id"].dataType.simpleString()
    out = dealt.groupBy("series_id", "chunk").applyInPandas(lambda pdf: run(pdf), f"series_id {kind}, lag long, " + ", ".join(f"{c} double" for c in LAG_SUMS))
    return out.groupBy("series_id", "lag").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in LAG_SUMS[1:]])


def acf(series: DataFrame, lags: int, of: str, at: str = "slot", chunk: int = 4320) -> DataFrame:
    """(series_id, lag, r, n, band): Pearson of each series and itself ``lag`` rows before, over pairs that are both there; band is 1.96 / sqrt of the series' values.

    r is null where either side of the pairs doesn't vary; lags without a pair are absent.
    """
    s = lag_sums(series, lags, of, at, chunk)
    whole = s.where("lag = 0").select("series_id", F.col("n").alias("values"), F.col("yy").alias("all"))
    x = beside(s.where("lag > 0 and n > 0"), whole, ["series_id"])
    vy, vx, c = (F.col(q) - F.col(a) * F.col(b) / F.col("n") for q, a, b in (("yy", "y", "y"), ("xx", "x", "x"), ("xy", "x", "y")))
    varies = F.least(vy, vx) > 1e-10 * F.col("all")
    return x.select("series_id", "lag", F.when(varies, c / F.sqrt(vy * vx)).alias("r"), "n", (1.96 / F.sqrt("values")).alias("band"))


def numbered(rows: DataFrame, chunk: int = 4320) -> DataFrame:
    """``rows`` with pos, their number from 1 in the order of slot: counted in each chunk of slots, from where the chunks before it end."""
    x = rows.withColumn("chunk", F.floor(F.col("slot") / chunk))
    before = F.coalesce(F.sum("n").over(W.partitionBy("series_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = x.groupBy("series_id", "chunk").agg(F.count("*").alias("n")).select("series_id", "chunk", before.alias("base"))  # one row for each chunk
    own = F.row_number().over(W.partitionBy("series_id", "chunk").orderBy("slot"))
    return x.join(base, ["series_id", "chunk"]).withColumn("pos", (F.col("base") + own).cast("long")).select(*rows.columns, "pos")


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the number of each row, from 1, in ``order`` over all rows.

    Rows are sorted across partitions by range and counted in each; what the partitions before hold is added, told by a table
    of one row for each partition. No task sees more than its range. Rows that ``order`` doesn't tell apart share a partition and
    are numbered in any order.
    """
    x = settled(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()  # the partition's number above the row's in it
    x = x.withColumn(name, at).withColumn("of_part", F.shiftright(name, 33))
    held = x.groupBy("of_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("of_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    x = x.join(F.broadcast(held.select("of_part", before.alias("of_before"))), "of_part")
    return x.withColumn(name, F.col(name).bitwiseAND((1 << 33) - 1) + F.col("of_before") + 1).select(*df.columns, name)


def neighbour(rows: DataFrame, of: str, chunk: int = 4320) -> DataFrame:
    """``rows`` with before: the value of the row before in the order of slot, chunk by chunk; a chunk's first row takes the last of the chunks before it."""
    x = rows.withColumn("chunk", F.floor(F.col("slot") / chunk))
    ends = x.groupBy("series_id", "chunk").agg(F.max_by(of, "slot").alias("last"))
    ends = ends.select("series_id", "chunk", F.lag("last").over(W.partitionBy("series_id").orderBy("chunk")).alias("last"))  # one row for each chunk
    own = F.lag(of).over(W.partitionBy("series_id", "chunk").orderBy("slot"))
    return x.join(ends, ["series_id", "chunk"]).withColumn("before", F.coalesce(own, "last")).select(*rows.columns, "before")


def acf_depth(series: DataFrame, of: str, alpha: float = 0.05, least: int = 10, most: int = 2000, run: int = 5) -> DataFrame:
    """(series_id, depth): the first lag of the first ``run`` insignificant lags in a row, on each series without its nulls.

    All lags come from one pass of ``lag_sums``; what is looked at in order then are ``most`` rows for each series.
    """
    v = numbered(series.where(F.col(of).isNotNull()).select("series_id", "slot", of)).select("series_id", F.col(of).alias("y"), "pos")
    s = lag_sums(v, most, "y", "pos")
    head = s.where("lag = 0").select("series_id", F.col("n").alias("all"), F.col("yy").alias("total"))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    x = beside(s, head, ["series_id"])
    vy, vx, c = (F.col(q) - F.col(a) * F.col(b) / F.col("n") for q, a, b in (("yy", "y", "y"), ("xx", "x", "x"), ("xy", "x", "y")))
    r = F.when((F.col("n") > 0) & (F.least(vy, vx) > 1e-10 * F.col("total")), c / F.sqrt(vy * vx))
    flat = (F.col("all") < 3) | (F.col("total") <= 1e-20)
    top = F.least(F.lit(most), F.col("all") - 1)
    weak = (F.coalesce(F.abs(r), F.lit(0.0)) < z / F.sqrt("all")).cast("int")
    w = W.partitionBy("series_id").orderBy("lag").rowsBetween(1 - run, 0)
    x = x.select("series_id", "lag", flat.alias("flat"), top.alias("top"), weak.alias("weak")).where("lag between 1 and top or flat")
    streak = F.sum(F.when(F.col("lag") > 0, F.col("weak"))).over(w)
    found = x.withColumn("streak", streak).groupBy("series_id").agg(F.first("flat").alias("flat"), F.min(F.when(F.col("streak") == run, F.col("lag") - run + 1)).alias("depth"), F.first("top").alias("top"))
    depth = F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce("depth", "top")))
    return found.select("series_id", F.when(F.col("flat"), least).otherwise(depth).cast("long").alias("depth"))


def pacf(series: DataFrame, lags: int, of: str) -> DataFrame:
    """(series_id, lag, pacf) by Yule-Walker with biased autocovariances: sums by ``lag_sums``, the recursion over ``lags`` numbers for each series afterwards; null for a series that doesn't vary."""
    sums = lag_sums(series, lags, of).select("series_id", "lag", F.col("xy").alias("c"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.sort_values("lag")["c"].to_numpy(float)
        r, phi, out = c / c[0] if c[0] > 1e-20 else np.full(len(c), np.nan), np.zeros(0), []
        for k in range(1, len(r)):
            last = (r[k] - phi @ r[k - 1 : 0 : -1]) / (1 - phi @ r[1:k]) if k > 1 else r[1]
            phi = np.append(phi - last * phi[::-1], last)
            out.append((pdf["series_id"].iloc[0], k, float(last)))
        return pd.DataFrame(out, columns=["series_id", "lag", "pacf"])

    kind = series.schema["series_id"].dataType.simpleString()
    return sums.groupBy("series_id").applyInPandas(lambda pdf: solve(pdf), f"series_id {kind}, lag long, pacf double").withColumn("pacf", F.nanvl("pacf", F.lit(None).cast("double")))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif, flag): diagonal of the Gram matrix times that of its inverse, no intercept; columns that don't vary are flagged."""
    rows = df.na.drop(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = rows.agg(*[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    used = [c for c in columns if r[f"s_{c}"]]
    gram = pd.DataFrame(0.0, columns, columns)
    for i, (a, b) in enumerate(pairs):
        gram.loc[a, b] = gram.loc[b, a] = r[f"g{i}"] or 0.0
    inverse = np.linalg.pinv(gram.loc[used, used].to_numpy()) if used else np.zeros((0, 0))
    v = dict(zip(used, (np.diag(gram.loc[used, used]) * np.diag(inverse)).tolist(), strict=True))
    flag = lambda x: "constant" if x is None else "high" if x > 10 else "moderate" if x > 5 else "low"
    return df.sparkSession.createDataFrame([(c, v.get(c), flag(v.get(c))) for c in columns], "column string, vif double, flag string")


def welch(series: DataFrame, of: str, size: int = 2048, batch: int = 64) -> DataFrame:
    """(series_id, bin, frequency, period, power, segments): mean of Hann-windowed periodograms of half-overlapping segments of ``size`` slots without a gap. The period of frequency 0 is null.

    Segments begin at a series' first slot and every half segment after. A task takes ``batch`` of them at a time as one matrix, and the sums of
    their powers leave it; the half segment that the last of them needs from the next batch is copied to it.
    """
    half = size // 2
    first = series.groupBy("series_id").agg(F.min("slot").alias("first"))
    v = beside(series.where(F.col(of).isNotNull()).select("series_id", "slot", F.col(of).cast("double").alias("y")), first, ["series_id"])
    at = (F.col("slot") - F.col("first")).cast("long")
    chunk = F.floor(at / (batch * half))
    dealt = v.select("series_id", at.alias("at"), "y", F.explode(F.array_distinct(F.array(chunk, F.floor((at - half) / (batch * half))))).alias("chunk")).where("chunk >= 0")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full((batch + 1) * half, np.nan)
        x[pdf["at"].to_numpy() - pdf["chunk"].iloc[0] * batch * half] = pdf["y"].to_numpy()
        segments = np.lib.stride_tricks.sliding_window_view(x, size)[::half]
        segments = segments[~np.isnan(segments).any(axis=1)]
        p = np.abs(np.fft.rfft((segments - segments.mean(axis=1, keepdims=True)) * window)) ** 2 / (window * window).sum()
        p[:, 1:-1] *= 2
        bins = np.arange(half + 1) if len(p) else np.arange(0)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "bin": bins, "p": p.sum(axis=0)[: len(bins)], "n": len(p)})

    kind = series.schema["series_id"].dataType.simpleString()
    out = dealt.groupBy("series_id", "chunk").applyInPandas(lambda pdf: run(pdf), f"series_id {kind}, bin long, p double, n long").groupBy("series_id", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("segments"))
    return out.select("series_id", "bin", (F.col("bin") / F.lit(float(size))).alias("frequency"), F.when(F.col("bin") > 0, float(size) / F.col("bin")).alias("period"), (F.col("p") / F.col("segments")).alias("power"), "segments")


def day_correlations(minutes: DataFrame, of: str, places: int = 1440, block: int = 64) -> DataFrame:
    """(series_id, day_a, day_b, n, r): Pearson of each two days of a series over the places in the day that both have; days earlier first.

    ``minutes``: (series_id, date, place, value), places from 0. A day becomes one row, at most ``places`` values; ``block`` days at a time meet as two matrices,
    whose products give the moments of all their pairs, each over the places that both days have. No row is made for a pair and a place.
    r is null where either day doesn't vary there.
    """
    kind = minutes.schema["series_id"].dataType.simpleString()
    v = minutes.where(F.col(of).isNotNull()).select("series_id", "date", F.col("place").cast("int").alias("place"), F.col(of).cast("double").alias("v"))
    days = v.groupBy("series_id", "date").agg(F.collect_list(F.struct("place", "v")).alias("x"), F.avg("v").alias("m"))
    number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    days = days.select("series_id", "date", F.floor(number / block).alias("own"), F.col("x.place").alias("place"), F.transform("x.v", lambda v: v - F.col("m")).alias("v"))
    blocks = days.select("series_id", "own").distinct()
    pairs = blocks.withColumnRenamed("own", "one").join(blocks.withColumnRenamed("own", "other"), "series_id").where("one <= other")  # (days / block) ** 2
    sides = days.join(pairs.select(F.col("series_id").alias("sid"), "one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("of")), (F.col("series_id") == F.col("sid")) & (F.col("own") == F.col("of"))).drop("sid", "of")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, there = np.zeros((len(pdf), places)), np.zeros((len(pdf), places))
        for i, (place, v) in enumerate(zip(pdf["place"], pdf["v"], strict=True)):
            x[i, place], there[i, place] = v, 1.0
        a, b = ((pdf["own"] == pdf[side].iloc[0]).to_numpy() for side in ("one", "other"))
        n, sy, sx, syy, sxx, sxy = (p[a] @ q[b].T for p, q in ((there, there), (x, there), (there, x), (x * x, there), (there, x * x), (x, x)))
        few = np.maximum(n, 1)
        vy, vx, c = syy - sy * sy / few, sxx - sx * sx / few, sxy - sx * sy / few
        scale = (x * x).sum(axis=1)
        ok = (vy > 1e-12 * scale[a][:, None]) & (vx > 1e-12 * scale[b][None, :]) & (n > 1)
        r = np.where(ok, c / np.sqrt(np.where(ok, vy * vx, 1.0)), np.nan)
        dates = pdf["date"].to_numpy()
        i, j = np.nonzero(n > 0)
        da, db = dates[a][i], dates[b][j]
        keep = da < db
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "day_a": da[keep], "day_b": db[keep], "n": n[i, j][keep].astype(np.int64), "r": r[i, j][keep]})

    out = sides.groupBy("series_id", "one", "other").applyInPandas(lambda pdf: run(pdf), f"series_id {kind}, day_a date, day_b date, n long, r double")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def sketches(df: DataFrame, of: str, keys: list[str], distinct: str, size: int = 400, bits: int = 12) -> DataFrame:
    """(keys, n_rows, n, quantiles, distincts): for each key a sketch of the values of ``of`` (KLL) and one of the distinct values of ``distinct`` (HLL), in one pass.

    Sketches of any keys can be merged to that of their union, so what is kept for a day answers for every span and class. Ranks that a merged KLL sketch of ``size`` tells
    are off by about 2.3 / size ** 0.9 of all (99 %), counts of an HLL sketch by 1.04 / 2 ** (bits / 2) (one standard deviation).
    """
    x = df.withColumn("value_", F.col(of).cast("double"))
    return x.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("value_").alias("n"), F.kll_sketch_agg_double("value_", size).alias("quantiles"), F.hll_sketch_agg(F.when(F.col(distinct).isNotNull(), F.xxhash64(distinct)), bits).alias("distincts"))


def merged(parts: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """(by, n_rows, n, n_distinct, q): what the sketches of ``parts`` tell of their unions; the data isn't read again. q is null without values."""
    g = parts.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("k"), F.hll_sketch_estimate(F.hll_union_agg("distincts")).alias("n_distinct"))
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("k", F.array(*[F.lit(float(p)) for p in ps])))
    return g.select(*by, "n_rows", "n", "n_distinct", q.alias("q"))


#: Bits of a value by which ``quantiles`` tells values apart in each of its rounds.
DIGIT = 22


def beside(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Each row of ``left`` with its group's row of ``right``, null groups too; without groups ``right`` is a few rows, for all."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"{c}_of" for c in by})
    return left.join(right, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]), how).drop(*[f"{c}_of" for c in by])


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Bits of floating numbers as whole numbers in the same order, and back."""
    return bits ^ (bits >> 63 & 0x7FFFFFFFFFFFFFFF)


def ordered_keys(df: DataFrame, of: str) -> DataFrame:
    """``df`` with ``of`` as a 64-bit number that is ordered like it: NaN the largest, -0 as 0, null as null."""
    names = [c for c in df.columns if c != of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(of)
            x = v.to_numpy(zero_copy_only=False) + 0.0
            bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(_flipped(bits), mask=v.is_null().to_numpy(zero_copy_only=False))], [*names, of])

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(of, T.LongType())])
    return df.select(*names, of).mapInArrow(run, schema)


@F.arrow_udf(T.DoubleType())
def _value_of(keys: pa.Array) -> pa.Array:
    return pa.array(_flipped(keys.to_numpy(zero_copy_only=False)).view(np.float64))


def quantiles(df: DataFrame, of: str, ps: list[float], by: list[str] | None = None, digit: int = DIGIT) -> DataFrame:
    """(by, q): exact percentiles ``ps`` of each group, interpolated as ``percentile`` does; an array of nulls for a group without values.

    ``percentile`` holds all distinct values of a group in one task. Here values are selected by the bits of numbers that are ordered
    like them, ``digit`` bits a round from the highest down: a round counts the values of those prefixes that hold a wanted rank by
    their next bits, at most 2 ** digit counts for each, whatever the values are and wherever they crowd. The last round tells single values. ``df`` is run once,
    its values are kept.
    """
    by = by or []
    x = settled(ordered_keys(df.select(*by, F.col(of).cast("double").alias("k")), "k"))
    ends = x.groupBy(*by).agg(F.count("k").alias("all"))
    ranks_of = lambda places: F.array_distinct(F.flatten(F.transform(places, lambda k: F.array(F.floor(k), F.ceil(k)))))
    places = F.transform(F.array(*[F.lit(float(p)) for p in ps]), lambda p: p * (F.col("all") - 1))
    there = x.where("k is not null")
    shifts = list(range(64 - digit, 0, -digit)) + [0]
    counts = there.groupBy(*by, F.shiftright("k", shifts[0]).alias("prefix")).agg(F.count("*").alias("n"))
    counts = counts.withColumns({"all": F.sum("n").over(W.partitionBy(*by)), "upto": F.sum("n").over(W.partitionBy(*by).orderBy("prefix"))})
    counts = counts.withColumn("ranks", ranks_of(places))

    def wanted(counts: DataFrame) -> DataFrame:
        before = F.col("upto") - F.col("n")
        held = F.filter("ranks", lambda r: (r >= before) & (r < F.col("upto")))
        return counts.select(*by, "prefix", before.alias("before"), held.alias("ranks")).where(F.size("ranks") > 0)

    found = wanted(counts)
    for above, shift in zip(shifts, shifts[1:], strict=False):
        near = there.withColumn("prefix", F.shiftright("k", above))
        near = beside(near, found, [*by, "prefix"]) if by else near.join(F.broadcast(found), "prefix")  # 2 * len(ps) rows at most
        counts = near.groupBy(*by, "prefix", F.shiftright("k", shift).alias("next")).agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
        upto = F.col("before") + F.sum("n").over(W.partitionBy(*by, "prefix").orderBy("next"))
        found = wanted(counts.withColumn("upto", upto).drop("prefix", "before").withColumnRenamed("next", "prefix"))
    hit = found.select(*by, _value_of("prefix").alias("v"), F.explode("ranks").alias("rank"))
    values = hit.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("found"))  # 2 * len(ps) entries
    value = lambda r: F.try_element_at(F.col("found"), r)
    between = lambda k: F.when(value(F.floor(k)) == value(F.ceil(k)), value(F.floor(k))).otherwise((F.ceil(k) - k) * value(F.floor(k)) + (k - F.floor(k)) * value(F.ceil(k)))
    return beside(ends, values, by, "left").select(*by, F.transform(places, between).alias("q"))


def qq_normal(df: DataFrame, of: str, points: int = 99) -> DataFrame:
    """(p, observed, normal, slope, intercept, r2): percentiles against those of the normal distribution, with the fitted line."""
    ps = [i / (points + 1) for i in range(1, points + 1)]
    grid = quantiles(df, of, ps).select(F.posexplode("q").alias("i", "observed"))
    z = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in ps])
    x = grid.select(F.element_at(F.array(*map(F.lit, ps)), F.col("i") + 1).alias("p"), "observed", F.element_at(z, F.col("i") + 1).alias("normal"))
    fit = x.agg(F.regr_slope("observed", "normal").alias("slope"), F.regr_intercept("observed", "normal").alias("intercept"), F.regr_r2("observed", "normal").alias("r2"))
    return x.crossJoin(F.broadcast(fit))  # one row


def optimal_bins(df: DataFrame, of: str, by: list[str] | None = None, least: int = 10, most: int = 300) -> DataFrame:
    """Bins by three rules, within [``least``, ``most``]: fd, sturges, sqrt; ``least`` for an empty or constant column."""
    by = by or []
    x = beside(df.groupBy(*by).agg(F.count(of).alias("n"), F.min(of).alias("lo"), F.max(of).alias("hi")), quantiles(df, of, [0.25, 0.75], by), by)
    iqr, root = F.col("q")[1] - F.col("q")[0], F.ceil(F.sqrt("n"))
    rules = {"fd": F.when(iqr > 0, F.ceil((F.col("hi") - F.col("lo")) / (2 * iqr * F.pow("n", F.lit(-1 / 3))))).otherwise(root), "sturges": F.ceil(F.log2("n")) + 1, "sqrt": root}
    ok = (F.col("n") > 0) & (F.col("hi") > F.col("lo"))
    return x.select(*by, *[F.when(ok, F.greatest(F.lit(least), F.least(F.lit(most), c))).otherwise(least).cast("long").alias(k) for k, c in rules.items()])


def outlier_bounds(df: DataFrame, of: str, by: list[str] | None = None) -> DataFrame:
    """(method, lower, upper) by iqr, zscore (3 population deviations) and mad (3 unscaled median deviations); null bounds where there are no values."""
    by = by or []
    q = quantiles(df, of, [0.25, 0.5, 0.75], by)
    a = beside(df.groupBy(*by).agg(F.avg(of).alias("m"), F.stddev_pop(of).alias("s")), q, by)
    near = beside(df.select(*by, of), q.select(*by, F.col("q")[1].alias("med")), by)
    d = quantiles(near.select(*by, F.abs(F.col(of) - F.col("med")).alias("off")), "off", [0.5], by).select(*by, F.col("q")[0].alias("mad"))
    x = beside(a, d, by)
    q, iqr = F.col("q"), F.col("q")[2] - F.col("q")[0]
    pairs = {"iqr": (q[0] - 1.5 * iqr, q[2] + 1.5 * iqr), "zscore": (F.col("m") - 3 * F.col("s"), F.col("m") + 3 * F.col("s")), "mad": (q[1] - 3 * F.col("mad"), q[1] + 3 * F.col("mad"))}
    return x.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("method"), lo.alias("lower"), hi.alias("upper")) for k, (lo, hi) in pairs.items()])).alias("b")).select(*by, "b.*")


def histogram(df: DataFrame, of: str, bins: int) -> DataFrame:
    """(bin, n): equal widths between the extremes, the last bin closed on the right; empty bins are absent."""
    ends = df.agg(F.min(of).alias("lo"), F.max(of).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(of) - F.col("lo")) / width), F.lit(bins - 1)).cast("long")
    return df.where(F.col(of).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats by equal-frequency bins; nulls take the median."""
    cuts = [i / bins for i in range(1, bins)]
    columns = list(dict.fromkeys([*features, target]))
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    q = quantiles(values, "v", cuts, ["column"]).groupBy().pivot("column", columns).agg(F.first("q"))
    q = F.broadcast(q.select(*[F.col(c).alias(f"q_{c}") for c in columns]))  # one row
    x = df.crossJoin(q)
    place = lambda c: F.size(F.filter(F.col(f"q_{c}"), lambda v: v < F.coalesce(F.col(c), F.col(f"q_{c}")[bins // 2 - 1])))
    long = x.select(place(target).alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("b")) for c in features])).alias("f")).select("f.*", "t")
    joint = long.groupBy("feature", "b", "t").agg(F.count("*").alias("n"))
    w = lambda *c: W.partitionBy("feature", *c)
    joint = joint.withColumns({"nb": F.sum("n").over(w("b")), "nt": F.sum("n").over(w("t")), "all": F.sum("n").over(w())})
    return joint.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nb") * F.col("nt")))).alias("mi"))


def complete_days(daily: DataFrame, of: str) -> DataFrame:
    """(series_id, day, value): every day from a series' first to its last, missing values filled by interpolation; day counts from 1970."""
    v = daily.select("series_id", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("slot"), F.col(of).alias("v"))
    ends = v.groupBy("series_id").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    every = ends.select("series_id", F.explode(F.sequence("a", "b")).alias("slot")).join(v, ["series_id", "slot"], "left")
    return interpolate(every, "v").select("series_id", F.col("slot").alias("day"), F.col("filled").alias("value"))


def decompose(daily: DataFrame, of: str, period: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(series_id, date, trend, seasonal, residual) of each calendar day: centred moving mean, mean deviation by day number modulo ``period``, rest.

    The mean of an even period takes one day more, the two at its ends by half.

    Days without a row are completed by interpolation first, so that phases and trend follow the calendar. Trends are made in chunks of days.
    """
    x = complete_days(daily, of)
    half = period // 2
    own = F.floor(F.col("day") / chunk)
    x = x.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.floor((F.col("day") - half) / chunk), F.floor((F.col("day") + half) / chunk))))
    f = W.partitionBy("series_id", "chunk").orderBy("day").rowsBetween(-half, half)
    total, w = F.sum("value").over(f), W.partitionBy("series_id", "chunk").orderBy("day")
    if period % 2 == 0:
        total = total - (F.lag("value", half).over(w) + F.lead("value", half).over(w)) / 2
    x = x.withColumn("trend", F.when(F.count("value").over(f) == 2 * half + 1, total / period)).where("own = chunk")
    x = x.withColumn("k", F.pmod("day", F.lit(period))).withColumn("off", F.col("value") - F.col("trend"))
    raw = x.groupBy("series_id", "k").agg(F.avg("off").alias("raw"))
    level = raw.groupBy("series_id").agg(F.avg("raw").alias("level"))
    seasonal = raw.join(level, "series_id").select("series_id", "k", (F.col("raw") - F.col("level")).alias("seasonal"))
    x = x.join(seasonal, ["series_id", "k"]).withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
    return x.select("series_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date"), "trend", "seasonal", "residual")


def box(df: DataFrame, of: str, by: list[str]) -> DataFrame:
    """Quartiles of groups, and whiskers: the extreme values within 1.5 times the interquartile range."""
    q = quantiles(df.where(F.col(of).isNotNull()), of, [0.25, 0.5, 0.75], by)
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    x = beside(df, q, by)
    inside = F.when(F.col(of).between(F.col("q")[0] - reach, F.col("q")[2] + reach), F.col(of))
    return x.groupBy(*by).agg(F.first("q").alias("q"), F.min(inside).alias("low"), F.max(inside).alias("high")).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high")


def category_codes(df: DataFrame, of: str) -> DataFrame:
    """``df`` with code: the number from 0 of a row's category in sorted order, -1 for null; one row for each category is numbered and joined."""
    kinds = ranked(df.where(F.col(of).isNotNull()).select(F.col(of).alias("kind")).distinct(), ["kind"], "code")
    kinds = kinds.withColumn("code", (F.col("code") - 1).cast("int"))
    x = df.drop("code").join(kinds, F.col(of) == F.col("kind"), "left").withColumn("code", F.coalesce("code", F.lit(-1)))
    return x.drop("kind")


def going_back(rows: DataFrame, of: str) -> DataFrame:
    """(series_id, n_back, slot, before, at): of each series in which ``of`` falls from a row to the next in the order of slot, how often, and the first such row with both values."""
    x = neighbour(rows, of).where(F.col(of) < F.col("before"))
    return x.groupBy("series_id").agg(F.count("*").alias("n_back"), F.min(F.struct("slot", "before", F.col(of).alias("at"))).alias("first")).select("series_id", "n_back", "first.*")


def described(df: DataFrame, of: str, ps: list[float]) -> DataFrame:
    """One row: n, mean, std, low, q (the percentiles ``ps``), high of a column's values."""
    g = df.agg(F.count(of).alias("n"), F.avg(of).alias("mean"), F.stddev_samp(of).alias("std"), F.min(of).alias("low"), F.max(of).alias("high"))
    return beside(g, quantiles(df, of, ps), [])


def filliben(n: Column, i: Column) -> Column:
    """The median of the ``i``-th of ``n`` ordered uniform values."""
    last = F.pow(F.lit(0.5), 1 / n)
    return F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))


# A rational approximation of the inverse normal distribution, in its middle and in its tails.
MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_value(p: Column) -> Column:
    """Inverse of the standard normal distribution, to about nine digits."""
    q, low = p - 0.5, 0.02425
    r = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = horner(TAIL[0], r) / horner(TAIL[1], r)
    return F.when(p < low, tail).when(p > 1 - low, -tail).otherwise(q * horner(MIDDLE[0], q * q) / horner(MIDDLE[1], q * q))


def qq_sample(df: DataFrame, of: str, order: list[str]) -> DataFrame:
    """(i, observed, normal, slope, intercept, r2): the values of a sample in order against the medians of normal order statistics, with the fitted line; nulls are left out. ``order`` tells equal values apart."""
    x = ranked(df.where(F.col(of).isNotNull()).select(*order, F.col(of).alias("observed")), ["observed", *order], "i")
    n = beside(x, x.agg(F.count("*").alias("n")), [])
    z = n.select("i", "observed", normal_value(filliben(F.col("n").cast("double"), F.col("i").cast("double"))).alias("normal"))
    fit = z.agg(F.regr_slope("observed", "normal").alias("slope"), F.regr_intercept("observed", "normal").alias("intercept"), F.regr_r2("observed", "normal").alias("r2"))
    return z.crossJoin(F.broadcast(fit))  # one row
