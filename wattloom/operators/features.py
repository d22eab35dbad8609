"""Resampling to a dense grid, and features over it.

A row of the grid is a slot: the number of a bin since 1970. Lags and frames count slots, so gaps
must be rows. One long series would be one window partition; ``chunked`` deals it in chunks of slots, each with
the history its first rows look at, so that a series of any length spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar
from ..plans.settings import DAY_CLASSES, TARGET, Settings

#: Slots in a chunk at least; more than the history keeps copies below half of the rows.
CHUNK = 4320


#: Loads are added up as whole numbers, apart for each OCTAVES powers of two: HIGH bits before their point and LOW behind it keep every bit of a double.
OCTAVES, HIGH, LOW = 8, 24, 30


def scaled(x: Column, power: Column) -> Column:
    """``x`` times 2 to the ``power``, in two steps, as the power itself may be beyond what a double holds."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def resample(bronze: DataFrame, step: int) -> DataFrame:
    """(series_id, slot, avg_load, day_class): means of non-null loads, the first class in time; bins without rows are absent.

    Sums are of whole numbers, so a mean is the same to its last bit in whatever order rows come; they hold 2 billion rows of a bin.
    """
    ts, x = F.col("timestamp"), F.col("load").cast("double")
    finite = F.abs(x) < float("inf")  # false for NaN
    scale = F.floor(F.log2(F.when(finite, F.abs(x))) / OCTAVES)
    rows = bronze.select("series_id", calendar.slot(ts, step).alias("slot"), F.coalesce(scale, F.lit(0)).alias("scale"), x.alias("x"), finite.alias("finite"), ts.alias("at"), "day_class")
    rows = rows.withColumn("x", F.when(F.col("finite"), scaled(F.col("x"), HIGH - OCTAVES * F.col("scale")))).withColumn("high", F.floor("x"))
    by_scale = rows.groupBy("series_id", "slot", "scale").agg(
        F.count("high").alias("n"),
        F.count_if(~F.col("finite")).alias("n_bad"),
        F.sum("high").alias("high"),
        F.sum(F.floor((F.col("x") - F.col("high")) * 2.0**LOW)).alias("low"),
        F.min(F.when(F.col("day_class").isNotNull(), F.struct("at", F.col("day_class").alias("class")))).alias("first"),
    )
    sums = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("scale", "high", "low"))))
    total = F.aggregate(sums, F.lit(0.0), lambda t, s: t + scaled(s["high"] + s["low"] / 2.0**LOW, OCTAVES * s["scale"] - HIGH))
    mean = F.when(F.sum("n_bad") == 0, total / F.nullif(F.sum("n"), F.lit(0)))  # infinities, also those that arise here, are missing
    g = by_scale.groupBy("series_id", "slot")
    return g.agg(F.when(F.abs(mean) < float("inf"), mean).alias(TARGET), F.min("first")["class"].alias("day_class"))


def states(bronze: DataFrame, step: int, allowed: tuple[str, ...] = tuple(DAY_CLASSES)) -> DataFrame:
    """(series_id, slot, n_rows, n, total, first, n_bad, bad) of bins of ``step`` seconds: sums that can be added up to those of any coarser bins.

    n and total: the loads that are there; first: the first class and its time; n_bad: rows whose class is unknown or missing, bad: the
    least unknown one.
    """
    ts, known = F.col("timestamp"), F.coalesce(F.col("day_class").isin(*allowed), F.lit(False))
    g = bronze.groupBy("series_id", calendar.slot(ts, step).alias("slot"))
    return g.agg(
        F.count("*").alias("n_rows"),
        F.count("load").alias("n"),
        F.sum("load").alias("total"),
        F.min(F.when(F.col("day_class").isNotNull(), F.struct(ts.alias("at"), F.col("day_class").alias("class")))).alias("first"),
        F.count_if(~known).alias("n_bad"),
        F.min(F.when(~known, F.col("day_class"))).alias("bad"),
    )


def folded(parts: DataFrame, fine: int, steps: list[int]) -> DataFrame:
    """(series_id, step, slot, avg_load, day_class): ``resample`` for each of ``steps``, from the ``states`` of bins of ``fine`` seconds.

    ``fine`` must divide every step. All resolutions are added up in one pass over the states; the bronze layer isn't read again.
    """
    if wrong := [s for s in steps if s % fine]:
        raise ValueError(f"{wrong} are no multiples of {fine}")
    x = parts.withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    g = x.groupBy("series_id", "step", F.floor(F.col("slot") * fine / F.col("step")).cast("long").alias("slot"))
    mean = F.sum("total") / F.nullif(F.sum("n"), F.lit(0))
    return g.agg(F.when(F.abs(mean) < float("inf"), mean).alias(TARGET), F.min("first")["class"].alias("day_class"))


def grid(binned: DataFrame, step: int | None = None, classes: bool = True) -> DataFrame:
    """Every slot from a series' first bin to its last; missing ones have a null load and, with ``classes``, the class that the series has on their date (null: none).

    Without ``step`` the bins of several resolutions lie in ``binned``, told apart by its column step, and each has its own grid.
    """
    keys, size = (["series_id"], F.lit(step)) if step else (["series_id", "step"], F.col("step"))
    ends = binned.groupBy(*keys).agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    # one row for each chunk first, so that a long series is unrolled by many tasks
    parts = ends.select(*keys, "a", "b", F.explode(F.sequence(F.floor(F.col("a") / CHUNK), F.floor(F.col("b") / CHUNK))).alias("c")).repartition(*keys, "c")
    slots = parts.select(*keys, F.explode(F.sequence(F.greatest("a", F.col("c") * CHUNK), F.least("b", F.col("c") * CHUNK + CHUNK - 1))).alias("slot"))
    out = slots.join(binned, [*keys, "slot"], "left").withColumn("timestamp", calendar.start(F.col("slot"), size))
    if not classes:
        return out
    date = F.floor(F.col("slot") * size / 86400)
    days = binned.where("day_class is not null").groupBy(*keys, date.alias("day")).agg(F.min_by("day_class", "slot").alias("of_day"))
    return out.withColumn("day", date).join(days, [*keys, "day"], "left").withColumn("day_class", F.coalesce("day_class", "of_day")).drop("day", "of_day")


def chunked(df: DataFrame, history: int, make: Callable[[DataFrame, WindowSpec], DataFrame], chunk: int = CHUNK) -> DataFrame:
    """``make(df, window)`` on chunks of slots with ``history`` slots before each; same rows as over the whole series.

    Rows that a later chunk needs are copied to it; the copies are dropped at the end.
    """
    own = F.floor(F.col("slot") / chunk)
    upto = F.floor((F.col("slot") + history) / chunk)
    dealt = df.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(own, upto)))
    w = W.partitionBy("series_id", "chunk").orderBy("slot")
    return make(dealt, w).where("own = chunk").drop("own", "chunk")


def full(value: Column, n: int, frame: WindowSpec, of: str = TARGET) -> Column:
    """``value`` where all ``n`` rows of the frame are there and not null."""
    return F.when(F.count(of).over(frame) == n, value)


def lag_columns(w: WindowSpec, lags: tuple[int, ...], of: str = TARGET) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(of, k).over(w) for k in lags}


def rolling_columns(w: WindowSpec, sizes: tuple[int, ...], of: str = TARGET, exclude_current: bool = False) -> dict[str, Column]:
    """Mean, sample standard deviation, maximum and minimum of ``n`` rows up to the current one (or the one before)."""
    out, last = {}, -1 if exclude_current else 0
    for n in sizes:
        f = w.rowsBetween(last - n + 1, last)
        for name, agg in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min)):
            out[f"rolling_{name}_{n}"] = full(agg(of).over(f), n, f, of)
    return out


def prefix_sums(df: DataFrame, w: WindowSpec, of: str = TARGET) -> DataFrame:
    """Running count and sums of centred values and squares, restarting with each window partition: long frames become differences of two rows."""
    run = w.rowsBetween(W.unboundedPreceding, 0)
    centred = F.coalesce(F.col(of) - F.avg(of).over(W.partitionBy("series_id", "chunk")), F.lit(0.0))
    df = df.withColumn("x", centred).withColumn("base", F.avg(of).over(W.partitionBy("series_id", "chunk")))
    return df.withColumns({"cn": F.count(of).over(run), "cs": F.sum("x").over(run), "cq": F.sum(F.col("x") * F.col("x")).over(run)})


def extreme_columns(w: WindowSpec, n: int, of: str = TARGET) -> dict[str, Column]:
    """Rolling maximum and minimum of ``n`` rows from running ones within blocks of ``n`` slots, upwards and downwards: a frame covers the end of one block and the beginning of the next."""
    block = W.partitionBy("series_id", "chunk", F.floor(F.col("slot") / n))
    up, down = block.orderBy("slot").rowsBetween(W.unboundedPreceding, 0), block.orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, 0)
    ok = F.count(of).over(w.rowsBetween(1 - n, 0)) == n if n < LONG else F.col("cn") - F.coalesce(F.lag("cn", n).over(w), F.lit(0)) == n
    return {f"rolling_{name}_{n}": (ok, agg(of).over(up), agg(of).over(down), pick) for name, agg, pick in (("max", F.max, F.greatest), ("min", F.min, F.least))}


def prefix_columns(w: WindowSpec, n: int) -> dict[str, Column]:
    """Rolling mean and standard deviation of ``n`` rows by ``prefix_sums``."""
    d = {c: F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0)) for c in ("cn", "cs", "cq")}
    ok = d["cn"] == n
    var = (d["cq"] - d["cs"] * d["cs"] / n) / (n - 1)
    return {f"rolling_mean_{n}": F.when(ok, F.col("base") + d["cs"] / n), f"rolling_std_{n}": F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0))))}


def delta_columns(lags: tuple[int, ...]) -> dict[str, Column]:
    return {f"delta_{k}": F.col(f"lag_{k}") - F.col("lag_1") for k in lags if k != 1}


def slope_columns(w: WindowSpec, sizes: tuple[int, ...], of: str = TARGET, position: str = "pos") -> dict[str, Column]:
    """Least-squares slope of the ``n`` rows before the current one. ``position`` counts slots from near, which keeps sums of squares small."""
    out = {}
    for n in sizes:
        f = w.rowsBetween(-n, -1)
        out[f"slope_{n}"] = full(F.regr_slope(F.col(of), F.col(position)).over(f), n, f, of)
    return out


#: Frames at least this long take their means and deviations from prefix sums.
LONG = 240


def silver(bronze: DataFrame, step: int, settings: Settings | None = None, chunk: int = CHUNK) -> DataFrame:
    """Bronze to silver at a resolution of ``step`` seconds: series_id, slot and the columns of the schema."""
    return silver_of(grid(resample(bronze, step), step), settings, chunk)


def silver_of(dense: DataFrame, settings: Settings | None = None, chunk: int = CHUNK) -> DataFrame:
    """The features of a dense grid: series_id, slot and the columns of the schema."""
    s = settings or Settings()

    def make(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = prefix_sums(df, w).withColumn("pos", (F.col("slot") - F.col("chunk") * chunk).cast("double"))
        long = [n for n in s.rolling if n >= LONG]
        cols = lag_columns(w, s.lags) | rolling_columns(w, tuple(n for n in s.rolling if n < LONG)) | slope_columns(w, s.slopes)
        for n in long:
            cols |= prefix_columns(w, n)
            ends = extreme_columns(w, n)
            df = df.withColumns({f"{k}_{side}": c for k, (_, up, down, _) in ends.items() for side, c in (("up", up), ("down", down))})
            cols |= {k: F.when(ok, pick(F.col(f"{k}_up"), F.lag(f"{k}_down", n - 1).over(w))) for k, (ok, _, _, pick) in ends.items()}
        return df.withColumns(cols)

    out = chunked(dense, s.history(), make, max(chunk, s.history()))
    out = out.withColumns(calendar.calendar(F.col("timestamp"), F.col("day_class"))).withColumns(delta_columns(s.lags))
    return out.select("series_id", "slot", *s.columns())


def gold(silver_: DataFrame, settings: Settings | None = None) -> DataFrame:
    return silver_.na.drop(subset=(settings or Settings()).required())


def runs(df: DataFrame, flag: Column, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of consecutive slots where ``flag`` holds: (series_id, first_slot, last_slot, length).

    Runs are found in each chunk; only those that touch a chunk's edge, two to a chunk at most, are then joined up.
    """
    hit = df.where(F.coalesce(flag, F.lit(False))).select("series_id", "slot", F.floor(F.col("slot") / chunk).alias("chunk"))
    w = W.partitionBy("series_id", "chunk").orderBy("slot")
    part = hit.withColumn("island", F.col("slot") - F.row_number().over(w)).groupBy("series_id", "chunk", "island").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    edge = (F.col("a") == F.col("chunk") * chunk) | (F.col("b") == F.col("chunk") * chunk + chunk - 1)
    inner = part.where(~edge).select("series_id", F.col("a").alias("first_slot"), F.col("b").alias("last_slot"))
    v = W.partitionBy("series_id").orderBy("a")
    new = F.coalesce((F.lag("b").over(v) + 1 < F.col("a")).cast("int"), F.lit(1))
    outer = part.where(edge).withColumn("new", new).withColumn("run", F.sum("new").over(v.rowsBetween(W.unboundedPreceding, 0)))
    outer = outer.groupBy("series_id", "run").agg(F.min("a").alias("first_slot"), F.max("b").alias("last_slot")).select("series_id", "first_slot", "last_slot")
    return inner.union(outer).withColumn("length", F.col("last_slot") - F.col("first_slot") + 1)


def interpolate(df: DataFrame, of: str = TARGET, chunk: int = CHUNK) -> DataFrame:
    """``df`` with a column filled: linear by slot inside gaps, the nearest value at the ends.

    Each chunk of slots fills its own gaps; what it needs from before or after comes from one row for each chunk.
    """
    at, key = F.when(F.col(of).isNotNull(), F.col("slot")), ["series_id", "chunk"]
    x = df.withColumn("chunk", F.floor(F.col("slot") / chunk))
    ends = x.groupBy(*key).agg(F.min_by(of, at).alias("va"), F.min(at).alias("sa"), F.max_by(of, at).alias("vb"), F.max(at).alias("sb"))
    v = W.partitionBy("series_id")
    before, after = v.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1), v.orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
    near = ends.select(*key, *[F.last(c, True).over(w).alias(n) for c, w, n in (("vb", before, "pv"), ("sb", before, "ps"), ("va", after, "nv"), ("sa", after, "ns"))])
    w = W.partitionBy(*key)
    back, ahead = w.orderBy("slot").rowsBetween(W.unboundedPreceding, 0), w.orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, 0)
    x = x.join(near, key)
    x = x.withColumns({n: F.coalesce(F.last(c, True).over(f), F.col(else_)) for n, c, f, else_ in (("v0", F.col(of), back, "pv"), ("s0", at, back, "ps"), ("v1", F.col(of), ahead, "nv"), ("s1", at, ahead, "ns"))})
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("slot") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    return x.withColumn("filled", F.coalesce(F.col(of), line, "v0", "v1")).select(*df.columns, "filled")


def with_days(df: DataFrame) -> DataFrame:
    """``df`` with day_order: the rank of its date among its series' dates, gaps not counting. The dates are few and joined back."""
    days = df.select("series_id", F.col("timestamp").cast("date").alias("date")).distinct()
    order = days.withColumn("day_order", F.row_number().over(W.partitionBy("series_id").orderBy("date")))
    return df.withColumn("date", F.col("timestamp").cast("date")).join(order, ["series_id", "date"])


def split(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Rows of days inside a split's range, with split."""
    name = F.lit(None).cast("string")
    for k, (a, b) in (settings or Settings()).splits.items():
        name = F.when(F.col("day_order").between(a, b), k).otherwise(name)
    return with_days(df).withColumn("split", name).where("split is not null")


def model_dataset(gold_: DataFrame, feature_set: str, settings: Settings | None = None) -> DataFrame:
    """Metadata, target and a feature set, by split; rows without target go."""
    s = settings or Settings()
    return split(gold_, s).select("split", *model_columns(gold_, feature_set, s)).na.drop(subset=[TARGET])


def model_columns(gold_: DataFrame, feature_set: str, s: Settings) -> list[str]:
    """Metadata, target and the columns of a feature set; ValueError where the set is unknown, or holds the target or what ``gold_`` lacks."""
    if feature_set not in s.sets():
        raise ValueError(f"unknown feature set {feature_set!r}")
    columns = list(dict.fromkeys(["timestamp", "day_class", TARGET, *s.sets()[feature_set]]))
    missing = [c for c in columns if c not in gold_.columns]
    if missing or TARGET in s.sets()[feature_set]:
        raise ValueError(f"feature set {feature_set!r} holds the target or columns that are missing: {missing}")
    return columns

