"""Diagnostic queries: tables of quality, distribution, correlation and structure."""

from __future__ import annotations

from math import gcd
from statistics import NormalDist

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import features as fx
from ..operators import stats
from ..sources import bronze as src
from .queries import CAL, DAILY, GC, QUARTER, STEP, B, G, bronze, daily, dense, grid_sql, n, query, r6, rounded, silver
from .settings import DEFAULTS, RESOLUTIONS, TARGET, Settings


@query(B + " SELECT date, day_class, count(*) AS n_rows, count(*) - count(load) AS n_null, CAST(sum(CASE WHEN load = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, round(avg(load), 6) AS mean, round(stddev_samp(load), 6) AS std, round(stddev_pop(load), 6) AS std_pop, round(100.0 * (count(*) - count(load)) / count(*), 6) AS null_pct FROM bronze GROUP BY date, day_class")
def day_breakdown(spark, d):
    g = bronze(spark, d).groupBy("date", "day_class")
    return g.agg(F.count("*").alias("n_rows"), (F.count("*") - F.count("load")).alias("n_null"), n(F.count_if(F.col("load") == 0), "n_zero"), r6(F.avg("load")).alias("mean"), r6(F.stddev_samp("load")).alias("std"), r6(F.stddev_pop("load")).alias("std_pop"), r6(100.0 * (F.count("*") - F.count("load")) / F.count("*")).alias("null_pct"))


@query(B + " SELECT date, " + ", ".join(f"coalesce(round(avg(CASE WHEN hour = {h} THEN CASE WHEN load IS NULL THEN 1.0 ELSE 0.0 END END), 6), 0.0) AS h{h}" for h in range(24)) + " FROM bronze GROUP BY date")
def nan_heatmap(spark, d):
    p = bronze(spark, d).withColumn("hour", F.hour("timestamp")).groupBy("date").pivot("hour", list(range(24))).agg(r6(F.avg(F.col("load").isNull().cast("double"))))
    return p.select("date", *[F.coalesce(F.col(f"`{h}`"), F.lit(0.0)).alias(f"h{h}") for h in range(24)])


@query(DAILY + " SELECT date, max_load, round(mean_load, 6) AS mean_load, round(energy, 2) AS energy FROM daily")
def daily_energy(spark, d):
    return daily(spark, d).select("date", "max_load", r6("mean_load").alias("mean_load"), F.round("energy", 2).alias("energy"))


PCTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
DESCRIBE = "count(load) AS n, round(avg(load), 6) AS mean, round(stddev_samp(load), 6) AS std, min(load) AS low, max(load) AS high, " + ", ".join(f"round(quantile_cont(load, {p}), 6) AS p{int(p * 100)}" for p in PCTS)


@query(B + f" SELECT 'all' AS day_class, {DESCRIBE} FROM bronze UNION ALL SELECT day_class, {DESCRIBE} FROM bronze GROUP BY day_class")
def describe_by_class(spark, d):
    g = bronze(spark, d).rollup("day_class").agg(F.count("load").alias("n"), r6(F.avg("load")).alias("mean"), r6(F.stddev_samp("load")).alias("std"), F.min("load").alias("low"), F.max("load").alias("high"))
    b = bronze(spark, d).select("load", F.explode(F.array("day_class", F.lit(None))).alias("day_class"))  # each value for its class and for all
    g = stats.beside(g, stats.quantiles(b, "load", list(PCTS), ["day_class"]), ["day_class"])
    return g.select(F.coalesce("day_class", F.lit("all")).alias("day_class"), "n", "mean", "std", "low", "high", *[r6(F.col("q")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(PCTS)])


@query(B + " SELECT " + ", ".join(f"round(quantile_cont(load, {p}), 6) AS p{int(p * 100)}" for p in PCTS) + " FROM bronze")
def load_quantiles(spark, d):
    q = stats.quantiles(bronze(spark, d), "load", list(PCTS))
    return q.select(*[r6(F.col("q")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(PCTS)])


TRANSITIONS = DAILY + ", t AS (SELECT before, day_class AS after FROM (SELECT date, day_class, lag(day_class) OVER (ORDER BY date) AS before FROM daily) x WHERE before IS NOT NULL)"


@query(TRANSITIONS + " SELECT before, " + ", ".join(f"round(sum(CASE WHEN after = '{c}' THEN 1.0 ELSE 0.0 END) / count(*), 6) AS to_{c}" for c in ("full", "half", "none")) + " FROM t GROUP BY before")
def transition_matrix(spark, d):
    days = bronze(spark, d).select("series_id", "date", "day_class").dropDuplicates()
    t = days.withColumn("before", F.lag("day_class").over(W.partitionBy("series_id").orderBy("date"))).where("before is not null")
    return t.groupBy("before").agg(*[r6(F.avg((F.col("day_class") == c).cast("double"))).alias(f"to_{c}") for c in ("full", "half", "none")])


@query(B + " SELECT bin, count(*) AS n FROM (SELECT CAST(least(floor((load - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin FROM bronze, (SELECT min(load) AS lo, max(load) AS hi FROM bronze) e WHERE load IS NOT NULL) x GROUP BY bin")
def load_histogram(spark, d):
    return stats.histogram(bronze(spark, d), "load", 50)


CORR = [c for c in Settings().columns() if c not in ("timestamp", "day_class")]  # every number of the silver table
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]
CORR_SQL = "c AS (SELECT " + ", ".join(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS "{a}|{b}"' for a, b in PAIRS) + " FROM silver), m AS (SELECT split_part(k, '|', 1) AS a, split_part(k, '|', 2) AS b, round(v, 3) AS r FROM (UNPIVOT c ON COLUMNS(*) INTO NAME k VALUE v) x WHERE v IS NOT NULL AND NOT isnan(v))"


def correlations(spark, d):
    """Pearson of all pairs of numeric columns that vary."""
    return stats.corr_matrix(rounded(silver(spark, d)), CORR).where("r is not null").withColumn("r", F.round("r", 3))


@query(QUARTER + ", " + CORR_SQL + " SELECT * FROM m")
def corr_matrix(spark, d):
    return correlations(spark, d)


@query(QUARTER + ", " + CORR_SQL + " SELECT a, b, r FROM m WHERE abs(r) >= 0.95 ORDER BY abs(r) DESC, a, b LIMIT 20")
def high_corr_pairs(spark, d):
    return correlations(spark, d).where("abs(r) >= 0.95").orderBy(F.abs("r").desc(), "a", "b").limit(20)


@query(QUARTER + ", " + CORR_SQL + " SELECT b AS feature, abs(r) AS r, row_number() OVER (ORDER BY abs(r) DESC, b) AS rank FROM m WHERE a = 'avg_load' ORDER BY rank LIMIT 20")
def target_corr_rank(spark, d):
    """The 20 features that go best with the target."""
    x = correlations(spark, d).where("a = 'avg_load'").select(F.col("b").alias("feature"), F.abs("r").alias("r"))
    return x.withColumn("rank", n(F.row_number().over(W.orderBy(F.desc("r"), "feature")), "rank")).where("rank <= 20")  # one row for each feature


@query(B + ", p AS (SELECT date, hour * 60 + minute AS m, avg(load) AS v FROM bronze GROUP BY 1, 2 HAVING avg(load) IS NOT NULL) SELECT x.date AS day_a, y.date AS day_b, count(*) AS n, round(corr(x.v, y.v), 6) AS r FROM p x JOIN p y ON x.m = y.m AND x.date < y.date GROUP BY 1, 2 HAVING count(*) > 2")
def cross_day_corr(spark, d):
    """Each two days by the minutes that both have."""
    m = F.hour("timestamp") * 60 + F.minute("timestamp")
    p = bronze(spark, d).groupBy("series_id", "date", m.alias("place")).agg(F.avg("load").alias("v"))
    return stats.day_correlations(p, "v").where("n > 2").select("day_a", "day_b", "n", r6("r").alias("r"))


SKETCHED = (0.05, 0.25, 0.5, 0.75, 0.95)
#: How far a sketched rank, and a sketched count in parts of itself, may lie from the exact one.
RANK_ERROR, COUNT_ERROR = 0.02, 0.06


def day_sketches(spark, d):
    return stats.sketches(bronze(spark, d), "load", ["series_id", "date", "day_class"], "timestamp")


@query(B + f" SELECT c AS day_class, p, count(load) AS n, true AS within FROM (SELECT day_class AS c, load FROM bronze UNION ALL SELECT 'all', load FROM bronze) x, (SELECT unnest({list(SKETCHED)}) AS p) y GROUP BY 1, 2".replace("unnest([", "unnest(CAST([").replace("]) AS p", "] AS DOUBLE[])) AS p"))
def sketched_quantiles(spark, d):
    """Percentiles of each class and of all from one sketch for each day; within: the share of loads up to the value told is the wanted one, to RANK_ERROR."""
    parts = src.settled(day_sketches(spark, d).withColumn("day_class", F.explode(F.array("day_class", F.lit("all")))))
    told = stats.merged(parts, ["day_class"], list(SKETCHED)).select("day_class", "n", F.posexplode("q").alias("i", "v"))
    wanted = F.element_at(F.array(*map(F.lit, SKETCHED)), F.col("i") + 1)
    # the exact ranks of the values told, from one more read
    x = bronze(spark, d).where("load is not null").select("load", F.explode(F.array("day_class", F.lit("all"))).alias("day_class"))
    ranks = x.join(F.broadcast(told), "day_class").groupBy("day_class", wanted.alias("p"), "n").agg(F.avg((F.col("load") < F.col("v")).cast("double")).alias("below"), F.avg((F.col("load") <= F.col("v")).cast("double")).alias("upto"))  # four classes
    return ranks.select("day_class", "p", "n", ((F.col("below") <= F.col("p") + RANK_ERROR) & (F.col("upto") >= F.col("p") - RANK_ERROR)).alias("within"))


@query(B + " SELECT day_class, count(*) AS n_rows, count(DISTINCT timestamp) AS n_exact, true AS within FROM bronze GROUP BY day_class UNION ALL SELECT 'all', count(*), count(DISTINCT timestamp), true FROM bronze")
def sketched_coverage(spark, d):
    """Distinct timestamps of each class and of all from the days' sketches; within: the exact count, to COUNT_ERROR of it."""
    parts = day_sketches(spark, d).withColumn("day_class", F.explode(F.array("day_class", F.lit("all"))))
    told = stats.merged(parts, ["day_class"], [0.5]).select("day_class", "n_rows", "n_distinct")
    exact = bronze(spark, d).select("day_class", "timestamp").distinct().rollup("day_class").agg(F.count("*").alias("n_exact")).select(F.coalesce("day_class", F.lit("all")).alias("day_class"), "n_exact")
    return told.join(exact, "day_class").select("day_class", "n_rows", "n_exact", (F.abs(F.col("n_distinct") / F.col("n_exact") - 1) <= COUNT_ERROR).alias("within"))


@query(GC + grid_sql(3600, "hgrid", "hbins") + ", q AS (SELECT CAST(floor(slot / 4.0) AS BIGINT) AS hour_slot, avg(avg_load) AS fine FROM g GROUP BY 1) SELECT count(*) AS n, round(avg(abs(fine - avg_load)), 6) AS mean_abs_diff, round(corr(fine, avg_load), 6) AS r, round(corr(fine, avg_load) * corr(fine, avg_load), 6) AS r2 FROM q JOIN hgrid h ON q.hour_slot = h.slot WHERE fine IS NOT NULL AND avg_load IS NOT NULL")
def resolution_fidelity(spark, d):
    fine = dense(spark, d).groupBy(F.floor(F.col("slot") / 4).alias("slot")).agg(F.avg(TARGET).alias("fine"))
    x = fine.join(dense(spark, d, 3600).select("slot", F.col(TARGET).alias("coarse")), "slot").na.drop(subset=["fine", "coarse"])
    return x.agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("fine") - F.col("coarse")))).alias("mean_abs_diff"), r6(F.corr("fine", "coarse")).alias("r"), r6(F.corr("fine", "coarse") * F.corr("fine", "coarse")).alias("r2"))


def folded(spark, d, steps):
    """Bins of several resolutions, folded from those of the finest step that divides all."""
    fine = gcd(*steps)
    return fx.folded(fx.states(bronze(spark, d), fine), fine, steps)


def hours_of(step: int) -> str:
    return f", h{step} AS (SELECT CAST(floor(slot * {step} / 3600.0) AS BIGINT) AS h, avg(v) AS v FROM (SELECT CAST(floor(sec / {step}.0) AS BIGINT) AS slot, avg(load) AS v FROM bronze GROUP BY 1) x GROUP BY 1)"


@query(B + "".join(map(hours_of, (60, 300, 600, 900))) + " " + " UNION ALL ".join(f"SELECT {a} AS fine, {b} AS coarse, count(*) AS n, round(avg(abs(x.v - y.v)), 6) AS mean_abs_diff, round(corr(x.v, y.v), 6) AS r, round(corr(x.v, y.v) * corr(x.v, y.v), 6) AS r2 FROM h{a} x JOIN h{b} y ON x.h = y.h WHERE x.v IS NOT NULL AND y.v IS NOT NULL" for a, b in ((60, 300), (300, 600), (600, 900))))
def adjacent_fidelity(spark, d):
    """Hourly means of each default resolution against those of the next coarser one, all from one read."""
    steps = [RESOLUTIONS[x] for x in DEFAULTS]
    v = folded(spark, d, steps).groupBy("series_id", F.floor(F.col("slot") * F.col("step") / 3600).alias("h")).pivot("step", steps).agg(F.avg(TARGET))
    pairs = F.array(*[F.struct(F.lit(a).alias("fine"), F.lit(b).alias("coarse"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in zip(steps, steps[1:], strict=False)])
    x = v.select(F.explode(pairs).alias("p")).select("p.*").na.drop(subset=["x", "y"])
    return x.groupBy("fine", "coarse").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("x") - F.col("y")))).alias("mean_abs_diff"), r6(F.corr("x", "y")).alias("r"), r6(F.corr("x", "y") * F.corr("x", "y")).alias("r2"))


@query(GC + ", q AS (SELECT CAST(floor(slot / 4.0) AS BIGINT) AS hour_slot, avg(avg_load) AS of_means, count(avg_load) AS k FROM g GROUP BY 1)" + grid_sql(3600, "hgrid", "hbins") + " SELECT count(*) AS n, round(max(abs(of_means - avg_load)), 6) AS worst FROM q JOIN hgrid h ON q.hour_slot = h.slot WHERE k = 4")
def resolution_consistency(spark, d):
    fine = dense(spark, d).groupBy(F.floor(F.col("slot") / 4).alias("slot")).agg(F.avg(TARGET).alias("fine"), F.count(TARGET).alias("k")).where("k = 4")
    x = fine.join(dense(spark, d, 3600).select("slot", F.col(TARGET).alias("coarse")), "slot")
    return x.agg(F.count("*").alias("n"), r6(F.max(F.abs(F.col("fine") - F.col("coarse")))).alias("worst"))


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {(GC if s == STEP else B + grid_sql(s) + ', g AS (SELECT slot, timestamp, avg_load FROM grid)')[5:]} SELECT {s} AS step, count(*) AS n_rows, CAST(44 AS INTEGER) AS n_columns, count(*) - count(avg_load) AS n_null, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM g) x" for s in (60, 300, 600, 900)))
def resolution_summary(spark, d):
    """The default resolutions, all from one read; columns are those of their silver tables."""
    steps = [RESOLUTIONS[x] for x in DEFAULTS]
    made = silver(spark, d).drop("series_id", "slot")
    g = fx.grid(folded(spark, d, steps), classes=False).groupBy("step")
    return g.agg(F.count("*").alias("n_rows"), F.lit(len(made.columns)).alias("n_columns"), (F.count("*") - F.count(TARGET)).alias("n_null"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


BOX = DAILY + ", q AS (SELECT day_class, quantile_cont(mean_load, 0.25) AS q1, quantile_cont(mean_load, 0.5) AS q2, quantile_cont(mean_load, 0.75) AS q3 FROM daily GROUP BY day_class)"


@query(BOX + " SELECT d.day_class, round(min(q1), 6) AS q1, round(min(q2), 6) AS median, round(min(q3), 6) AS q3, round(min(CASE WHEN mean_load BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN mean_load END), 6) AS low, round(max(CASE WHEN mean_load BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN mean_load END), 6) AS high FROM daily d JOIN q ON d.day_class = q.day_class GROUP BY d.day_class")
def boxplot_stats(spark, d):
    return rounded(stats.box(daily(spark, d), "mean_load", ["day_class"]))


STRATA = ("day_class", "hour", "season", "time_of_day")


@query(GC + f", c AS (SELECT avg_load AS v, day_class, {CAL} FROM g), l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS stratum, CAST({k} AS VARCHAR) AS value, v FROM c WHERE v IS NOT NULL" for k in STRATA) + "), q AS (SELECT stratum, value, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1, 2) SELECT l.stratum, l.value, round(min(q1), 6) AS q1, round(min(q2), 6) AS median, round(min(q3), 6) AS q3, round(min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS low, round(max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS high FROM l JOIN q ON l.stratum = q.stratum AND l.value = q.value GROUP BY 1, 2")
def boxplot_strata(spark, d):
    """The load's quartiles and whiskers by class, hour, season and time of day."""
    x = dense(spark, d).where(F.col(TARGET).isNotNull())
    c = calendar.calendar(F.col("timestamp"), F.col("day_class")) | {"day_class": F.col("day_class")}
    long = x.select(F.col(TARGET).alias("v"), F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), c[k].cast("string").alias("value")) for k in STRATA])).alias("s")).select("s.*", "v")
    return rounded(stats.box(long, "v", ["stratum", "value"]))


@query("SELECT event_id, event_type, CAST(CASE WHEN event_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY event_type NULLS LAST) - 1 END AS INTEGER) AS code FROM events")
def category_codes(spark, d):
    """The events' types as numbers, in sorted order."""
    return stats.category_codes(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), "event_type")


@query(B + " SELECT date, hour * 60 + minute AS minute, date + to_minutes(hour * 60 + minute) AS timestamp, round(avg(load), 6) AS load FROM bronze GROUP BY 1, 2, 3")
def minute_profile(spark, d):
    m = n(F.hour("timestamp") * 60 + F.minute("timestamp"), "minute")
    x = bronze(spark, d).groupBy("date", m).agg(r6(F.avg("load")).alias("load"))
    return x.withColumn("timestamp", F.timestamp_add("MINUTE", F.col("minute").cast("int"), F.col("date").cast("timestamp_ntz")))


@query(B + " SELECT day_class, strftime(date + to_minutes(CAST((hour * 60 + minute) - (hour * 60 + minute) % 5 AS BIGINT)), '%H:%M:%S') AS clock, round(avg(load), 6) AS load FROM bronze GROUP BY 1, 2")
def class_overlay(spark, d):
    clock = F.date_format(calendar.start(calendar.slot(F.col("timestamp"), 300), 300), "HH:mm:ss").alias("clock")
    return bronze(spark, d).groupBy("day_class", clock).agg(r6(F.avg("load")).alias("load"))


def islands(source: str, cond: str) -> str:
    return f", hit AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS island FROM {source} WHERE {cond}), runs AS (SELECT min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS length FROM hit GROUP BY island)"


@query(G + islands("grid", "avg_load IS NULL") + " SELECT first_slot, last_slot, length FROM runs")
def null_runs(spark, d):
    return fx.runs(dense(spark, d), F.col(TARGET).isNull(), 96).select("first_slot", "last_slot", "length")


LENGTHS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(G + islands("grid", "avg_load IS NULL") + " SELECT count(*) AS n, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std, CAST(min(length) AS BIGINT) AS low, CAST(max(length) AS BIGINT) AS high, " + ", ".join(f"round(quantile_cont(length, {p}), 6) AS p{int(100 * p)}" for p in LENGTHS) + " FROM runs")
def null_run_lengths(spark, d):
    """How long runs of missing slots are."""
    x = stats.described(fx.runs(dense(spark, d), F.col(TARGET).isNull(), 96), "length", LENGTHS)
    return x.select("n", r6("mean").alias("mean"), r6("std").alias("std"), n("low", "low"), n("high", "high"), *[r6(F.col("q")[i]).alias(f"p{int(100 * p)}") for i, p in enumerate(LENGTHS)])


ZERO = B.replace("value END AS load", "value END * CASE WHEN event_id % 1000 < 30 THEN 0.0 ELSE 1.0 END AS load")


def outage(spark, d):
    """Bronze in which 30 of every 1000 events stand at 0."""
    return bronze(spark, d).withColumn("load", F.col("load") * F.when(F.col("event_id") % 1000 < 30, 0.0).otherwise(1.0))


def zeros(spark, d, step=60, least=300):
    """Runs of slots whose load is 0 for ``least`` seconds and more, and their ends in time; nulls break them."""
    runs = fx.runs(fx.grid(fx.resample(outage(spark, d), step), step), F.col(TARGET) == 0, 1440).withColumn("seconds", F.col("length") * step)
    return runs.where(F.col("seconds") >= least).select("length", "seconds", calendar.start(F.col("first_slot"), step).alias("first_ts"), calendar.start(F.col("last_slot"), step).alias("last_ts"))


ZEROS = ZERO + grid_sql(STEP) + islands("grid", "avg_load = 0") + f", zeros AS (SELECT length, length * {STEP} AS seconds, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(first_slot * {STEP}) AS first_ts, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(last_slot * {STEP}) AS last_ts FROM runs WHERE length * {STEP} >= 300)"


@query(ZEROS + " SELECT * FROM zeros ORDER BY length DESC, first_ts LIMIT 20")
def zero_runs(spark, d):
    """The 20 longest outages of 300 s and more."""
    return zeros(spark, d, STEP).orderBy(F.desc("length"), "first_ts").limit(20)


Z = DAILY + ", z AS (SELECT date, day_class, CASE WHEN s > 0 THEN (mean_load - m) / s ELSE 0.0 END AS z FROM (SELECT date, day_class, mean_load, avg(mean_load) OVER (PARTITION BY day_class) AS m, stddev_pop(mean_load) OVER (PARTITION BY day_class) AS s FROM daily) x)"


def scored(spark, d):
    w = W.partitionBy("day_class")
    s = F.stddev_pop("mean_load").over(w)
    return daily(spark, d).withColumn("z", F.when(s > 0, (F.col("mean_load") - F.avg("mean_load").over(w)) / s).otherwise(0.0))


@query(Z + " SELECT date, day_class, round(z, 6) AS z FROM z")
def daily_zscore(spark, d):
    return scored(spark, d).select("date", "day_class", r6("z").alias("z"))


@query(Z + " SELECT date, round(z, 6) AS z FROM z ORDER BY abs(z) DESC, date LIMIT 12")
def top_days(spark, d):
    return scored(spark, d).orderBy(F.abs("z").desc(), "date").limit(12).select("date", r6("z").alias("z"))


@query(B + " SELECT CAST(greatest(10, least(300, ceil((hi - lo) / (2 * (q3 - q1) * pow(n, -1.0 / 3))))) AS BIGINT) AS fd, CAST(greatest(10, least(300, ceil(log2(n)) + 1)) AS BIGINT) AS sturges, CAST(greatest(10, least(300, ceil(sqrt(n)))) AS BIGINT) AS sqrt FROM (SELECT count(load) AS n, min(load) AS lo, max(load) AS hi, quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3 FROM bronze) x")
def optimal_bins(spark, d):
    return stats.optimal_bins(bronze(spark, d), "load")


BOUNDS = B + ", a AS (SELECT quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.5) AS q2, quantile_cont(load, 0.75) AS q3, avg(load) AS m, stddev_pop(load) AS s FROM bronze), mad AS (SELECT quantile_cont(abs(load - q2), 0.5) AS mad FROM bronze, a), bounds AS (SELECT 'iqr' AS method, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM a UNION ALL SELECT 'zscore', m - 3 * s, m + 3 * s FROM a UNION ALL SELECT 'mad', q2 - 3 * mad, q2 + 3 * mad FROM a, mad)"


@query(BOUNDS + " SELECT method, round(lower, 3) AS lower, round(upper, 3) AS upper FROM bounds")
def outlier_bounds(spark, d):
    return stats.outlier_bounds(bronze(spark, d), "load").select("method", F.round("lower", 3).alias("lower"), F.round("upper", 3).alias("upper"))


@query(BOUNDS + " SELECT method, round(avg(CASE WHEN load < lower OR load > upper THEN 1.0 ELSE 0.0 END), 6) AS rate FROM bronze, bounds WHERE load IS NOT NULL GROUP BY method")
def outlier_rate(spark, d):
    b = stats.outlier_bounds(bronze(spark, d), "load")
    x = bronze(spark, d).where("load is not null").select("load").crossJoin(F.broadcast(b))  # three rows
    return x.groupBy("method").agg(F.round(F.avg((~F.col("load").between(F.col("lower"), F.col("upper"))).cast("double")), 6).alias("rate"))


@query(BOX.replace("q AS", "qq AS") + " SELECT d.date, d.day_class, round(mean_load, 6) AS mean_load, (mean_load < q1 - 1.5 * (q3 - q1) OR mean_load > q3 + 1.5 * (q3 - q1)) AS outlier FROM daily d JOIN qq ON d.day_class = qq.day_class")
def outlier_days(spark, d):
    x = daily(spark, d)
    b = stats.outlier_bounds(x, "mean_load", ["day_class"]).where("method = 'iqr'")
    return x.join(b, "day_class").select("date", "day_class", r6("mean_load").alias("mean_load"), (~F.col("mean_load").between(F.col("lower"), F.col("upper"))).alias("outlier"))


FILL = G + ", f AS (SELECT slot, avg_load, last_value(avg_load IGNORE NULLS) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0, last_value(CASE WHEN avg_load IS NOT NULL THEN slot END IGNORE NULLS) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0, first_value(avg_load IGNORE NULLS) OVER (ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, first_value(CASE WHEN avg_load IS NOT NULL THEN slot END IGNORE NULLS) OVER (ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s1 FROM grid), filled AS (SELECT slot, coalesce(avg_load, v0 + (v1 - v0) * (slot - s0) / CAST(s1 - s0 AS DOUBLE), v0, v1) AS filled FROM f)"


@query(FILL + " SELECT slot, round(filled, 6) AS filled FROM filled")
def interpolate_linear(spark, d):
    return fx.interpolate(dense(spark, d)).select("slot", r6("filled").alias("filled"))


@query(G + " SELECT slot, round(coalesce(avg_load, med), 6) AS imputed FROM grid, (SELECT quantile_cont(avg_load, 0.5) AS med FROM grid) m")
def median_impute(spark, d):
    x = dense(spark, d)
    return x.crossJoin(F.broadcast(stats.quantiles(x, TARGET, [0.5]).select(F.col("q")[0].alias("med")))).select("slot", r6(F.coalesce(TARGET, "med")).alias("imputed"))  # one row


@query(FILL + ", lags AS (SELECT unnest(range(1, 49)) AS lag) SELECT lag, round(corr(a.filled, b.filled), 6) AS r, count(*) AS n FROM lags, filled a JOIN filled b ON a.slot = b.slot + lag GROUP BY lag".replace(", count(*) AS n FROM lags", ", count(*) AS n, round(1.96 / sqrt((SELECT count(*) FROM filled)), 6) AS band FROM lags"))
def acf(spark, d):
    x = fx.interpolate(dense(spark, d))
    return stats.acf(x, 48, "filled").select("lag", r6("r").alias("r"), "n", r6("band").alias("band"))


@query(G + f", v AS (SELECT row_number() OVER (ORDER BY slot) AS pos, avg_load AS y FROM grid WHERE avg_load IS NOT NULL), h AS (SELECT least(2000, count(*) - 1) AS top, {NormalDist().inv_cdf(0.975)} / sqrt(count(*)) AS bound FROM v), lags AS (SELECT unnest(range(1, top + 1)) AS lag FROM h), r AS (SELECT lag, corr(a.y, b.y) AS r FROM lags, v a JOIN v b ON a.pos = b.pos + lag GROUP BY lag), s AS (SELECT lag, sum(CASE WHEN coalesce(abs(r), 0) < bound THEN 1 ELSE 0 END) OVER (ORDER BY lag ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS streak FROM r, h) SELECT CAST(greatest(10, least(2000, coalesce(min(CASE WHEN streak = 5 THEN lag - 4 END), min(top)))) AS BIGINT) AS depth FROM s, h")
def acf_depth(spark, d):
    return stats.acf_depth(dense(spark, d), TARGET).drop("series_id")


PACF = (
    FILL.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", v AS (SELECT slot, filled - (SELECT avg(filled) FROM filled) AS y FROM filled), c AS (SELECT k, sum(a.y * b.y) AS c FROM (SELECT unnest(range(49)) AS k) x, v a JOIN v b ON a.slot = b.slot + k GROUP BY k),"
    + " r AS (SELECT list(c.c / o.c ORDER BY c.k) AS r FROM c, c o WHERE o.k = 0),"
    + " d(k, phi, last_) AS (SELECT 1, [r[2]], r[2] FROM r UNION ALL SELECT k + 1, list_concat(list_transform(phi, lambda x, i: x - l * phi[k + 1 - i]), [l]), l FROM"
    + " (SELECT k, phi, (r[k + 2] - list_sum(list_transform(phi, lambda x, i: x * r[k + 2 - i]))) / (1 - list_sum(list_transform(phi, lambda x, i: x * r[i + 1]))) AS l FROM d, r WHERE k < 48) x)"
)


@query(PACF + " SELECT CAST(k AS BIGINT) AS lag, round(last_, 6) AS pacf FROM d")
def pacf(spark, d):
    return rounded(stats.pacf(fx.interpolate(dense(spark, d)), 48, "filled").drop("series_id"))


def vif_sql(columns: tuple[str, ...]) -> str:
    """Inflation factors by turning the Gram matrix, with the unit matrix beside it, into its inverse column by column."""
    k = len(columns)
    rows = ", ".join("[" + ", ".join([*(f"sum(CAST({a} AS DOUBLE) * {b})" for b in columns), *(f"{float(i == j)}::DOUBLE" for j in range(k))]) + "]" for i, a in enumerate(columns))
    return (
        QUARTER.replace("WITH ", "WITH RECURSIVE ", 1)
        + f", gram AS (SELECT [{rows}] AS m FROM silver WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)}),"
        + " e(k, m) AS (SELECT 1, m FROM gram UNION ALL SELECT k + 1, list_transform(m, lambda own, i: CASE WHEN i = k THEN list_transform(own, lambda x: x / m[k][k]) ELSE list_transform(own, lambda x, j: x - own[k] * m[k][j] / m[k][k]) END)"
        + f" FROM e WHERE k <= {k}), v AS (SELECT unnest({list(columns)}) AS column_, unnest(range(1, {k + 1})) AS j), f AS (SELECT column_, gram.m[j][j] * e.m[j][{k} + j] AS vif FROM v, e, gram WHERE e.k = {k + 1})"
        + " SELECT column_ AS \"column\", round(vif, 4) AS vif, CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END AS flag FROM f"
    )


VARYING = tuple(c for c in Settings().sets()["curated"] if c != "season")  # one season in a month: its column doesn't vary


@query(vif_sql(VARYING) + " UNION ALL SELECT 'season', NULL, 'constant'")
def vif(spark, d):
    return stats.vif(rounded(silver(spark, d)), list(Settings().sets()["curated"])).withColumn("vif", F.round("vif", 4))


@query(QUARTER + ", x AS (SELECT sum(CAST(hour AS DOUBLE) * hour) AS aa, sum(lag_1 * lag_1) AS bb, sum(hour * lag_1) AS ab FROM silver WHERE hour IS NOT NULL AND lag_1 IS NOT NULL), v AS (SELECT aa * bb / (aa * bb - ab * ab) AS vif FROM x) SELECT column_ AS \"column\", round(vif, 4) AS vif, CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END AS flag FROM v, (SELECT unnest(['hour', 'lag_1']) AS column_) c")
def vif_pair(spark, d):
    """Two columns, whose factor SQL can tell."""
    return stats.vif(silver(spark, d), ["hour", "lag_1"]).withColumn("vif", F.round("vif", 4))


@query(FILL + ", p AS (SELECT unnest([4, 8, 24, 96, 672]) AS period) SELECT CAST(period AS BIGINT) AS period, round((pow(sum(v * cos(2 * pi() * slot / period)), 2) + pow(sum(v * sin(2 * pi() * slot / period)), 2)) / count(*), 1) AS power FROM (SELECT slot, filled - (SELECT avg(filled) FROM filled) AS v FROM filled) x, p GROUP BY period")
def periodogram_at(spark, d):
    x = fx.interpolate(dense(spark, d))
    v = x.crossJoin(F.broadcast(x.agg(F.avg("filled").alias("m")))).select("slot", (F.col("filled") - F.col("m")).alias("v"), F.explode(F.array(*map(F.lit, (4, 8, 24, 96, 672))).cast("array<long>")).alias("period"))
    angle = 2 * F.pi() * F.col("slot") / F.col("period")
    power = (F.pow(F.sum(F.col("v") * F.cos(angle)), F.lit(2)) + F.pow(F.sum(F.col("v") * F.sin(angle)), F.lit(2))) / F.count("*")
    return v.groupBy("period").agg(F.round(power, 1).alias("power"))


WELCH_BINS = [1, 5, 10, 21, 64, 200, 256]
WELCH = (
    FILL
    + ", x AS (SELECT slot - (SELECT min(slot) FROM filled) AS t, filled AS y FROM filled), ks AS (SELECT unnest(range(CAST((SELECT max(t) FROM x) // 256 AS BIGINT))) AS k),"
    + " seg AS (SELECT k, t - 256 * k AS i, y, avg(y) OVER (PARTITION BY k) AS m, count(*) OVER (PARTITION BY k) AS n FROM ks JOIN x ON t >= 256 * k AND t < 256 * k + 512),"
    + " w AS (SELECT k, i, (y - m) * (0.5 - 0.5 * cos(2 * pi() * i / 512)) AS v FROM seg WHERE n = 512),"
    + f" p AS (SELECT k, bin, pow(sum(v * cos(2 * pi() * i * bin / 512)), 2) + pow(sum(v * sin(2 * pi() * i * bin / 512)), 2) AS p FROM w, (SELECT unnest({WELCH_BINS}) AS bin) b GROUP BY 1, 2)"
)


@query(WELCH + " SELECT CAST(bin AS BIGINT) AS bin, round(bin / 512.0, 6) AS frequency, round(512.0 / bin, 6) AS period, count(*) AS segments, round(avg(p) * CASE WHEN bin = 256 THEN 1 ELSE 2 END / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 512), 2)) FROM (SELECT unnest(range(512)) AS i) z), 3) AS power FROM p GROUP BY bin")
def welch_at(spark, d):
    """The spectrum at some bins, which SQL can tell by sums of sines and cosines."""
    x = stats.welch(fx.interpolate(dense(spark, d)), "filled", 512).where(F.col("bin").isin(*WELCH_BINS))
    return x.select("bin", r6("frequency").alias("frequency"), r6("period").alias("period"), "segments", F.round("power", 3).alias("power"))


@query()
def welch_psd(spark, d):
    return stats.welch(fx.interpolate(dense(spark, d)), "filled", 512).drop("series_id", "segments")


QQ = [(i / 100, NormalDist().inv_cdf(i / 100)) for i in range(1, 100)]


@query(B + f", x AS (SELECT unnest(CAST({[p for p, _ in QQ]} AS DOUBLE[])) AS p, unnest(CAST({[z for _, z in QQ]} AS DOUBLE[])) AS normal, unnest(quantile_cont(load, {[p for p, _ in QQ]})) AS observed FROM bronze), f AS (SELECT regr_slope(observed, normal) AS slope, regr_intercept(observed, normal) AS intercept, regr_r2(observed, normal) AS r2 FROM x) SELECT round(p, 6) AS p, round(observed, 6) AS observed, round(normal, 6) AS normal, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM x, f")
def qq_normal(spark, d):
    return rounded(stats.qq_normal(bronze(spark, d), "load"))


def horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c})"
    return out


NORMAL_SQL = f"CASE WHEN p < 0.02425 THEN {horner_sql(stats.TAIL[0], 'r')} / {horner_sql(stats.TAIL[1], 'r')} WHEN p > 0.97575 THEN -{horner_sql(stats.TAIL[0], 'r')} / {horner_sql(stats.TAIL[1], 'r')} ELSE q * {horner_sql(stats.MIDDLE[0], 'q * q')} / {horner_sql(stats.MIDDLE[1], 'q * q')} END"


@query(G + f", v AS (SELECT avg_load AS observed, row_number() OVER (ORDER BY avg_load, slot) AS i, count(*) OVER () AS n FROM grid WHERE (slot - (SELECT a FROM bins_ends)) % 2 = 0 AND avg_load IS NOT NULL), u AS (SELECT i, observed, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM v), z AS (SELECT i, observed, {NORMAL_SQL} AS normal FROM (SELECT *, p - 0.5 AS q, sqrt(-2 * ln(least(p, 1 - p))) AS r FROM u) x), f AS (SELECT regr_slope(observed, normal) AS slope, regr_intercept(observed, normal) AS intercept, regr_r2(observed, normal) AS r2 FROM z) SELECT i, round(observed, 6) AS observed, round(normal, 6) AS normal, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM z, f")
def qq_sample(spark, d):
    """Every second slot's load, in order, against the medians of normal order statistics."""
    x = dense(spark, d)
    first = F.broadcast(x.agg(F.min("slot").alias("first")))  # one row
    return rounded(stats.qq_sample(x.crossJoin(first).where("(slot - first) % 2 = 0"), TARGET, ["slot"]))


@query("WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1), every AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM daily), (SELECT max(date) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date), g AS (SELECT e.date, date_diff('day', DATE '1970-01-01', e.date) AS t, v FROM every e LEFT JOIN daily d ON e.date = d.date), s AS (SELECT date, t, v, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1 FROM g WINDOW b AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), h AS (SELECT date, t, coalesce(v, v0 + (v1 - v0) * (t - t0) / CAST(t1 - t0 AS DOUBLE)) AS v FROM s), i AS (SELECT date, v, t % 7 AS i, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS trend FROM h WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), k AS (SELECT i AS k, avg(v - trend) AS raw FROM i GROUP BY 1), c AS (SELECT k, raw - (SELECT avg(raw) FROM k) AS seasonal FROM k) SELECT date, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal, round(v - trend - seasonal, 2) AS residual FROM i JOIN c ON i.i = c.k")
def seasonal_decompose(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    x = o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.sum("o_totalprice") / 1000).alias("v")).withColumn("series_id", F.lit("0"))
    return stats.decompose(x, "v").select("date", *[F.round(c, 2).alias(c) for c in ("trend", "seasonal", "residual")])


PREDICTORS = ["lag_1", "lag_5", "hour", "day_of_week", "rolling_mean_5", "slope_5"]
TENTHS = [i / 10 for i in range(1, 10)]


def places_sql(c: str) -> str:
    """The number of tenths below a value, nulls at the median."""
    return f"len(list_filter(q_{c}, lambda t: t < coalesce(CAST({c} AS DOUBLE), q_{c}[5])))"


@query(QUARTER + ", y AS (SELECT * FROM silver WHERE avg_load IS NOT NULL), q AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {TENTHS}) AS q_{c}" for c in [*PREDICTORS, TARGET]) + " FROM y), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {places_sql(c)} AS b, {places_sql(TARGET)} AS t FROM y, q" for c in PREDICTORS) + "), j AS (SELECT feature, b, t, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, t) AS nt, sum(n) OVER (PARTITION BY feature) AS a FROM j) SELECT feature, round(sum(n / CAST(a AS DOUBLE) * ln(CAST(n AS DOUBLE) * a / (CAST(nb AS DOUBLE) * nt))), 6) AS mi FROM m GROUP BY feature")
def mutual_information(spark, d):
    return rounded(stats.mutual_information(silver(spark, d).where("avg_load is not null"), PREDICTORS, TARGET))


def checks(row, names: dict[str, tuple]):
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.round(v.cast("double"), 6).alias("metric"), ok.alias("passed")) for k, (v, ok) in names.items()])).alias("c")).select("c.*")


def scorecard_sql(parts: list[tuple[str, str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", round(CAST({v} AS DOUBLE), 6) AS metric, {ok} AS passed FROM {source}" for k, v, ok in parts)


RAW = B + ", a AS (SELECT count(*) AS rows_, 100.0 * (count(*) - count(load)) / count(*) AS null_pct, count(DISTINCT date) AS dates, CAST(sum(CASE WHEN day_class NOT IN ('full', 'half', 'none') THEN 1 ELSE 0 END) AS BIGINT) AS bad_class, CAST(sum(CASE WHEN load < 0 OR load > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS outside, max(sec) AS last_, count(*) - count(DISTINCT timestamp) AS dup FROM bronze)"


OUTLIERS = ", q AS (SELECT quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3 FROM bronze), o AS (SELECT avg(CASE WHEN load < q1 - 1.5 * (q3 - q1) OR load > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS rate FROM bronze, q WHERE load IS NOT NULL) "


@query(RAW + OUTLIERS + scorecard_sql([("rows", "rows_", "rows_ > 0"), ("shape", "rows_ / CAST(dates AS DOUBLE)", "rows_ = 86400 * dates"), ("null_pct", "null_pct", "null_pct < 2"), ("dates", "dates", "dates = 31"), ("classes", "bad_class", "bad_class = 0"), ("range", "outside", "outside = 0"), ("outlier_rate", "rate", "rate < 0.01")], "a, o"))
def scorecard_raw(spark, d):
    lo, hi = Settings().physical
    b = bronze(spark, d)
    row = b.agg(F.count("*").alias("rows"), (100.0 * (F.count("*") - F.count("load")) / F.count("*")).alias("null_pct"), F.countDistinct("date").alias("dates"), F.count_if(~F.col("day_class").isin("full", "half", "none")).alias("bad"), F.count_if(~F.col("load").between(lo, hi)).alias("outside"))
    bounds = F.broadcast(stats.outlier_bounds(b, "load").where("method = 'iqr'"))  # one row
    rate = b.where("load is not null").crossJoin(bounds).agg(F.avg((~F.col("load").between(F.col("lower"), F.col("upper"))).cast("double")).alias("rate"))
    c = F.col
    return checks(row.crossJoin(rate), {"outlier_rate": (c("rate"), c("rate") < 0.01), "rows": (c("rows"), c("rows") > 0), "shape": (c("rows") / c("dates"), c("rows") == 86400 * c("dates")), "null_pct": (c("null_pct"), c("null_pct") < 2), "dates": (c("dates"), c("dates") == 31), "classes": (c("bad"), c("bad") == 0), "range": (c("outside"), c("outside") == 0)})


RAW_ZERO = RAW.replace(B, ZERO) + ", back AS (SELECT CAST(count(*) AS BIGINT) AS n_back FROM (SELECT timestamp, lag(timestamp) OVER (ORDER BY event_id) AS before FROM bronze) x WHERE timestamp < before)"


@query(RAW_ZERO + grid_sql(STEP) + islands("grid", "avg_load = 0") + f", l AS (SELECT coalesce(max(length), 0) * {STEP} AS longest FROM runs WHERE length * {STEP} >= 300) " + scorecard_sql([("rows", "rows_", "rows_ = 86400 * dates"), ("monotonic", "n_back", "n_back = 0"), ("null_pct", "null_pct", "null_pct < 2"), ("classes", "bad_class", "bad_class = 0"), ("duplicates", "dup", "dup = 0"), ("zero_run", "longest", "longest <= 3600"), ("range", "outside", "outside = 0")], "a, l, back"))
def scorecard_bronze(spark, d):
    """Seven checks; time must not go back in the order of event_id, found in each day and from day to day's ends."""
    lo, hi = Settings().physical
    b = outage(spark, d)
    row = b.agg(F.count("*").alias("rows"), F.countDistinct("date").alias("dates"), (100.0 * (F.count("*") - F.count("load")) / F.count("*")).alias("null_pct"), F.count_if(~F.col("day_class").isin("full", "half", "none")).alias("bad"), (F.count("*") - F.countDistinct("timestamp")).alias("dup"), F.count_if(~F.col("load").between(lo, hi)).alias("outside"))
    numbered = stats.neighbour(b.select("series_id", F.col("event_id").alias("slot"), "timestamp"), "timestamp")
    back = numbered.agg(F.count_if(F.col("timestamp") < F.col("before")).alias("n_back"))
    longest = zeros(spark, d, STEP).agg(F.coalesce(F.max("seconds"), F.lit(0)).alias("longest"))
    c = F.col
    return checks(row.crossJoin(longest).crossJoin(back), {"rows": (c("rows"), c("rows") == 86400 * c("dates")), "monotonic": (c("n_back"), c("n_back") == 0), "null_pct": (c("null_pct"), c("null_pct") < 2), "classes": (c("bad"), c("bad") == 0), "duplicates": (c("dup"), c("dup") == 0), "zero_run": (c("longest"), c("longest") <= 3600), "range": (c("outside"), c("outside") == 0)})


INCOMPLETE = " OR ".join(f"{c} IS NULL" for c in Settings().required() if c != TARGET)
SILVER_ROW = f", a AS (SELECT count(*) AS rows_, max(slot) - min(slot) + 1 AS expected, 100.0 * (count(*) - count(avg_load)) / count(*) AS null_pct, count(*) FILTER (WHERE {INCOMPLETE}) AS incomplete, count(*) - count(lag_1) AS warm_up FROM silver), top AS (SELECT max(abs(r)) AS top FROM m) "


@query(QUARTER + ", " + CORR_SQL + SILVER_ROW + scorecard_sql([("columns", "44", "true"), ("rows", "rows_", "abs(rows_ - expected) <= 1"), ("null_pct", "null_pct", "null_pct < 1"), ("core", "incomplete", "incomplete = 0"), ("warm_up", "warm_up", "warm_up >= 1"), ("max_corr", "top", "top < 0.99")], "a, top"))
def scorecard_silver(spark, d):
    s = rounded(silver(spark, d))
    columns = Settings().columns()
    row = s.agg(F.count("*").alias("rows"), (F.max("slot") - F.min("slot") + 1).alias("expected"), (100.0 * (F.count("*") - F.count(TARGET)) / F.count("*")).alias("null_pct"), F.count_if(F.greatest(*[F.col(c).isNull() for c in Settings().required() if c != TARGET])).alias("incomplete"), F.count_if(F.col("lag_1").isNull()).alias("warm_up"))
    top = stats.corr_matrix(s, CORR).agg(F.max(F.abs(F.round("r", 3))).alias("top"))
    c = F.col
    return checks(row.crossJoin(top), {"columns": (F.lit(len([x for x in columns if x in s.columns])), F.lit(len(columns) == 44)), "rows": (c("rows"), F.abs(c("rows") - c("expected")) <= 1), "null_pct": (c("null_pct"), c("null_pct") < 1), "core": (c("incomplete"), c("incomplete") == 0), "warm_up": (c("warm_up"), c("warm_up") >= 1), "max_corr": (c("top"), c("top") < 0.99)})


@query(B + ", r AS (SELECT date, load, load - lag(load) OVER (PARTITION BY date ORDER BY event_id) AS ramp FROM bronze WHERE load IS NOT NULL) SELECT date, round(max(abs(ramp)), 6) AS max_ramp, round(stddev_samp(load) / avg(load), 6) AS cv FROM r GROUP BY date")
def daily_ramp_cv(spark, d):
    b = bronze(spark, d).where("load is not null")
    ramp = F.col("load") - F.lag("load").over(W.partitionBy("series_id", "date").orderBy("event_id"))
    return b.withColumn("ramp", ramp).groupBy("date").agg(r6(F.max(F.abs("ramp"))).alias("max_ramp"), r6(F.stddev_samp("load") / F.avg("load")).alias("cv"))


@query(B + ", c AS (SELECT day_class, load IS NULL AS missing, count(*) AS o FROM bronze GROUP BY 1, 2), m AS (SELECT day_class, missing, o, sum(o) OVER (PARTITION BY day_class) * sum(o) OVER (PARTITION BY missing) / CAST(sum(o) OVER () AS DOUBLE) AS e FROM c) SELECT count(*) AS cells, round(sum((o - e) * (o - e) / e), 6) AS chi2 FROM m")
def null_class_chi2(spark, d):
    c = bronze(spark, d).groupBy("day_class", F.col("load").isNull().alias("missing")).agg(F.count("*").alias("o"))
    e = F.sum("o").over(W.partitionBy("day_class")) * F.sum("o").over(W.partitionBy("missing")) / F.sum("o").over(W.partitionBy())
    return c.withColumn("e", e).agg(F.count("*").alias("cells"), r6(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e"))).alias("chi2"))
