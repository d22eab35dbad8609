"""Queries over the given tables, each with the SQL that gives the same rows. The events table stands in for a meter."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import features as fx
from ..operators import stats
from ..sources import bronze as src
from . import hypotheses, pipeline
from .settings import LAGS, ROLLING, SLOPES, TARGET, Settings

STEP = 900
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

B = """WITH bronze AS (SELECT event_id, ts AS timestamp, CAST(ts AS DATE) AS date, CASE extract('dow' FROM ts) WHEN 0 THEN 'none' WHEN 6 THEN 'half' ELSE 'full' END AS day_class,
 CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 0.0 ELSE value END AS load,
 CAST(extract('hour' FROM ts) AS BIGINT) AS hour, CAST(extract('minute' FROM ts) AS BIGINT) AS minute, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"""


def grid_sql(step: int, name: str = "grid", bins: str = "bins") -> str:
    return f""", {bins} AS (SELECT CAST(floor(sec / {step}.0) AS BIGINT) AS slot, avg(load) AS avg_load, min(day_class) AS day_class FROM bronze GROUP BY 1),
 {bins}_ends AS (SELECT min(slot) AS a, max(slot) AS b FROM {bins}), {bins}_slots AS (SELECT unnest(range(a, b + 1)) AS slot FROM {bins}_ends),
 {name} AS (SELECT s.slot, b.avg_load, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(s.slot * {step}) AS timestamp FROM {bins}_slots s LEFT JOIN {bins} b ON s.slot = b.slot)"""


CLASS = "CASE extract('dow' FROM timestamp) WHEN 0 THEN 'none' WHEN 6 THEN 'half' ELSE 'full' END"
G = B + grid_sql(STEP)
GC = G + f", g AS (SELECT slot, timestamp, avg_load, {CLASS} AS day_class, CAST(timestamp AS DATE) AS date, CAST(extract('hour' FROM timestamp) AS BIGINT) AS hour FROM grid)"
DAILY = B + ", daily AS (SELECT date, min(day_class) AS day_class, avg(load) AS mean_load, max(load) AS max_load, sum(load) AS energy FROM bronze GROUP BY date)"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def bronze(spark: SparkSession, d: str, by_user: bool = False) -> DataFrame:
    return src.from_events(spark.read.parquet(f"{d}/events.parquet"), by_user)


def dense(spark: SparkSession, d: str, step: int = STEP) -> DataFrame:
    return fx.grid(fx.resample(bronze(spark, d), step), step)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return bronze(spark, d).groupBy("date").agg(F.min("day_class").alias("day_class"), F.avg("load").alias("mean_load"), F.max("load").alias("max_load"), F.sum("load").alias("energy"))


def digits(name: str) -> int:
    """Places to which results are rounded: so many that means of values with two places hardly fall between two results."""
    return 7 if name.startswith("slope_") else 6


def n(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


# ---- sources, sinks, contracts


@query(B + " SELECT timestamp, day_class, load FROM bronze")
def scan_bronze(spark, d):
    return src.require(bronze(spark, d), src.REQUIRED).select(*src.REQUIRED)


def wide_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hour x date matrix of mean loads; the dates are the series' days, one column each."""
    b = bronze(spark, d).withColumn("hour_of_day", F.hour("timestamp"))
    days = [r["date"] for r in b.select("date").distinct().orderBy("date").collect()]  # a wide table has a column for each
    return b.groupBy("hour_of_day").pivot("date", [str(x) for x in days]).agg(F.avg("load"))


@query(B + " SELECT count(DISTINCT hour) AS n_rows, count(DISTINCT hour) AS n_keys, count(DISTINCT date) AS n_days, count(DISTINCT hour) = 24 AS valid FROM bronze")
def raw_contract(spark, d):
    return src.contract(wide_hours(spark, d), "hour_of_day", 24)


@query(B + " SELECT date, min(day_class) AS day_class, CAST(1 AS BIGINT) AS n FROM bronze GROUP BY date")
def day_labels(spark, d):
    raw = bronze(spark, d).select("date", F.concat(F.lit("  "), F.upper("day_class"), F.lit(" ")).alias("day_class")).distinct()
    return src.labels(raw)


@query(B + " SELECT date, hour AS hour_of_day, round(avg(load), 6) AS load FROM bronze GROUP BY date, hour")
def unpivot_days(spark, d):
    return src.melt(wide_hours(spark, d), "hour_of_day").select("date", n("hour_of_day", "hour_of_day"), r6("load").alias("load")).join(bronze(spark, d).select("date", n(F.hour("timestamp"), "hour_of_day")).distinct(), ["date", "hour_of_day"], "left_semi")


@query(B + " SELECT timestamp, day_class, load FROM bronze")
def write_roundtrip(spark, d):
    path = f"{src.shared_dir(spark)}/layer-{spark.sparkContext.applicationId}"
    src.write_layer(bronze(spark, d).select("day_class", "timestamp", "load"), path, ("day_class",))
    return spark.read.parquet(path).select("timestamp", "day_class", "load")


@query()
def determinism_hash(spark, d):
    """The number of the silver layer's rows and their hash; ``layer_manifest`` compares two runs of it."""
    return src.content_hash(fx.silver(bronze(spark, d), STEP, Settings(lags=(1, 5), rolling=(5,), slopes=(5,))))


@query(G + f", g AS (SELECT CAST(timestamp AS DATE) AS date FROM grid) SELECT date, count(*) AS n_rows, count(*) AS n_other, true AS equal FROM g GROUP BY date")
def layer_manifest(spark, d):
    """The silver layer made twice, in chunks of other sizes and written to files of another layout: whether each day's content is the same."""
    root, s = f"{src.shared_dir(spark)}/manifest-{uuid.uuid4().hex}", Settings(lags=(1, 5), rolling=(5,), slopes=(5,))
    src.write_layer(fx.silver(bronze(spark, d), STEP, s).withColumn("part", F.col("slot") % 5), f"{root}/a", ("part",))
    src.write_layer(fx.silver(bronze(spark, d).repartition(7), STEP, s, 500).repartition(3, "hour"), f"{root}/b", dealt=True)
    a, b = (spark.read.parquet(f"{root}/{k}").withColumn("date", F.to_date("timestamp")).drop("part") for k in "ab")
    return src.compared(src.manifest(a, ["date"]), src.manifest(b, ["date"]), ["date"]).drop("content")


@query("SELECT count(*) AS n_rows, CAST(sum(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_null, round(sum(CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END), 2) AS total FROM events")
def inf_to_null(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.withColumn("load", F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return src.clean(e).agg(F.count("*").alias("n_rows"), n(F.count_if(F.col("load").isNull()), "n_null"), F.round(F.sum("load"), 2).alias("total"))


@query(B + " SELECT count(*) AS n_rows, count(*) - count(load) AS n_dropped, round(100.0 * (count(*) - count(load)) / count(*), 6) AS pct, (100.0 * (count(*) - count(load)) / count(*)) > 5.0 AS warn FROM bronze")
def null_drop_report(spark, d):
    x = bronze(spark, d).agg(F.count("*").alias("n_rows"), (F.count("*") - F.count("load")).alias("n_dropped"))
    pct = 100.0 * F.col("n_dropped") / F.col("n_rows")
    return x.select("n_rows", "n_dropped", F.round(pct, 6).alias("pct"), (pct > Settings().drop_warning_pct).alias("warn"))


@query(B + " SELECT day_class, count(*) AS n FROM bronze WHERE day_class NOT IN ('full', 'none') GROUP BY day_class")
def domain_violations(spark, d):
    return src.domain_violations(bronze(spark, d), "day_class", ["full", "none"])


@query(B + " SELECT count(load) AS n_checked, CAST(sum(CASE WHEN load < 1 OR load > 400 THEN 1 ELSE 0 END) AS BIGINT) AS n_outside FROM bronze")
def range_violations(spark, d):
    return bronze(spark, d).agg(F.count("load").alias("n_checked"), n(F.count_if(~F.col("load").between(1, 400)), "n_outside"))


@query(B + " SELECT date, min(day_class) AS day_class, count(*) AS n FROM bronze GROUP BY date")
def label_join(spark, d):
    b = bronze(spark, d)
    return src.label_join(b, b.select("date", "day_class").distinct()).groupBy("date").agg(F.min("day_class").alias("day_class"), F.count("*").alias("n"))


@query(B + " SELECT DISTINCT date FROM bronze WHERE extract('day' FROM date) > 20")
def unmatched_dates(spark, d):
    b = bronze(spark, d)
    return src.unmatched(b, b.where(F.dayofmonth("date") <= 20).select("date", "day_class").distinct())


@query(B + " SELECT 'load' AS \"column\", count(*) - count(load) AS n_null, round((count(*) - count(load)) / CAST(count(*) AS DOUBLE), 6) AS null_rate FROM bronze UNION ALL SELECT 'day_class', CAST(0 AS BIGINT), CAST(0 AS DOUBLE)")
def null_profile(spark, d):
    return src.null_counts(bronze(spark, d), ["load", "day_class"])


@query(B + " SELECT day_class, count(*) AS n FROM bronze GROUP BY day_class")
def class_counts(spark, d):
    return bronze(spark, d).groupBy("day_class").agg(F.count("*").alias("n"))


@query(B + " SELECT count(DISTINCT date) AS n_dates, count(DISTINCT day_class) AS n_classes, count(DISTINCT timestamp) AS n_timestamps FROM bronze")
def coverage(spark, d):
    return bronze(spark, d).agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("day_class").alias("n_classes"), F.countDistinct("timestamp").alias("n_timestamps"))


@query(B + " SELECT count(*) AS n_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts, min(load) AS min_load, max(load) AS max_load, round(avg(load), 6) AS mean_load FROM bronze")
def series_profile(spark, d):
    return bronze(spark, d).agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.min("load").alias("min_load"), F.max("load").alias("max_load"), r6(F.avg("load")).alias("mean_load"))


@query(B + " SELECT count(*) - count(DISTINCT sec) AS n_duplicates FROM bronze")
def duplicate_ts(spark, d):
    return bronze(spark, d).agg((F.count("*") - F.countDistinct(calendar.seconds(F.col("timestamp")))).alias("n_duplicates"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_back FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) x WHERE ts < before")
def monotonic_violations(spark, d):
    b = bronze(spark, d, by_user=True).select("series_id", F.col("event_id").alias("slot"), "timestamp")
    return stats.going_back(b, "timestamp").agg(F.coalesce(F.sum("n_back"), F.lit(0)).alias("n_back"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS series_id, count(*) AS n_back, min(o_orderkey) AS slot, arg_min(before, o_orderkey) AS before, arg_min(o_orderdate, o_orderkey) AS at FROM (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) x WHERE o_orderdate < before GROUP BY o_custkey")
def first_backward(spark, d):
    """Of each customer whose orders' dates don't follow their keys, how often time goes back, and the first order where it does."""
    x = spark.read.parquet(f"{d}/orders.parquet")
    return stats.going_back(x.select(F.col("o_custkey").cast("string").alias("series_id"), n("o_orderkey", "slot"), F.col("o_orderdate").alias("timestamp")), "timestamp")


@query(G + " SELECT slot, round(avg_load, 6) AS avg_load FROM grid WHERE (slot - (SELECT a FROM bins_ends)) % 50 = 0")
def systematic_sample(spark, d):
    """Every 50th slot of the dense grid, counted from its first."""
    x = dense(spark, d)
    first = F.broadcast(x.agg(F.min("slot").alias("first")))  # one row
    return x.crossJoin(first).where("(slot - first) % 50 = 0").select("slot", r6(TARGET).alias(TARGET))


# ---- resampling and features


@query(B + f" SELECT CAST(floor(sec / {STEP}.0) AS BIGINT) AS slot, round(avg(load), 6) AS avg_load, count(*) AS n FROM bronze GROUP BY 1")
def resample_mean(spark, d):
    b = bronze(spark, d).groupBy(calendar.slot(F.col("timestamp"), STEP).alias("slot"))
    return b.agg(r6(F.avg("load")).alias("avg_load"), F.count("*").alias("n"))


@query(B + f" SELECT CAST(floor(sec / {STEP}.0) AS BIGINT) AS slot, arg_min(event_type, ts) AS first_type FROM (SELECT b.sec, e.event_type, e.ts FROM bronze b JOIN events e ON b.event_id = e.event_id) x GROUP BY 1")
def resample_first(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(calendar.slot(F.col("ts"), STEP).alias("slot")).agg(F.min_by("event_type", "ts").alias("first_type"))


@query(GC + " SELECT slot, timestamp, day_class, round(avg_load, 6) AS avg_load FROM g")
def grid_fill(spark, d):
    return dense(spark, d).select("slot", "timestamp", "day_class", r6(TARGET).alias(TARGET))


def over(k: int) -> str:
    return f"OVER (ORDER BY slot ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def rolling_sql(sizes: tuple[int, ...]) -> str:
    return ", ".join(f"round(CASE WHEN count(avg_load) {over(k)} = {k} THEN {f}(avg_load) {over(k)} END, 6) AS rolling_{s}_{k}" for k in sizes for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))


def slopes_sql(sizes: tuple[int, ...]) -> str:
    at = lambda k: f"OVER (ORDER BY slot ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    x = "CAST(slot - first_slot AS DOUBLE)"
    return ", ".join(f"round(CASE WHEN count(avg_load) {at(k)} = {k} THEN (avg({x} * avg_load) {at(k)} - avg({x}) {at(k)} * avg(avg_load) {at(k)}) / (({k} * {k} - 1) / 12.0) END, 7) AS slope_{k}" for k in sizes)


GF = G.replace("SELECT s.slot,", "SELECT s.slot, (SELECT a FROM bins_ends) AS first_slot,")


def made(spark: SparkSession, d: str, make: Callable[[DataFrame, object], dict[str, Column]], history: int, step: int = STEP) -> DataFrame:
    def put(df, w):
        df = df.withColumn("pos", (F.col("slot") - F.col("chunk") * fx.CHUNK).cast("double"))
        return df.withColumns({k: F.round(c, digits(k)) for k, c in make(df, w).items()})

    return fx.chunked(dense(spark, d, step), history, put).drop("series_id", "timestamp", "day_class", "pos", TARGET)


@query(G + " SELECT slot, " + ", ".join(f"round(lag(avg_load, {k}) OVER (ORDER BY slot), 6) AS lag_{k}" for k in LAGS) + " FROM grid")
def lag_features(spark, d):
    return made(spark, d, lambda df, w: fx.lag_columns(w, LAGS), max(LAGS))


@query(G + f" SELECT slot, {rolling_sql((5, 15, 60))} FROM grid")
def rolling_features(spark, d):
    return made(spark, d, lambda df, w: fx.rolling_columns(w, (5, 15, 60)), 59)


@query(G + " SELECT slot, " + ", ".join(f"round(lag(avg_load, {k}) OVER (ORDER BY slot) - lag(avg_load, 1) OVER (ORDER BY slot), 6) AS delta_{k}" for k in LAGS if k != 1) + " FROM grid")
def delta_features(spark, d):
    x = fx.chunked(dense(spark, d), max(LAGS), lambda df, w: df.withColumns(fx.lag_columns(w, LAGS)))
    return x.select("slot", *[F.round(c, 6).alias(k) for k, c in fx.delta_columns(LAGS).items()])


@query(GF + f" SELECT slot, {slopes_sql(SLOPES)} FROM grid")
def slope_features(spark, d):
    return made(spark, d, lambda df, w: fx.slope_columns(w, SLOPES), max(SLOPES))


@query("SELECT user_id AS series_id, CASE WHEN count(*) > 1 THEN round((avg(x * value) - avg(x) * avg(value)) / (avg(x * x) - avg(x) * avg(x)), 6) END AS slope FROM (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS x FROM events) t GROUP BY user_id")
def series_slope(spark, d):
    """Slopes over the row's number in its series; numbers over all series do, as a slope doesn't depend on where they begin."""
    e = stats.ranked(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value"), ["user_id", "event_id"], "x")
    return e.groupBy(F.col("user_id").alias("series_id")).agg(F.round(stats.slope("value", "x"), 6).alias("slope"))


@query(G + f" SELECT slot, round(avg(avg_load) {over(60)}, 6) AS mean_60, round(stddev_samp(avg_load) {over(60)}, 6) AS std_60 FROM grid")
def rolling_compare(spark, d):
    return made(spark, d, lambda df, w: {"mean_60": F.avg(TARGET).over(w.rowsBetween(-59, 0)), "std_60": F.stddev_samp(TARGET).over(w.rowsBetween(-59, 0))}, 59)


@query(G + " SELECT slot, round(ramp, 6) AS ramp FROM (SELECT slot, avg_load - lag(avg_load) OVER (ORDER BY slot) AS ramp FROM grid) x WHERE ramp IS NOT NULL")
def ramp_rate(spark, d):
    return made(spark, d, lambda df, w: {"ramp": F.col(TARGET) - F.lag(TARGET).over(w)}, 1).where("ramp is not null")


CAL = "CAST(CASE day_class WHEN 'none' THEN 0 WHEN 'half' THEN 1 ELSE 2 END AS INTEGER) AS workday, CAST(extract('year' FROM timestamp) AS INTEGER) AS year, CAST(extract('quarter' FROM timestamp) AS INTEGER) AS quarter, CAST(extract('month' FROM timestamp) AS INTEGER) AS month, CAST(extract('day' FROM timestamp) AS INTEGER) AS day, CAST(extract('dow' FROM timestamp) AS INTEGER) AS day_of_week, CAST(hour AS INTEGER) AS hour, CAST(floor((extract('month' FROM timestamp) % 12) / 3) + 1 AS INTEGER) AS season, CAST(CASE WHEN hour BETWEEN 6 AND 11 THEN 0 WHEN hour BETWEEN 12 AND 16 THEN 1 WHEN hour BETWEEN 17 AND 21 THEN 2 ELSE 3 END AS INTEGER) AS time_of_day"


@query(GC + f" SELECT slot, {CAL} FROM g")
def calendar_features(spark, d):
    return dense(spark, d).select("slot", *[c.alias(k) for k, c in calendar.calendar(F.col("timestamp"), F.col("day_class")).items()])


SILVER_COLUMNS = f"slot, timestamp, round(avg_load, 6) AS avg_load, day_class, {CAL}, " + ", ".join(f"round(lag(avg_load, {k}) OVER (ORDER BY slot), 6) AS lag_{k}" for k in LAGS) + f", {rolling_sql(ROLLING)}, " + ", ".join(f"round(lag(avg_load, {k}) OVER (ORDER BY slot) - lag(avg_load, 1) OVER (ORDER BY slot), 6) AS delta_{k}" for k in LAGS if k != 1) + f", {slopes_sql(SLOPES)}"
HOURLY = B + grid_sql(3600).replace("SELECT s.slot,", "SELECT s.slot, (SELECT a FROM bins_ends) AS first_slot,") + f", g AS (SELECT slot, first_slot, timestamp, avg_load, {CLASS} AS day_class, CAST(extract('hour' FROM timestamp) AS BIGINT) AS hour FROM grid), silver AS (SELECT {SILVER_COLUMNS} FROM g)"
QUARTER = HOURLY.replace("sec / 3600.0", f"sec / {STEP}.0").replace("slot * 3600", f"slot * {STEP}")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, digits(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def silver(spark: SparkSession, d: str, step: int = STEP) -> DataFrame:
    return fx.silver(bronze(spark, d), step)


@query(QUARTER + " SELECT * FROM silver")
def silver_features(spark, d):
    return rounded(silver(spark, d).drop("series_id"))


@query(QUARTER + " SELECT * FROM silver WHERE avg_load IS NOT NULL")
def gold_build(spark, d):
    return rounded(fx.gold(silver(spark, d)).drop("series_id"))


@query(QUARTER + " SELECT slot, avg_load, lag_1 FROM silver WHERE avg_load IS NOT NULL")
def gold_filter(spark, d):
    return rounded(fx.gold(silver(spark, d)).select("slot", TARGET, "lag_1"))


REQUIRED = Settings().required()


@query(QUARTER + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, count(*) AS n_rows, count(*) - count(avg_load) AS n_dropped, round(100.0 * (count(*) - count(avg_load)) / count(*), 6) AS pct FROM silver" for c in REQUIRED))
def gold_drop_report(spark, d):
    """For each required column its nulls, beside the rows that gold drops in all."""
    kept = F.lit(True)
    for c in REQUIRED:
        kept = kept & F.col(c).isNotNull()
    x = silver(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(~kept).alias("n_dropped"), *[F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED])
    return x.unpivot(["n_rows", "n_dropped"], REQUIRED, "column", "n_null").withColumn("pct", F.round(100.0 * F.col("n_dropped") / F.col("n_rows"), 6))


CASCADE = [f"lag_{k}" for k in LAGS] + [f"rolling_mean_{k}" for k in (5, 15, 60)] + ["slope_5", "delta_5"]


@query(QUARTER + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, '{c.split('_')[0]}' AS reason FROM silver" for c in CASCADE) + ") x WHERE n_null > 0 ORDER BY n_null DESC, \"column\" LIMIT 30")
def nan_cascade(spark, d):
    reason = F.when(F.col("column").startswith("lag_"), "lag").when(F.col("column").startswith("rolling_"), "rolling").when(F.col("column").startswith("slope_"), "slope").otherwise("delta")
    return src.null_counts(silver(spark, d), CASCADE, rate=False).withColumn("reason", reason).where("n_null > 0").orderBy(F.desc("n_null"), "column").limit(30)


@query(QUARTER + " SELECT count(*) AS n_checked, CAST(sum(CASE WHEN lag_1 IS DISTINCT FROM before THEN 1 ELSE 0 END) AS BIGINT) AS lag_wrong, CAST(sum(CASE WHEN abs(delta_5 - (fifth - before)) > 0.001 OR (delta_5 IS NULL) <> (fifth - before IS NULL) THEN 1 ELSE 0 END) AS BIGINT) AS delta_wrong, CAST(sum(CASE WHEN abs(rolling_mean_5 - m) > 0.001 OR (rolling_mean_5 IS NULL) <> (k < 5) THEN 1 ELSE 0 END) AS BIGINT) AS rolling_wrong FROM (SELECT lag_1, delta_5, rolling_mean_5, lag(avg_load) OVER o AS before, lag(avg_load, 5) OVER o AS fifth, avg(avg_load) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, count(avg_load) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k FROM silver WINDOW o AS (ORDER BY slot)) x")
def feature_validation(spark, d):
    """lag_1, delta_5 and rolling_mean_5 against the slots they name, by a join: how many are wrong."""
    s = silver(spark, d).select("series_id", "slot", TARGET, "lag_1", "delta_5", "rolling_mean_5")
    past = s.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), "slot", F.col(TARGET).alias("v")).withColumn("slot", F.col("slot") + F.col("k"))
    five = F.when(F.col("k") < 5, F.col("v"))
    g = past.groupBy("series_id", "slot").agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("before"), F.max(F.when(F.col("k") == 5, F.col("v"))).alias("fifth"), F.avg(five).alias("m"), F.count(five).alias("n"))
    off = lambda a, b: (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > 0.001, F.lit(False))
    c = F.col
    x = s.join(g, ["series_id", "slot"])
    return x.agg(F.count("*").alias("n_checked"), n(F.count_if(off(c("lag_1"), c("before"))), "lag_wrong"), n(F.count_if(off(c("delta_5"), c("fifth") - c("before"))), "delta_wrong"), n(F.count_if(off(c("rolling_mean_5"), F.when(c("n") == 5, c("m")))), "rolling_wrong"))


# ---- days, splits, model datasets


@query(B + " SELECT date, row_number() OVER (ORDER BY date) AS day_order FROM (SELECT DISTINCT date FROM bronze) x")
def day_order(spark, d):
    return fx.with_days(bronze(spark, d).drop("date")).select("date", n("day_order", "day_order")).distinct()


SPLIT = "CASE WHEN day_order <= 25 THEN 'train' WHEN day_order <= 28 THEN 'validate' WHEN day_order <= 31 THEN 'test' END AS split"
SPLITS = QUARTER + f", days AS (SELECT day_, row_number() OVER (ORDER BY day_) AS day_order FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS day_ FROM silver WHERE avg_load IS NOT NULL) x), parts AS (SELECT s.*, {SPLIT} FROM silver s JOIN days ON CAST(s.timestamp AS DATE) = day_ WHERE avg_load IS NOT NULL)"


@query(SPLITS + " SELECT split, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM parts GROUP BY split")
def chrono_split(spark, d):
    return fx.split(fx.gold(silver(spark, d))).groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def set_query(name: str, columns: tuple[str, ...]) -> None:
    """A feature set's dataset, with SQL that lists its columns."""

    def run(spark, d):
        return rounded(fx.model_dataset(fx.gold(silver(spark, d)), name))

    run.__name__ = "model_dataset" if name == "minimal" else f"model_dataset_{name}"
    query(SPLITS + f" SELECT split, timestamp, day_class, avg_load, {', '.join(columns)} FROM parts")(run)


set_query("minimal", ("workday", "hour", "lag_1"))
set_query("temporal", ("workday", "year", "quarter", "month", "day", "day_of_week", "hour", "season", "time_of_day", "lag_1"))
set_query("curated", ("workday", "hour", "season", "time_of_day", "lag_1", "lag_5", "lag_60", "lag_1440", "rolling_mean_15", "rolling_std_60", "slope_15"))


@query(SPLITS + " SELECT 'silver' AS layer, count(*) AS n_rows FROM silver UNION ALL SELECT 'gold', count(*) FROM parts UNION ALL SELECT 'model/' || split, count(*) FROM parts GROUP BY split")
def whole_run(spark, d):
    """Bronze to model datasets by the whole run, written layer by layer; the rows of each."""
    root = f"{src.shared_dir(spark)}/run-{uuid.uuid4().hex}"
    made = pipeline.build_all(bronze(spark, d).select("series_id", "timestamp", "day_class", "load"), root, "custom", ["15min"], ["minimal"])
    rows = [made[k].agg(F.lit(k.split("/")[0]).alias("layer"), F.count("*").alias("n_rows")) for k in ("silver/15min", "gold/15min")]
    model = made["model/15min/minimal"].groupBy(F.concat(F.lit("model/"), "split").alias("layer")).agg(F.count("*").alias("n_rows"))
    return src.union_all([*rows, model])


RAW_RUN = (
    B + ", raw AS (SELECT date, hour, avg(load) AS load FROM bronze GROUP BY 1, 2), cells AS (SELECT d.date, CAST(h AS BIGINT) AS hour, load, CAST(epoch(d.date + to_hours(CAST(h AS BIGINT))) AS BIGINT) // 900 AS slot FROM (SELECT DISTINCT date FROM bronze) d CROSS JOIN range(24) t(h) LEFT JOIN raw r ON r.date = d.date AND r.hour = h),"
    + " kept AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM cells WHERE load IS NOT NULL) x), parts AS (SELECT CASE WHEN k <= 25 THEN 'train' WHEN k <= 28 THEN 'validate' WHEN k <= 31 THEN 'test' END AS split FROM cells JOIN kept USING (date) WHERE load IS NOT NULL)"
    + " SELECT 'bronze' AS layer, count(*) AS n_rows, count(*) - count(load) AS n_null FROM cells UNION ALL SELECT 'silver', max(slot) - min(slot) + 1, max(slot) - min(slot) + 1 - count(load) FROM cells UNION ALL SELECT 'gold', count(load), CAST(0 AS BIGINT) FROM cells UNION ALL SELECT 'model/' || split, count(*), CAST(0 AS BIGINT) FROM parts WHERE split IS NOT NULL GROUP BY split"
)


@query(RAW_RUN)
def raw_run(spark, d):
    """All stages from a wide raw table, an hour to a row, and its labels; what was watched of each layer as it was written."""
    root = f"{src.shared_dir(spark)}/run-{uuid.uuid4().hex}"
    wide = wide_hours(spark, d).withColumn("second_of_day", F.col("hour_of_day") * 3600).drop("hour_of_day")
    labels = bronze(spark, d).select("date", F.upper("day_class").alias("day_class")).distinct()
    _, seen = pipeline.run(spark, root, "all", (wide, labels), None, "custom", ["15min"], ["minimal"], rows=24)
    b, s, g, m = (seen[k] for k in ("bronze", "silver/15min", "gold/15min", "model/15min/minimal"))
    rows = [("bronze", b["rows"], b["n_null"]), ("silver", s["rows"], s["rows"] - s["n_target"]), ("gold", g["rows"], 0)]
    rows += [(f"model/{k}", m[f"{k}_rows"], m[f"{k}_null_day_class"]) for k in Settings().splits if m[f"{k}_rows"]]
    return spark.createDataFrame(rows, "layer string, n_rows long, n_null long")


@query(SPLITS + ", x AS (SELECT split, CAST(timestamp AS DATE) AS date FROM parts), s AS (SELECT split, min(date) AS a, max(date) AS b, count(DISTINCT date) AS n FROM x GROUP BY split) SELECT p.split AS before, q.split AS after, p.n AS days_before, q.n AS days_after, (SELECT count(*) FROM (SELECT date FROM x WHERE split = p.split INTERSECT SELECT date FROM x WHERE split = q.split) y) AS shared, p.b < q.a AS in_order FROM s p JOIN s q ON p.a < q.a")
def split_order(spark, d):
    """For each two splits how many dates they share, and whether the earlier one ends before the later one begins."""
    x = fx.split(fx.gold(silver(spark, d))).groupBy("split", "date").count()
    s = x.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n"), F.collect_set("date").alias("dates"))  # three rows
    p, q = (s.withColumnsRenamed({c: f"{c}_{k}" for c in s.columns}) for k in "pq")
    both = p.join(F.broadcast(q), F.col("a_p") < F.col("a_q"))
    return both.select(F.col("split_p").alias("before"), F.col("split_q").alias("after"), F.col("n_p").alias("days_before"), F.col("n_q").alias("days_after"), F.size(F.array_intersect("dates_p", "dates_q")).cast("long").alias("shared"), (F.col("b_p") < F.col("a_q")).alias("in_order"))


CURATED = Settings().sets()["curated"]


@query(SPLITS + " SELECT split, column_ AS \"column\", n_before, n_after, first_ts, last_ts, n_null, round(CAST(n_null AS DOUBLE) / n_after, 6) AS null_rate FROM (" + " UNION ALL ".join(f"SELECT split, '{c}' AS column_, count(*) AS n_before, count(avg_load) AS n_after, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) - count({c}) AS n_null FROM parts GROUP BY split" for c in CURATED) + ") x")
def split_nulls(spark, d):
    """Of each split of the curated set: rows before and after those without target go, its bounds in time, and every column's nulls."""
    g = fx.split(fx.gold(silver(spark, d)))
    kept = F.col(TARGET).isNotNull()
    ts = F.when(kept, F.col("timestamp"))
    x = g.groupBy("split").agg(F.count("*").alias("n_before"), F.count(TARGET).alias("n_after"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *[F.count_if(kept & F.col(c).isNull()).alias(c) for c in CURATED])
    long = x.unpivot(["split", "n_before", "n_after", "first_ts", "last_ts"], list(CURATED), "column", "n_null")
    return long.withColumn("null_rate", F.round(F.col("n_null") / F.col("n_after"), 6))


@query(SPLITS + " SELECT split, count(*) AS n_rows, round(avg(avg_load), 3) AS mean, round(stddev_samp(avg_load), 3) AS std, round(min(avg_load), 3) AS low, round(max(avg_load), 3) AS high, count(*) - count(lag_15) AS null_lag_15 FROM parts GROUP BY split")
def split_profile(spark, d):
    x, t = fx.split(fx.gold(silver(spark, d))), F.round(F.col(TARGET), 6)
    return x.groupBy("split").agg(F.count("*").alias("n_rows"), F.round(F.avg(t), 3).alias("mean"), F.round(F.stddev_samp(t), 3).alias("std"), F.round(F.min(t), 3).alias("low"), F.round(F.max(t), 3).alias("high"), (F.count("*") - F.count("lag_15")).alias("null_lag_15"))


PEAK = "SELECT split, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse FROM {} GROUP BY split"


@query(SPLITS + ", f AS (SELECT split, avg_load AS y, lag_1 AS p FROM parts WHERE lag_1 IS NOT NULL) " + PEAK.format("f"))
def persistence_metrics(spark, d):
    x = fx.split(fx.gold(silver(spark, d))).select("split", F.round(TARGET, 6).alias("y"), F.round("lag_1", 6).alias("p"))
    return stats.errors(x.where("p is not null"), ["split"])


@query(SPLITS + ", f AS (SELECT split, CAST(timestamp AS DATE) AS day_, avg_load AS y, lag_1 AS p FROM parts WHERE lag_1 IS NOT NULL), k AS (SELECT split, day_, abs(max(y) - max(p)) AS peak, abs(sum(y) - sum(p)) AS energy FROM f GROUP BY split, day_) SELECT split, round(avg(peak), 3) AS peak_error, round(avg(energy), 2) AS energy_error FROM k GROUP BY split")
def forecast_metrics(spark, d):
    x = fx.split(fx.gold(silver(spark, d))).select("split", "date", F.round(TARGET, 6).alias("y"), F.round("lag_1", 6).alias("p")).where("p is not null")
    per = x.groupBy("split", "date").agg(F.abs(F.max("y") - F.max("p")).alias("peak"), F.abs(F.sum("y") - F.sum("p")).alias("energy"))
    return per.groupBy("split").agg(F.round(F.avg("peak"), 3).alias("peak_error"), F.round(F.avg("energy"), 2).alias("energy_error"))


def normal_sql(xs: tuple[str, str, str]) -> str:
    """Least squares on three columns by Cramer's rule, around the means of the training rows."""
    v = {c: f"({c} - m_{c})" for c in (*xs, "y")}
    pairs = {f"{a}_{b}": f"sum({v[a]} * {v[b]})" for i, a in enumerate((*xs, "y")) for b in (*xs, "y")[i:]}
    a, b, c = xs
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    gram = [[f"{a}_{a}", f"{a}_{b}", f"{a}_{c}"], [f"{a}_{b}", f"{b}_{b}", f"{b}_{c}"], [f"{a}_{c}", f"{b}_{c}", f"{c}_{c}"]]
    right = [f"{x}_y" for x in xs]
    weights = [f"{det([[right[i] if j == k else gram[i][j] for j in range(3)] for i in range(3)])} / {det(gram)} AS w_{x}" for k, x in enumerate(xs)]
    fit = "m_y + " + " + ".join(f"w_{x} * {v[x]}" for x in xs)
    return (
        f", u AS (SELECT split, avg_load AS y, {', '.join(f'CAST({x} AS DOUBLE) AS {x}' for x in xs)} FROM parts WHERE {' AND '.join(f'{x} IS NOT NULL' for x in xs)}),"
        f" mean AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in v)} FROM u WHERE split = 'train'), s AS (SELECT {', '.join(f'{e} AS {k}' for k, e in pairs.items())} FROM u, mean WHERE split = 'train'),"
        f" w AS (SELECT {', '.join(weights)} FROM s), f AS (SELECT split, y, {fit} AS p FROM u, mean, w) "
    )


@query(SPLITS + normal_sql(("workday", "hour", "lag_1")) + PEAK.format("f"))
def linear_metrics(spark, d):
    x = rounded(fx.model_dataset(fx.gold(silver(spark, d)), "minimal"))
    return stats.linear_forecast(x, TARGET, list(Settings().sets()["minimal"]))


@query()
def hypothesis_table(spark, d):
    """The three hypotheses on gold tables of one and five minutes, both folded from one table of bins."""
    parts = src.settled(fx.states(bronze(spark, d), 60))
    gold = {step: src.settled(fx.gold(fx.silver_of(fx.grid(fx.folded(parts, 60, [step]).drop("step"), step)))) for step in (60, 300)}
    return hypotheses.table(gold)


@query(B + " SELECT timestamp, day_class, round(load, 6) AS load FROM (SELECT date + to_hours(hour) AS timestamp, min(day_class) AS day_class, avg(load) AS load FROM bronze GROUP BY date, hour) x")
def bronze_build(spark, d):
    seconds = wide_hours(spark, d).withColumn("second_of_day", F.col("hour_of_day") * 3600).drop("hour_of_day")
    built = src.build(seconds, bronze(spark, d).select("date", "day_class").distinct())
    there = bronze(spark, d).select(calendar.start(calendar.slot(F.col("timestamp"), 3600), 3600).alias("timestamp")).distinct()
    return rounded(built.join(there, "timestamp", "left_semi"))
