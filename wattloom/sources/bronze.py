"""Bronze series: reading, contracts of wide raw tables, labels, and the Parquet sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar

REQUIRED = ("timestamp", "day_class", "load")


def require(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """``df``, or ValueError naming the columns that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    df = require(spark.read.parquet(path), REQUIRED)
    return clean(df if "series_id" in df.columns else df.withColumn("series_id", F.lit("0")))


def clean(df: DataFrame, column: str = "load") -> DataFrame:
    """NaN and infinities become null, once and for all."""
    x = F.col(column)
    return df.withColumn(column, F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x))


def melt(wide: DataFrame, key: str = "second_of_day") -> DataFrame:
    """Day columns named by date to rows (date, ``key``, load); every column but ``key`` is a day."""
    days = [c for c in wide.columns if c != key]
    if not days:
        raise ValueError("no day columns")
    return wide.unpivot([key], days, "date", "load").withColumn("date", F.col("date").cast("date"))


def timestamped(long: DataFrame, key: str = "second_of_day") -> DataFrame:
    at = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(key).cast("decimal(18,6)"))
    return long.withColumn("timestamp", at)


def contract(wide: DataFrame, key: str, rows: int) -> DataFrame:
    """One row: what a wide raw table must be (n_rows = ``rows``, at least one day, keys distinct)."""
    days = [c for c in wide.columns if c != key]
    return wide.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.lit(len(days)).cast("long").alias("n_days")).withColumn("valid", (F.col("n_rows") == rows) & (F.col("n_keys") == rows) & (F.col("n_days") > 0))


def labels(df: DataFrame) -> DataFrame:
    """Day labels (date, day_class), trimmed and lower-cased, with how often a date comes."""
    own = df.select(F.col("date").cast("date").alias("date"), F.lower(F.trim("day_class")).alias("day_class"))
    return own.groupBy("date").agg(F.min("day_class").alias("day_class"), F.count("*").alias("n"))


def label_join(series: DataFrame, day_labels: DataFrame) -> DataFrame:
    """Series with the class of its date; Spark broadcasts the labels where they are small."""
    return series.drop("day_class").join(day_labels.select("date", "day_class"), "date", "left")


def unmatched(series: DataFrame, day_labels: DataFrame) -> DataFrame:
    return series.select("date").distinct().join(day_labels, "date", "left_anti")


def build(wide: DataFrame, day_labels: DataFrame, key: str = "second_of_day") -> DataFrame:
    """Raw to bronze: melt, timestamps, infinities to null, labels by date."""
    long = clean(timestamped(melt(wide, key), key))
    return label_join(long, day_labels).select("timestamp", "day_class", "load")


#: Where a session names no folder and Spark runs on this machine alone.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the session names as spark.checkpoint.dir; on a cluster there must be one, as executors don't see each other's own."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return own or FALLBACK_DIR


def settled(df: DataFrame) -> DataFrame:
    """Runs ``df`` once and keeps its rows in the shared folder: what follows doesn't run it again, and a lost executor costs no rerun of what lies before."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def write_layer(df: DataFrame, path: str, by: tuple[str, ...] = (), watch: dict[str, Column] | None = None, order: tuple[str, ...] = ("timestamp",), dealt: bool = False) -> dict:
    """One directory for each value of ``by``; within them files hold ranges of ``order``, sorted, so that scans prune by statistics.

    ``dealt``: rows stay in the partitions they have, as those of a layer that lies in ranges already. ``watch``: aggregates, by name, that are
    taken of the rows as they are written, in the same job; returned with their values. They are observed in the job's last
    stage, above every exchange, so that no row counts twice.
    """
    out = df if dealt else df.repartitionByRange(*by, *order)
    out = out.sortWithinPartitions(*by, *order)
    seen = Observation() if watch else None
    if watch:
        out = out.observe(seen, *[c.alias(k) for k, c in watch.items()])
    (out.write.mode("overwrite").partitionBy(*by) if by else out.write.mode("overwrite")).parquet(path)
    return seen.get if watch else {}


def content_hash(df: DataFrame) -> DataFrame:
    """One row: the number of rows and a hash of their content that doesn't depend on order or files."""
    parts = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n_rows"), F.sum(parts.cast("decimal(38,0)")).cast("string").alias("content"))


def manifest(df: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """(by, n_rows, content) of each part of a layer: how many rows, and the sum of their hashes.

    Sums don't depend on the order of rows, on partitions or on files. Fractions are rounded first, as sums of floating numbers differ
    in their last digits with the order in which they are added up; -0 is 0.
    """
    shown = [(F.round(F.col(c), digits) + F.lit(0.0)) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    empty = [F.col(c).isNull() for c in sorted(df.columns)]  # a hash skips nulls
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*shown, *empty).cast("decimal(38,0)")).cast("string").alias("content"))


def compared(one: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, n_other, content, equal): two manifests side by side; parts that only one of them has are unequal, with 0 rows on the other side."""
    b = other.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("n_rows").alias("n_other"), F.col("content").alias("content_of"))
    met = one.join(b, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]), "full_outer")
    equal = F.coalesce((F.col("content") == F.col("content_of")) & (F.col("n_rows") == F.col("n_other")), F.lit(False))
    keys = [F.when(F.col("content").isNull(), F.col(f"{c}_of")).otherwise(F.col(c)).alias(c) for c in by]
    return met.select(*keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_other", F.lit(0)).alias("n_other"), F.coalesce("content", "content_of").alias("content"), equal.alias("equal"))


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame, columns: list[str], rate: bool = True) -> DataFrame:
    """(column, n_null, null_rate) in one pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot(["n"], columns, "column", "n_null")
    return long.select("column", "n_null", F.round(F.col("n_null") / F.col("n"), 6).alias("null_rate")) if rate else long.select("column", "n_null")


def from_events(events: DataFrame, by_user: bool = False) -> DataFrame:
    """The events table as bronze: every 50th load is missing, every 97th is 0."""
    load = F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_id") % 97 == 0, 0.0).otherwise(F.col("value"))
    sid = F.col("user_id").cast("string") if by_user else F.lit("0")
    return events.select(sid.alias("series_id"), F.col("event_id"), F.col("ts").alias("timestamp"), F.col("ts").cast("date").alias("date"), calendar.day_class(F.col("ts")).alias("day_class"), load.alias("load"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
