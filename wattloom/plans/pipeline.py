"""The whole run: raw to bronze, silver, gold and model datasets for several resolutions, with the guards in the jobs that write them."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as fx
from ..sources import bronze as src
from .settings import DAY_CLASSES, RESOLUTIONS, TARGET, Settings, canonical_resolution, layer_path, resolutions


def guard_raw(wide: DataFrame, labels: DataFrame, key: str = "second_of_day", rows: int = 86_400) -> DataFrame:
    """``wide``, or ValueError: it needs ``rows`` distinct keys, at least one day, only numbers, and as many labelled days, each labelled once and with a known class."""
    days = [f for f in wide.schema.fields if f.name != key]
    wrong = [f"{f.name} is not numeric" for f in days if not isinstance(f.dataType, T.NumericType)]
    if not days:
        wrong.append("no day columns")
    row = wide.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).first()
    if row["n"] != rows or row["keys"] != rows:
        wrong.append(f"{row['n']} rows and {row['keys']} keys instead of {rows}")
    own = labels.agg(F.count("*").alias("n"), F.countDistinct("date").alias("dates")).first()
    if own["n"] != own["dates"] or own["n"] != len(days):
        wrong.append(f"{own['n']} labels of {own['dates']} dates for {len(days)} days")
    if wrong:
        raise ValueError("; ".join(wrong))
    guard_classes(labels)
    return wide


def guard_classes(df: DataFrame) -> DataFrame:
    """``df``, or ValueError naming up to ten classes that are unknown or missing."""
    bad = src.domain_violations(df, "day_class", list(DAY_CLASSES)).limit(10).collect()
    if bad:
        raise ValueError(f"unexpected day classes: {[r['day_class'] for r in bad]}")
    return df


def guard_matched(series: DataFrame, labels: DataFrame) -> DataFrame:
    """``series``, or ValueError naming the first ten dates without a label."""
    bad = src.unmatched(series, labels).orderBy("date").limit(10).collect()
    if bad:
        raise ValueError(f"dates without a label: {[str(r['date']) for r in bad]}")
    return series


def guard_schema(df: DataFrame, settings: Settings) -> DataFrame:
    """``df``, or ValueError where its columns aren't exactly the schema's, in order; series_id and slot may stand before."""
    own, want = [c for c in df.columns if c not in ("series_id", "slot")], settings.columns()
    if own != want:
        raise ValueError(f"columns are missing: {[c for c in want if c not in own]}, unexpected: {[c for c in own if c not in want]}, or in another order")
    return df


def calendar_watch() -> dict[str, Column]:
    return {"n_outside": F.count_if(F.expr("not coalesce(month between 1 and 12 and hour between 0 and 23 and workday between 0 and 2, false)"))}


def null_watch(columns: list[str]) -> dict[str, Column]:
    return {f"null_{c}": F.count_if(F.col(c).isNull()) for c in columns}


def class_watch() -> dict[str, Column]:
    bad = ~F.coalesce(F.col("day_class").isin(*DAY_CLASSES), F.lit(False))
    return {"n_bad": F.count_if(bad), "bad": F.min(F.when(bad, F.col("day_class")))}


def check(seen: dict, layer: str) -> dict:
    """``seen``, the aggregates watched while ``layer`` was written; ValueError if they tell of nulls, fields out of range or unknown classes."""
    wrong = []
    if bad := {k.removeprefix("null_"): v for k, v in seen.items() if k.startswith("null_") and v}:
        wrong.append(f"nulls in {bad}")
    if seen.get("n_outside"):
        wrong.append(f"month, hour or workday out of range in {seen['n_outside']} rows")
    if seen.get("n_bad"):
        wrong.append(f"unexpected day classes in {seen['n_bad']} rows, such as {seen['bad']!r}")
    if seen.get("n_unmatched"):
        wrong.append(f"{seen['n_unmatched']} rows of dates without a label, from {seen['unmatched']}")
    if seen.get("n_there") == 0:
        wrong.append("no load at all")
    if wrong:
        raise ValueError(f"{layer}: " + "; ".join(wrong))
    return seen


def guard_calendar(df: DataFrame) -> DataFrame:
    """``df``, or ValueError where a month, hour or class code lies outside its range."""
    check(df.agg(*[c.alias(k) for k, c in calendar_watch().items()]).first().asDict(), "table")
    return df


def guard_splits(seen: dict, splits: list[str]) -> None:
    """ValueError where the days of a split, by their order, don't all lie behind those of the split before."""
    spans = [(k, seen[f"{k}_from"], seen[f"{k}_to"]) for k in splits if seen[f"{k}_from"] is not None]
    for (a, _, end), (b, start, _) in zip(spans, spans[1:], strict=False):
        if end >= start:
            raise ValueError(f"days of {b} don't all come after those of {a}")


STAGES = ("bronze", "silver", "gold", "model")


def stages_of(stages: str | list[str]) -> list[str]:
    """``all``, one stage, or several, in the order of the run."""
    chosen = list(STAGES) if stages == "all" else [stages] if isinstance(stages, str) else stages
    if wrong := [x for x in chosen if x not in STAGES]:
        raise ValueError(f"{wrong} are no stages; there are {list(STAGES)}")
    return [x for x in STAGES if x in chosen]


def split_watch(s: Settings, columns: list[str]) -> dict[str, Column]:
    """For each split its rows, with and without target, first and last time and day, and each column's nulls."""
    out: dict[str, Column] = {}
    for k in s.splits:
        own = F.col("split") == k
        kept = own & F.col(TARGET).isNotNull()
        out |= {f"{k}_before": F.count_if(own), f"{k}_rows": F.count_if(kept), f"{k}_first": F.min(F.when(kept, F.col("timestamp"))), f"{k}_last": F.max(F.when(kept, F.col("timestamp")))}
        out |= {f"{k}_from": F.min(F.when(own, F.col("day_order"))), f"{k}_to": F.max(F.when(own, F.col("day_order")))}
        out |= {f"{k}_{name}": f(F.when(kept, F.col(TARGET))) for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("low", F.min), ("high", F.max))}
        out |= {f"{k}_null_{c}": F.count_if(kept & F.col(c).isNull()) for c in columns}
    return out


def raw_to_bronze(wide: DataFrame, labels: DataFrame, root: str, settings: Settings | None = None, key: str = "second_of_day", rows: int = 86_400) -> dict:
    """Writes the bronze layer of a wide raw table and its labels (date, day_class); what was watched meanwhile.

    The table must pass ``guard_raw``, and every date must have a label of a known class. Infinite and missing loads are null, loads outside
    the physical range stay and are counted.
    """
    s = settings or Settings()
    own = src.labels(labels)
    guard_raw(wide, labels.select("date", F.lower(F.trim("day_class")).alias("day_class")), key, rows)
    built = src.build(wide, own, key).withColumn("series_id", F.lit("0"))
    load, there = F.col("load"), F.count("load")
    watch = {
        "rows": F.count("*"), "n_there": there, "n_null": F.count("*") - there, "n_implausible": F.count_if(~load.between(*s.physical)), "low": F.min(load), "high": F.max(load), "mean": F.avg(load),
        "first": F.min("timestamp"), "last": F.max("timestamp"), "n_unmatched": F.count_if(F.col("day_class").isNull()), "unmatched": F.min(F.when(F.col("day_class").isNull(), F.to_date("timestamp"))),
    } | class_watch()
    seen = src.write_layer(built.select("series_id", "timestamp", "day_class", "load"), f"{root}/bronze", watch=watch)
    if seen["n_unmatched"]:  # names the dates
        guard_matched(src.melt(wide, key).select("date"), own)
    check(seen, "bronze")
    if seen["rows"] != rows * (len(wide.columns) - 1):
        raise ValueError(f"bronze: {seen['rows']} rows instead of {rows * (len(wide.columns) - 1)}")
    return seen


def run(
    spark: SparkSession, root: str, stages: str | list[str] = "all", raw: tuple[DataFrame, DataFrame] | None = None, bronze: DataFrame | None = None, mode: str = "default", custom: list[str] | None = None,
    sets: list[str] | None = None, settings: Settings | None = None, dry_run: bool = False, key: str = "second_of_day", rows: int = 86_400,
) -> tuple[dict[str, DataFrame], dict[str, dict]]:
    """Runs ``stages`` and returns the layers written below ``root`` and what was watched of each, by layer and resolution (and set).

    Stages that aren't run are taken from where an earlier run wrote them. ``raw``: wide table and labels, for the bronze stage; ``bronze``: a
    series (series_id, timestamp, day_class, load) in place of that stage. The bronze layer is read once for all resolutions: its bins' sums at the finest step that
    divides all are a layer of their own, from which every resolution is folded. Each layer is written in one job, with its guards in it; where one fails
    ValueError stops the run, before a later layer is made of what was written. ``dry_run`` checks settings and inputs only.
    """
    s = settings or Settings()
    s.validate()
    chosen, sets = stages_of(stages), list(s.sets()) if sets is None else sets
    names = [canonical_resolution(x) for x in resolutions(mode, custom)]
    if "bronze" in chosen and bronze is None and raw is None:
        raise ValueError("the bronze stage needs a raw table")
    if bronze is not None:
        src.require(bronze, ["series_id", *src.REQUIRED])
        chosen = [x for x in chosen if x != "bronze"]
    layers: dict[str, DataFrame] = {}
    seen: dict[str, dict] = {}
    if dry_run:
        if bronze is None and raw is None and "silver" in chosen:
            spark.read.parquet(f"{root}/bronze")
        if raw is not None:
            guard_raw(raw[0], raw[1].select("date", F.lower(F.trim("day_class")).alias("day_class")), key, rows)
        if "gold" in chosen and "silver" not in chosen:
            for x in names:
                spark.read.parquet(layer_path(root, "silver", x))
        return layers, seen
    if "bronze" in chosen:
        seen["bronze"] = raw_to_bronze(*raw, root, s, key, rows)
        layers["bronze"] = spark.read.parquet(f"{root}/bronze")
    steps = {x: RESOLUTIONS[x] for x in names}
    if "silver" in chosen:
        fine = gcd(*steps.values())
        source = bronze if bronze is not None else spark.read.parquet(f"{root}/bronze")
        watch = {"rows": F.sum("n_rows"), "n_there": F.coalesce(F.sum("n"), F.lit(0)), "n_bad": F.sum("n_bad"), "bad": F.min("bad")}
        found = src.write_layer(fx.states(source, fine), f"{root}/states", watch=watch, order=("series_id", "slot"))
        seen["states"] = check(found, "bronze")
        seen["states"]["pct"] = 100.0 * (found["rows"] - found["n_there"]) / found["rows"]
        seen["states"]["warn"] = seen["states"]["pct"] > s.drop_warning_pct
        parts = spark.read.parquet(f"{root}/states")
        for x, step in steps.items():
            dense = fx.grid(fx.folded(parts, fine, [step]).drop("step"), step)
            made = guard_schema(fx.silver_of(dense, s), s)
            watch = {"rows": F.count("*"), "n_target": F.count(TARGET)} | null_watch([c for c in s.required() if c != TARGET]) | calendar_watch()
            seen[f"silver/{x}"] = check(src.write_layer(made, layer_path(root, "silver", x), watch=watch), f"silver/{x}")
            layers[f"silver/{x}"] = spark.read.parquet(layer_path(root, "silver", x))
    for x in steps:
        if "gold" in chosen:
            silver = guard_schema(spark.read.parquet(layer_path(root, "silver", x)), s)
            before = Observation()
            made = fx.gold(silver.observe(before, F.count("*").alias("before")), s)
            found = src.write_layer(made, layer_path(root, "gold", x), watch={"rows": F.count("*")} | class_watch(), dealt=True) | before.get
            seen[f"gold/{x}"] = check(found, f"gold/{x}")
            layers[f"gold/{x}"] = spark.read.parquet(layer_path(root, "gold", x))
        if "model" in chosen:
            gold = spark.read.parquet(layer_path(root, "gold", x))
            for k in sets:
                columns, path = fx.model_columns(gold, k, s), layer_path(root, "model", x, k)
                counted = Observation()
                rows_of = fx.split(gold, s).select("split", *columns, "day_order").observe(counted, *[c.alias(n) for n, c in split_watch(s, [c for c in columns if c not in ("timestamp", TARGET)]).items()])
                src.write_layer(rows_of.drop("day_order").na.drop(subset=[TARGET]), path, ("split",), dealt=True)
                seen[f"model/{x}/{k}"] = counted.get
                guard_splits(counted.get, list(s.splits))
                layers[f"model/{x}/{k}"] = spark.read.schema(rows_of.drop("day_order").schema).parquet(path)
    return layers, seen


def build_all(bronze: DataFrame, root: str, mode: str = "default", custom: list[str] | None = None, sets: list[str] | None = None, settings: Settings | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
    """The stages from silver on, of a bronze series; the layers written below ``root``, by layer and resolution (and set)."""
    return run(bronze.sparkSession, root, ["silver", "gold", "model"], None, bronze, mode, custom, sets, settings, dry_run)[0]
