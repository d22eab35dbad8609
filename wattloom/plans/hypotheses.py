"""Claims about feature sets and resolutions, each decided by one metric, one split and one target of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fx
from ..operators import stats
from ..sources.bronze import union_all
from .settings import TARGET, Settings


@dataclass(frozen=True)
class Hypothesis:
    """``arm`` against ``base``, each a feature set and a step in seconds: the metric's change in percent must not exceed ``most``."""

    name: str
    metric: str
    split: str
    base: tuple[str, int]
    arm: tuple[str, int]
    most: float


# What is compared, on which split, and what must be reached.
HYPOTHESES = (
    Hypothesis("H1", "mae", "validate", ("temporal", 300), ("minimal", 300), -10.0),
    Hypothesis("H2", "rmse", "validate", ("temporal", 300), ("curated", 300), -8.0),
    Hypothesis("H3", "mae", "test", ("minimal", 60), ("minimal", 300), 5.0),
)


def compared(gold: dict[int, DataFrame], h: Hypothesis, settings: Settings) -> DataFrame:
    """(split, y, base, arm): both sides' forecasts by linear regression, where both have all their features.

    Sides of the same step are compared row by row. Of different steps, the finer one's forecasts and truth are averaged over the
    bins of the coarser, so that both are held against the same loads.
    """
    sides = {}
    for name, (kind, step) in (("base", h.base), ("arm", h.arm)):
        columns = list(settings.sets()[kind])
        data = fx.split(gold[step], settings)
        fit = stats.linear_fit(data, TARGET, columns)
        sides[name] = data.na.drop(subset=[*columns, TARGET]).select("series_id", "slot", "split", F.col(TARGET).alias("y"), fit.alias(name))
    wide = max(h.base[1], h.arm[1])
    for name, (_, step) in (("base", h.base), ("arm", h.arm)):
        if step < wide:
            slot = F.floor(F.col("slot") * step / wide).cast("long").alias("slot")
            sides[name] = sides[name].groupBy("series_id", slot, "split").agg(F.avg("y").alias("y"), F.avg(name).alias(name))
    truth = "arm" if h.arm[1] == wide else "base"
    other = sides["base" if truth == "arm" else "arm"].drop("y")
    return sides[truth].join(other, ["series_id", "slot", "split"]).select("split", "y", "base", "arm")


def table(gold: dict[int, DataFrame], settings: Settings | None = None, hypotheses: tuple[Hypothesis, ...] = HYPOTHESES) -> DataFrame:
    """(hypothesis, metric, split, base, arm, n, base_value, arm_value, change_pct, target_pct, passed), one row for each; ``gold``: gold tables by step."""
    s = settings or Settings()
    rows = []
    for h in hypotheses:
        off = {c: F.col("y") - F.col(c) for c in ("base", "arm")}
        value = {c: F.avg(F.abs(e)) if h.metric == "mae" else F.sqrt(F.avg(e * e)) for c, e in off.items()}
        x = compared(gold, h, s).where(F.col("split") == h.split).agg(F.count("*").alias("n"), *[v.alias(f"{c}_value") for c, v in value.items()])
        change = 100 * (F.col("arm_value") / F.nullif("base_value", F.lit(0.0)) - 1)
        told = {"hypothesis": h.name, "metric": h.metric, "split": h.split, "base": f"{h.base[0]} {h.base[1]} s", "arm": f"{h.arm[0]} {h.arm[1]} s"}
        rows.append(x.select(*[F.lit(v).alias(k) for k, v in told.items()], "n", *[F.round(f"{c}_value", 6).alias(f"{c}_value") for c in value], F.round(change, 4).alias("change_pct"), F.lit(h.most).alias("target_pct"), F.coalesce(change <= h.most, F.lit(False)).alias("passed")))
    return union_all(rows)
