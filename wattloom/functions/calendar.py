"""Calendar expressions of a bin's start, and slot arithmetic that doesn't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.settings import DAY_CLASSES


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def slot(ts: Column, step: int) -> Column:
    """Number of the left-closed bin of ``step`` seconds; bins start at midnight where ``step`` divides a day."""
    return F.floor(seconds(ts) / step).cast("long")


def start(slot_: Column, step: int) -> Column:
    """The timestamp at which a bin starts."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (slot_ * step).cast("decimal(18,6)"))


def day_class(ts: Column) -> Column:
    """full on weekdays, half on Saturday, none on Sunday: the rule where no label table is given."""
    return F.when(F.dayofweek(ts) == 1, "none").when(F.dayofweek(ts) == 7, "half").otherwise("full")


def workday(label: Column) -> Column:
    code = F.lit(None).cast("int")
    for name, value in DAY_CLASSES.items():
        code = F.when(label == name, value).otherwise(code)
    return code.cast("int")


def season(month: Column) -> Column:
    return (F.floor((month % 12) / 3) + 1).cast("int")


def time_of_day(hour: Column) -> Column:
    return F.when(hour.between(6, 11), 0).when(hour.between(12, 16), 1).when(hour.between(17, 21), 2).otherwise(3).cast("int")


def calendar(ts: Column, label: Column) -> dict[str, Column]:
    """Column by name, in schema order."""
    return {
        "workday": workday(label), "year": F.year(ts), "quarter": F.quarter(ts), "month": F.month(ts), "day": F.dayofmonth(ts),
        "day_of_week": (F.dayofweek(ts) - 1).cast("int"), "hour": F.hour(ts), "season": season(F.month(ts)), "time_of_day": time_of_day(F.hour(ts)),
    }
