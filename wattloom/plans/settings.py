"""The settings that define semantics, and the schemas that follow from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values of the data model: resolutions in seconds, aliases, windows in periods, class codes.
RESOLUTIONS = {"1s": 1, "5s": 5, "10s": 10, "30s": 30, "1min": 60, "5min": 300, "10min": 600, "15min": 900}
ALIASES = {"60s": "1min", "1m": "1min", "5m": "5min", "10m": "10min", "15m": "15min"}
SUFFIXES = {"1s": "1s", "5s": "5s", "10s": "10s", "30s": "30s", "1min": "1m", "5min": "5m", "10min": "10m", "15min": "15m"}
DEFAULTS = ("1min", "5min", "10min", "15min")
LAGS = (1, 5, 15, 60, 1440)
ROLLING = (5, 15, 60, 240, 1440)
SLOPES = (5, 15, 60)
DAY_CLASSES = {"none": 0, "half": 1, "full": 2}
SPLITS = {"train": (1, 25), "validate": (26, 28), "test": (29, 31)}
TARGET = "avg_load"
CALENDAR = ("workday", "year", "quarter", "month", "day", "day_of_week", "hour", "season", "time_of_day")


@dataclass(frozen=True)
class Settings:
    lags: tuple[int, ...] = LAGS
    rolling: tuple[int, ...] = ROLLING
    slopes: tuple[int, ...] = SLOPES
    splits: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(SPLITS))
    drop_warning_pct: float = 5.0
    physical: tuple[float, float] = (0.0, 100_000.0)
    feature_sets: dict[str, tuple[str, ...]] | None = None

    def columns(self) -> list[str]:
        """The columns of silver and gold, in order."""
        rolling = [f"rolling_{s}_{n}" for n in self.rolling for s in ("mean", "std", "max", "min")]
        return ["timestamp", TARGET, "day_class", *CALENDAR, *(f"lag_{k}" for k in self.lags), *rolling, *(f"delta_{k}" for k in self.lags if k != 1), *(f"slope_{n}" for n in self.slopes)]

    def schema(self) -> T.StructType:
        kinds = {"timestamp": T.TimestampNTZType(), "day_class": T.StringType(), **dict.fromkeys(CALENDAR, T.IntegerType())}
        return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in self.columns()])

    def sets(self) -> dict[str, tuple[str, ...]]:
        if self.feature_sets is not None:
            return self.feature_sets
        return {
            # fixed values
            "minimal": ("workday", "hour", "lag_1"),
            "temporal": ("workday", "year", "quarter", "month", "day", "day_of_week", "hour", "season", "time_of_day", "lag_1"),
            "curated": ("workday", "hour", "season", "time_of_day", "lag_1", "lag_5", "lag_60", "lag_1440", "rolling_mean_15", "rolling_std_60", "slope_15"),
            "full": tuple(c for c in self.columns() if c not in ("timestamp", "day_class", TARGET)),
        }

    def required(self) -> list[str]:
        """What gold rows must have."""
        return ["timestamp", TARGET, "day_class", *CALENDAR]

    def history(self) -> int:
        """Slots before a row that its features look at."""
        return max([*self.lags, *(n - 1 for n in self.rolling), *self.slopes])

    def validate(self) -> None:
        """Raises ValueError with everything that is wrong."""
        wrong = [f"{name} must be positive" for name, v in (("lags", self.lags), ("rolling", self.rolling), ("slopes", self.slopes)) if not v or min(v) < 1]
        if 1 not in self.lags:
            wrong.append("lags must contain 1")
        if not 0 <= self.drop_warning_pct <= 100:
            wrong.append("drop_warning_pct must be from 0 to 100")
        known = set(self.columns())
        for name, columns in self.sets().items():
            if TARGET in columns:
                wrong.append(f"feature set {name} holds the target")
            if missing := set(columns) - known:
                wrong.append(f"feature set {name} names {sorted(missing)}")
        spans = sorted(self.splits.values())
        if any(a < 1 or b < a for a, b in spans) or any(y[0] != x[1] + 1 for x, y in zip(spans, spans[1:], strict=False)):
            wrong.append("splits must be positive, without overlap or gap")
        if wrong:
            raise ValueError("; ".join(wrong))


def canonical_resolution(name: str) -> str:
    name = ALIASES.get(name.strip().lower(), name.strip().lower())
    if name not in RESOLUTIONS:
        raise ValueError(f"resolution {name!r} is not one of {list(RESOLUTIONS)}")
    return name


def layer_path(root: str, layer: str, resolution: str, *more: str) -> str:
    """Folder of a layer's table at a resolution, named by its suffix; feature set and split may follow."""
    return "/".join([root.rstrip("/"), layer, SUFFIXES[canonical_resolution(resolution)], *more])


def resolutions(mode: str = "default", custom: list[str] | None = None) -> list[str]:
    """Ordered, without repeats."""
    chosen = {"all": list(RESOLUTIONS), "default": list(DEFAULTS), "custom": custom or []}[mode]
    if not chosen:
        raise ValueError("no resolution chosen")
    return list(dict.fromkeys(map(canonical_resolution, chosen)))
