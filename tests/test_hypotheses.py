import datetime as dt
import math
import random

import numpy as np
import pytest

from wattloom.operators import features as fx
from wattloom.plans import hypotheses
from wattloom.plans.settings import TARGET, Settings

T0 = dt.datetime(2025, 1, 1)
SETTINGS = Settings(lags=(1, 5), rolling=(2,), slopes=(2,), splits={"train": (1, 2), "validate": (3, 3), "test": (4, 4)}, feature_sets={"temporal": ("hour", "workday", "lag_1"), "minimal": ("workday", "lag_1"), "curated": ("hour", "workday", "lag_1", "lag_5")})


def fitted(rows, columns):
    own = [r for r in rows if all(r[c] is not None for c in columns)]
    train = [r for r in own if r["split"] == "train"]
    a = np.array([[1.0, *[float(r[c]) for c in columns]] for r in train])
    w = np.linalg.lstsq(a, np.array([r[TARGET] for r in train]), rcond=None)[0]
    return {r["slot"]: (r["split"], r[TARGET], float(w @ [1.0, *[float(r[c]) for c in columns]])) for r in own}


@pytest.fixture(scope="module")
def gold(spark):
    rng = random.Random(1)
    x, loads = 0.0, []
    for i in range(4 * 1440):
        x = 0.9 * x + rng.gauss(0, 1)
        loads.append(None if rng.random() < 0.02 else 50 + x + 5 * math.sin(i / 60))
    rows = [("0", T0 + dt.timedelta(minutes=i), ("full", "half", "none", "full")[i // 1440], v) for i, v in enumerate(loads)]
    b = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, day_class string, load double").repartition(4)
    return {step: fx.gold(fx.silver(b, step, SETTINGS), SETTINGS).cache() for step in (60, 300)}


def test_each_hypothesis_by_its_own_metric_split_and_target(spark, gold):
    got = {r["hypothesis"]: r for r in hypotheses.table(gold, SETTINGS).collect()}
    rows = {step: fx.split(g, SETTINGS).collect() for step, g in gold.items()}
    for h in hypotheses.HYPOTHESES:
        base, arm = (fitted(rows[step], SETTINGS.sets()[kind]) for kind, step in (h.base, h.arm))
        if h.base[1] != h.arm[1]:
            bins = {}
            for slot, x in base.items():
                bins.setdefault((slot * h.base[1] // h.arm[1], x[0]), []).append(x[2])
            base = {k: (s, None, sum(v) / len(v)) for (k, s), v in bins.items()}
        pairs = [(y, base[k][2], p) for k, (s, y, p) in arm.items() if k in base and s == h.split]
        value = [(sum(abs(y - e) for y, *es in pairs for e in es[i : i + 1]) / len(pairs)) if h.metric == "mae" else math.sqrt(sum((y - es[i]) ** 2 for y, *es in pairs) / len(pairs)) for i in (0, 1)]
        r = got[h.name]
        assert r["n"] == len(pairs) and r["split"] == h.split and r["metric"] == h.metric and r["target_pct"] == h.most
        assert math.isclose(r["base_value"], value[0], abs_tol=1e-5) and math.isclose(r["arm_value"], value[1], abs_tol=1e-5)
        change = 100 * (value[1] / value[0] - 1)
        assert math.isclose(r["change_pct"], change, abs_tol=1e-3) and r["passed"] == (change <= h.most)


def test_an_empty_split_passes_nothing(spark, gold):
    none = {k: g.where("false") for k, g in gold.items()}
    assert [(r["n"], r["passed"]) for r in hypotheses.table(none, SETTINGS).collect()] == [(0, False)] * 3
