import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wattloom.operators import features as fx
from wattloom.operators import stats
from wattloom.plans import pipeline, queries
from wattloom.plans.settings import Settings
from wattloom.sources import bronze as src

T0 = dt.datetime(2025, 1, 1)


def seconds(spark, loads, step=1, label="full", sid="0"):
    rows = [(sid, T0 + dt.timedelta(seconds=i * step), label, v) for i, v in enumerate(loads)]
    return spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, day_class string, load double")


def test_first_minute_mean_and_missing_minute(spark):
    loads = [float(i) for i in range(180)]
    loads[60:120] = [None] * 60
    rows = fx.grid(fx.resample(seconds(spark, loads), 60), 60).orderBy("slot").collect()
    assert [r["avg_load"] for r in rows] == [29.5, None, 149.5]
    assert {r["day_class"] for r in rows} == {"full"} and rows[0]["timestamp"] == T0


def test_grid_fills_missing_bins(spark):
    b = seconds(spark, [1.0, 2.0, 3.0], step=120)
    assert [r["avg_load"] for r in fx.grid(fx.resample(b, 60), 60).orderBy("slot").collect()] == [1.0, None, 2.0, None, 3.0]


def naive(v, s):
    out = []
    for t in range(len(v)):
        row = {f"lag_{k}": v[t - k] if t >= k else None for k in s.lags}
        for n in s.rolling:
            f = v[max(0, t - n + 1) : t + 1]
            ok = len(f) == n and None not in f
            for name, g in (("mean", statistics.fmean), ("std", statistics.stdev), ("max", max), ("min", min)):
                row[f"rolling_{name}_{n}"] = g(f) if ok else None
        for n in s.slopes:
            f = v[t - n : t] if t >= n else []
            row[f"slope_{n}"] = statistics.linear_regression(range(n), f).slope if len(f) == n and None not in f else None
        for k in s.lags:
            if k != 1:
                row[f"delta_{k}"] = row[f"lag_{k}"] - row["lag_1"] if None not in (row[f"lag_{k}"], row["lag_1"]) else None
        out.append(row)
    return out


@pytest.mark.parametrize("chunk", [7, 40, 4320])
def test_features_equal_a_plain_loop_whatever_the_chunk(spark, chunk, monkeypatch):
    monkeypatch.setattr(fx, "LONG", 6)
    s = Settings(lags=(1, 3, 7), rolling=(3, 6), slopes=(2, 4))
    rng = random.Random(chunk)
    v = [None if rng.random() < 0.1 else round(rng.uniform(0, 50), 2) for _ in range(60)]
    v[0] = v[-1] = 1.0
    got = fx.silver(seconds(spark, v, step=60), 60, s, chunk).orderBy("slot").collect()
    assert len(got) == 60
    for r, e in zip(got, naive(v, s), strict=True):
        for k, x in e.items():
            assert (r[k] is None) == (x is None) and (x is None or math.isclose(r[k], x, abs_tol=1e-6)), (k, r["slot"])


def test_slope_of_two(spark):
    s = Settings(lags=(1,), rolling=(2,), slopes=(2,))
    rows = fx.silver(seconds(spark, [10.0, 12.0, 14.0, 16.0], step=60), 60, s).orderBy("slot").collect()
    assert [r["slope_2"] for r in rows] == [None, None, 2.0, 2.0]


def test_runs_across_chunks(spark):
    v = [None if i in (3, 4, 5, 6, 7, 8, 20) else 1.0 for i in range(30)]
    for chunk in (4, 1000):
        d = fx.grid(fx.resample(seconds(spark, v, step=60), 60), 60)
        first = d.agg(F.min("slot")).first()[0]
        got = sorted((r["first_slot"] - first, r["length"]) for r in fx.runs(d, F.col("avg_load").isNull(), chunk).collect())
        assert got == [(3, 6), (20, 1)]


def test_split_days(spark):
    rows = [("0", T0 + dt.timedelta(days=i), "full", 100.0 + i) for i in range(31)]
    b = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, day_class string, load double")
    g = b.withColumn("avg_load", F.col("load"))
    n = {r["split"]: r["n"] for r in fx.split(g).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 25, "validate": 3, "test": 3}


def test_model_dataset_guards(spark):
    g = fx.gold(fx.silver(seconds(spark, [1.0] * 10, step=60), 60))
    for bad in ({"x": ("avg_load",)}, {"x": ("nope",)}):
        with pytest.raises(ValueError):
            fx.model_dataset(g, "x", Settings(feature_sets=bad))
    with pytest.raises(ValueError):
        fx.model_dataset(g, "y")


def test_empty_series(spark):
    assert fx.silver(seconds(spark, []), 60).count() == 0


def test_outlier_bounds_and_bins(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double")
    b = {r["method"]: (r["lower"], r["upper"]) for r in stats.outlier_bounds(d, "v").collect()}
    assert b["iqr"] == (-1.0, 7.0) and b["mad"] == (0.0, 6.0)
    assert stats.optimal_bins(d.where("v > 1000"), "v").first()[0] == 10


@pytest.mark.parametrize("bins", [5, 16, 32])
def test_quantiles_are_exact_by_any_number_of_bits(spark, bins):
    draw = random.Random(7)
    rows = [(g, draw.choice([None, 0.0, 1.5, draw.uniform(-5, 5), draw.expovariate(0.01)])) for g in ("a", "b", None) for _ in range(300)]
    rows += [("one", 3.25), ("same", 2.0), ("same", 2.0), ("none", None), ("wide", float("inf")), ("wide", 1.0), ("wide", -7.0), ("zeros", -0.0), ("zeros", 0.0), ("zeros", -1e-300), ("nan", float("nan")), ("nan", 2.0), ("nan", -1e300)]
    d, ps = spark.createDataFrame(rows, "g string, v double"), [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    exact = F.percentile(F.col("v"), F.array(*map(F.lit, ps)))
    want = {r["g"]: r["q"] or [None] * len(ps) for r in d.groupBy("g").agg(exact.alias("q")).collect()}
    got = {r["g"]: r["q"] for r in stats.quantiles(d, "v", ps, ["g"], bins).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], nan_ok=True) for g in want if g != "none") and got["none"] == [None] * len(ps)
    finite = d.where("g not in ('wide', 'nan')")
    assert stats.quantiles(finite, "v", ps, digit=bins).first()["q"] == pytest.approx(finite.agg(exact).first()[0])
    assert stats.quantiles(d.where("false"), "v", ps, digit=bins).first()["q"] == [None] * len(ps)
    assert stats.quantiles(d.where("false"), "v", ps, ["g"], bins).isEmpty()


def test_category_codes(spark):
    d = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "Z")], "id int, kind string").withColumn("code", F.lit(9))
    assert {r["id"]: r["code"] for r in stats.category_codes(d.withColumnRenamed("kind", "k"), "k").collect()} == {1: 2, 2: -1, 3: 1, 4: 2, 5: 0}


def test_clean_melt_and_labels(spark):
    w = spark.createDataFrame([(0, 1.0, float("inf")), (1, float("nan"), 4.0)], "second_of_day int, `2025-01-01` double, `2025-01-02` double")
    lab = spark.createDataFrame([("2025-01-01", " FULL "), ("2025-01-02", "none")], "date string, day_class string")
    got = sorted(map(tuple, src.build(w, src.labels(lab)).collect()))
    assert [(r[1], r[2]) for r in got] == [("full", 1.0), ("full", None), ("none", None), ("none", 4.0)]
    assert got[1][0] == dt.datetime(2025, 1, 1, 0, 0, 1)
    with pytest.raises(ValueError):
        src.melt(w.select("second_of_day"))
    with pytest.raises(ValueError):
        src.require(w, ["load"])


def test_interpolation_and_acf_depth(spark):
    d = spark.createDataFrame([("0", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "series_id string, slot long, avg_load double")
    assert [r["filled"] for r in fx.interpolate(d).orderBy("slot").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    gaps = spark.createDataFrame([("0", i, float(i * i) if i in (7, 8, 30) else None) for i in range(40)], "series_id string, slot long, avg_load double")
    for chunk in (1, 6, 100):
        got = [r["filled"] for r in fx.interpolate(gaps, chunk=chunk).orderBy("slot").collect()]
        assert got[:9] == [49.0] * 8 + [64.0] and got[30:] == [900.0] * 10
        assert all(abs(got[i] - (64 + 38 * (i - 8))) < 1e-9 for i in range(8, 31))
    for chunk in (1, 6, 100):
        assert [r["pos"] for r in stats.numbered(gaps.where("slot % 3 > 0"), chunk).orderBy("slot").collect()] == list(range(1, 27))
    rng, v, x = random.Random(0), [], 0.0
    for _ in range(1500):
        x = 0.95 * x + rng.gauss(0, 1)
        v.append(x)
    slow = spark.createDataFrame([("0", i, y) for i, y in enumerate(v)], "series_id string, slot long, avg_load double")
    white = spark.createDataFrame([("0", i, rng.gauss(0, 1)) for i in range(1500)], "series_id string, slot long, avg_load double")
    assert stats.acf_depth(slow, "avg_load").first()["depth"] > 20 > stats.acf_depth(white, "avg_load").first()["depth"]


def test_series_do_not_mix(spark):
    rng = random.Random(2)
    v = {sid: [rng.gauss(0, 1) for _ in range(50)] for sid in "ab"}
    d = spark.createDataFrame([(sid, i, x) for sid, xs in v.items() for i, x in enumerate(xs)], "series_id string, slot long, avg_load double")
    for chunk in (4, 4320):
        for r in stats.acf(d, 3, "avg_load", chunk=chunk).collect():
            x, k = v[r["series_id"]], r["lag"]
            assert r["n"] == 50 - k and math.isclose(r["r"], statistics.correlation(x[k:], x[:-k]), abs_tol=1e-9) and math.isclose(r["band"], 1.96 / math.sqrt(50))
    assert stats.pacf(d, 3, "avg_load").count() == 6 and stats.welch(d, "avg_load", 16).where("bin = 0").count() == 2
    assert {r["series_id"] for r in stats.acf_depth(d, "avg_load").collect()} == {"a", "b"}
    assert [r["before"] for r in stats.neighbour(d.where("series_id = 'a'"), "avg_load", 7).orderBy("slot").collect()] == [None, *v["a"][:-1]]


def test_days_are_completed_before_decomposing(spark):
    day = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)
    full = [(i % 7) * 10.0 + i for i in range(60)]
    rows = [("0", day(i), x) for i, x in enumerate(full) if i not in (20, 21, 40)]
    for chunk in (5, 4320):
        got = {r["date"]: r for r in stats.decompose(spark.createDataFrame(rows, "series_id string, date date, v double"), "v", chunk=chunk).collect()}
        assert len(got) == 60 and got[day(2)]["trend"] is None and math.isclose(got[day(8)]["trend"], sum(full[5:12]) / 7)
        assert len({round(got[day(i)]["seasonal"], 9) for i in range(3, 60, 7)}) == 1


def test_classes_of_empty_bins(spark):
    rows = [("0", T0, "none", 1.0), ("0", T0 + dt.timedelta(hours=2), "none", 2.0), ("0", T0 + dt.timedelta(days=2), "half", 3.0)]
    b = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, day_class string, load double")
    got = [r["day_class"] for r in fx.grid(fx.resample(b, 3600), 3600).orderBy("slot").collect()]
    assert got == ["none"] * 24 + [None] * 24 + ["half"]


def test_whole_run_and_guards(spark, tmp_path):
    s = Settings(lags=(1, 2), rolling=(2,), slopes=(2,), feature_sets={"few": ("hour", "lag_1")})
    b = seconds(spark, [float(i) for i in range(3 * 96)], step=900)
    made = pipeline.build_all(b, str(tmp_path), "custom", ["15min"], None, s)
    assert set(made) == {"silver/15min", "gold/15min", "model/15min/few"} and made["silver/15min"].count() == 288 and (tmp_path / "model" / "15m" / "few").is_dir()
    assert pipeline.build_all(b, str(tmp_path), "custom", ["15min"], None, s, dry_run=True) == {}
    day2 = b.where("timestamp < '2025-01-01 12:00:00' or timestamp > '2025-01-03 12:00:00'")
    for bad in (b.withColumn("load", F.lit(None).cast("double")), b.withColumn("day_class", F.lit("odd")), b.drop("load"), day2):
        with pytest.raises(ValueError):
            pipeline.build_all(bad, str(tmp_path), "custom", ["15min"], None, s)
    with pytest.raises(ValueError):
        pipeline.guard_schema(made["gold/15min"].select("avg_load"), s)
    with pytest.raises(ValueError):
        pipeline.guard_calendar(made["gold/15min"].withColumn("month", F.lit(13)))
    lab = spark.createDataFrame([("2025-01-01", "full"), ("2025-01-02", "none")], "date string, day_class string")
    wide = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "second_of_day int, `2025-01-01` double, `2025-01-02` double")
    assert pipeline.guard_raw(wide, lab, rows=2) is wide
    for w, x in ((wide, lab.limit(1)), (wide.limit(1), lab), (wide.select("second_of_day"), lab), (wide.withColumn("2025-01-02", F.lit("x")), lab), (wide, lab.union(lab.limit(1)).limit(2).withColumn("day_class", F.lit("?")))):
        with pytest.raises(ValueError):
            pipeline.guard_raw(w, x, rows=2)
    with pytest.raises(ValueError):
        pipeline.guard_matched(b.withColumn("date", F.to_date("timestamp")), lab)


def test_long_frames_of_extremes(spark, monkeypatch):
    monkeypatch.setattr(fx, "LONG", 5)
    rng = random.Random(9)
    v = [rng.uniform(0, 9) for _ in range(97)]
    s = Settings(lags=(1,), rolling=(5, 24), slopes=(2,))
    for chunk in (24, 31, 4320):
        got = fx.silver(seconds(spark, v, step=60), 60, s, chunk).orderBy("slot").collect()
        for n in (5, 24):
            assert [r[f"rolling_max_{n}"] for r in got] == [None] * (n - 1) + [max(v[i - n + 1 : i + 1]) for i in range(n - 1, 97)]
            assert [r[f"rolling_min_{n}"] for r in got] == [None] * (n - 1) + [min(v[i - n + 1 : i + 1]) for i in range(n - 1, 97)]


def test_correlations_skip_null_pairs(spark):
    rng = random.Random(1)
    rows = [tuple(None if rng.random() < 0.2 else rng.uniform(0, 1) + 1e6 for _ in range(3)) for _ in range(200)]
    d = spark.createDataFrame(rows, "x double, y double, z double")
    for r in stats.corr_matrix(d, ["x", "y", "z"]).collect():
        assert math.isclose(r["r"], d.agg(F.corr(r["a"], r["b"])).first()[0], abs_tol=1e-6)


def brute_lags(v, lags):
    """Pearson of pairs ``k`` places apart that are both there, by plain sums."""
    out = {}
    for k in range(1, lags + 1):
        pairs = [(v[i], v[i - k]) for i in range(k, len(v)) if v[i] is not None and v[i - k] is not None]
        if pairs:
            y, x = zip(*pairs, strict=True)
            flat = max(y) - min(y) < 1e-12 or max(x) - min(x) < 1e-12
            out[k] = (None if flat else statistics.correlation(y, x), len(pairs))
    return out


@pytest.mark.parametrize("chunk", [3, 50, 4320])
def test_autocorrelation_by_transforms_equals_plain_sums(spark, chunk):
    rng = random.Random(chunk)
    own = {"a": [None if rng.random() < 0.2 else 1e5 + rng.gauss(0, 3) for _ in range(230)], "b": [5.0] * 40, "c": [1.0, None, None, 7.0], "d": [None, 2.0]}
    d = spark.createDataFrame([(s, i - 60, x) for s, v in own.items() for i, x in enumerate(v)], "series_id string, slot long, y double")
    got = {}
    for r in stats.acf(d, 12, "y", chunk=chunk).collect():
        got.setdefault(r["series_id"], {})[r["lag"]] = (r["r"], r["n"])
        assert math.isclose(r["band"], 1.96 / math.sqrt(sum(x is not None for x in own[r["series_id"]])))
    for s, v in own.items():
        want = brute_lags(v, 12)
        assert {k: n for k, (_, n) in got.get(s, {}).items()} == {k: n for k, (_, n) in want.items()}
        for k, (r, _) in want.items():
            assert (r is None) == (got[s][k][0] is None) and (r is None or math.isclose(r, got[s][k][0], abs_tol=1e-7))
    assert stats.acf(d.where("false"), 12, "y").isEmpty() and stats.acf_depth(d.where("false"), "y").isEmpty()
    depth = {r["series_id"]: r["depth"] for r in stats.acf_depth(d, "y", least=1, most=30).collect()}
    for s, v in own.items():
        w = [x for x in v if x is not None]
        top, bound = min(30, len(w) - 1), statistics.NormalDist().inv_cdf(0.975) / math.sqrt(len(w))
        weak = [abs(brute_lags(w, top).get(k, (0, 0))[0] or 0) < bound for k in range(1, top + 1)]
        first = next((k for k in range(1, top - 3) if all(weak[k - 1 : k + 4])), top)
        flat = len(w) < 3 or max(w) == min(w)
        assert depth[s] == (1 if flat else max(1, first))


def test_partial_autocorrelation_by_normal_equations(spark):
    import numpy as np

    rng, v = random.Random(4), [0.0]
    for _ in range(400):
        v.append(0.6 * v[-1] + rng.gauss(0, 1))
    d = spark.createDataFrame([("0", i, x) for i, x in enumerate(v)] + [("flat", i, 2.0) for i in range(9)], "series_id string, slot long, y double")
    got = {(r["series_id"], r["lag"]): r["pacf"] for r in stats.pacf(d, 5, "y").collect()}
    c = [sum((v[i] - statistics.fmean(v)) * (v[i - k] - statistics.fmean(v)) for i in range(k, len(v))) for k in range(6)]
    for k in range(1, 6):
        gram = np.array([[c[abs(i - j)] for j in range(k)] for i in range(k)])
        assert math.isclose(np.linalg.solve(gram, np.array(c[1 : k + 1]))[-1], got["0", k], abs_tol=1e-9)
        assert got["flat", k] is None


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_all_resolutions_are_folded_from_one_read(spark, tmp_path):
    rng = random.Random(3)
    loads = [None if rng.random() < 0.3 else rng.uniform(0, 9) for _ in range(4000)]
    b = seconds(spark, loads[:2500]).union(seconds(spark, loads[2500:], label="half").withColumn("timestamp", F.expr("timestamp + interval 3 hours")))
    b.write.parquet(str(tmp_path / "bronze"))
    b = spark.read.parquet(str(tmp_path / "bronze"))
    steps = [1, 5, 10, 30, 60, 300, 600, 900]
    every = fx.grid(fx.folded(fx.states(b, 1), 1, steps))
    assert scans(every.groupBy("step").count()) == 1
    for step in (5, 60, 900):
        want = {r["slot"]: (r["avg_load"], r["day_class"]) for r in fx.grid(fx.resample(b, step), step).collect()}
        got = {r["slot"]: (r["avg_load"], r["day_class"]) for r in every.where(F.col("step") == step).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and (got[k][0] is None) == (want[k][0] is None) and (want[k][0] is None or math.isclose(got[k][0], want[k][0])) for k in want)
    with pytest.raises(ValueError):
        fx.folded(fx.states(b, 60), 60, [60, 90])


def wide_table(spark, days=3, rows=6):
    names = [f"2025-01-0{i + 1}" for i in range(days)]
    data = [(s, *[float(s + 10 * i) if (s, i) != (0, 0) else None for i in range(days)]) for s in range(rows)]
    wide = spark.createDataFrame(data, "second_of_day int, " + ", ".join(f"`{n}` double" for n in names))
    return wide, spark.createDataFrame(list(zip(names, [" Full", "half", "none"][:days], strict=True)), "date string, day_class string")


def test_stages_from_the_raw_table(spark, tmp_path):
    s = Settings(lags=(1, 2), rolling=(2,), slopes=(2,), feature_sets={"few": ("hour", "lag_1")}, splits={"train": (1, 1), "validate": (2, 2), "test": (3, 3)})
    raw, root = wide_table(spark), str(tmp_path)
    opts = {"mode": "custom", "custom": ["1s", "60s"], "settings": s, "rows": 6}
    made, seen = pipeline.run(spark, root, "bronze", raw, **opts)
    assert set(made) == {"bronze"} and seen["bronze"]["rows"] == 18 and seen["bronze"]["n_null"] == 1 and seen["bronze"]["high"] == 25.0
    made, seen = pipeline.run(spark, root, "silver", **opts)
    assert set(made) == {"silver/1s", "silver/1min"} and seen["silver/1s"]["rows"] == 2 * 86400 + 6 and seen["states"]["warn"]
    made, seen = pipeline.run(spark, root, ["model", "gold"], **opts)
    assert set(made) == {"gold/1s", "gold/1min", "model/1s/few", "model/1min/few"} and seen["gold/1s"]["before"] == 2 * 86400 + 6 and seen["gold/1s"]["rows"] == 17
    m = seen["model/1s/few"]
    assert [m[f"{k}_rows"] for k in s.splits] == [5, 6, 6] and m["train_null_lag_1"] == 1 and m["test_mean"] == 22.5 and m["train_first"] == T0 + dt.timedelta(seconds=1)
    assert {r["split"]: r["n"] for r in made["model/1s/few"].groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 5, "validate": 6, "test": 6}
    assert pipeline.run(spark, root, "all", raw, dry_run=True, **opts) == ({}, {})
    for wrong in ("x", ["bronze", "nope"]):
        with pytest.raises(ValueError):
            pipeline.run(spark, root, wrong, raw, **opts)
    with pytest.raises(ValueError):
        pipeline.run(spark, root, "all", raw, mode="custom", custom=["999min"])
    with pytest.raises(ValueError):
        pipeline.run(spark, root, "bronze", **opts)


def test_each_layer_is_written_by_one_execution(spark, tmp_path):
    """The guards take no pass of their own; the day order of a model set is the only other thing that is read."""
    store = spark._jsparkSession.sharedState().statusStore()
    s = Settings(lags=(1,), rolling=(2,), slopes=(2,), feature_sets={"few": ("hour", "lag_1")})
    b = seconds(spark, [float(i) for i in range(200)], step=900)
    before = store.executionsCount()
    made = pipeline.build_all(b, str(tmp_path), "custom", ["15min", "5min"], None, s)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() - before == 1 + len(made)  # the bins' sums, and each layer


FAULTS = {
    "rows": lambda w, x: (w.where("second_of_day > 0"), x),
    "repeated seconds": lambda w, x: (w.withColumn("second_of_day", F.lit(1)), x),
    "no days": lambda w, x: (w.select("second_of_day"), x),
    "not numbers": lambda w, x: (w.withColumn("2025-01-02", F.lit("x")), x),
    "unknown class": lambda w, x: (w, x.withColumn("day_class", F.lit("holiday"))),
    "null class": lambda w, x: (w, x.withColumn("day_class", F.lit(None).cast("string"))),
    "a label short": lambda w, x: (w, x.where("date <> '2025-01-02'")),
    "repeated dates": lambda w, x: (w, x.where("date <> '2025-01-02'").union(x.where("date = '2025-01-01'"))),
    "another date": lambda w, x: (w, x.withColumn("date", F.when(F.col("date") == "2025-01-02", "2025-02-02").otherwise(F.col("date")))),
    "no load": lambda w, x: (w.select("second_of_day", *[F.lit(None).cast("double").alias(c) for c in w.columns[1:]]), x),
}


@pytest.mark.parametrize("fault", list(FAULTS))
def test_faults_of_the_raw_table_stop_the_run(spark, tmp_path, fault):
    with pytest.raises(ValueError):
        pipeline.run(spark, str(tmp_path), "bronze", FAULTS[fault](*wide_table(spark)), rows=6)
    assert not (tmp_path / "silver").exists()


def test_infinite_loads_and_days_without_any(spark, tmp_path):
    w, x = wide_table(spark)
    w = w.withColumn("2025-01-02", F.lit(float("inf"))).withColumn("2025-01-03", F.lit(-1.0))
    seen = pipeline.run(spark, str(tmp_path), "bronze", (w, x), rows=6)[1]["bronze"]
    assert seen["n_null"] == 7 and seen["n_implausible"] == 6 and seen["n_there"] == 11


def test_splits_must_follow_each_other():
    with pytest.raises(ValueError):
        pipeline.guard_splits({"a_from": 1, "a_to": 5, "b_from": 5, "b_to": 9}, ["a", "b"])
    pipeline.guard_splits({"a_from": 1, "a_to": 5, "b_from": None, "b_to": None, "c_from": 6, "c_to": 9}, ["a", "b", "c"])


def test_far_outliers_leave_no_crowded_bin(spark):
    """A million values near 1 and one of 1e12: no task sorts them, and no more than the digits' counts come out of a round."""
    d = spark.range(1_000_000).select((1 + F.col("id") / 1e9).alias("v")).union(spark.createDataFrame([(1e12,)], "v double"))
    q = stats.quantiles(d, "v", [0.0, 0.5, 1.0])
    assert q.first()["q"] == pytest.approx([1.0, 1 + 500_000 / 1e9, 1e12], rel=1e-15)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 4 and "percentile" not in plan


def test_ranks_over_all_rows_without_a_window_over_them(spark):
    d = spark.range(5000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    x = stats.ranked(d, ["h"], "n")
    rows = x.collect()
    assert [r["h"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(r["h"] for r in rows) and {r["n"] for r in rows} == set(range(1, 5001))
    assert stats.ranked(d.where("false"), ["h"]).isEmpty()


def test_time_that_goes_back(spark):
    v = [1, 2, 3, 2, 5, 4, 9]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("b", i, i) for i in range(9)], "series_id string, slot long, t long")
    assert [tuple(r) for r in stats.going_back(d, "t").collect()] == [("a", 2, 3, 3, 2)]


def test_manifests_tell_what_differs(spark):
    rows = [("x", i, i / 3, None if i % 4 == 0 else "s") for i in range(40)] + [("y", 1, 2.0, "t"), (None, 1, -0.0, "t")]
    d = spark.createDataFrame(rows, "part string, a int, v double, s string")
    other = d.repartition(5).withColumn("v", F.when(F.col("part") == "y", F.col("v") + 1e-12).otherwise(F.col("v") + 0.0))
    assert {r["part"]: (r["n_rows"], r["n_other"], r["equal"]) for r in src.compared(src.manifest(d, ["part"]), src.manifest(other, ["part"]), ["part"]).collect()} == {"x": (40, 40, True), "y": (1, 1, True), None: (1, 1, True)}
    wrong = d.where("not (part = 'y')").withColumn("s", F.when((F.col("a") == 3) & (F.col("part") == "x"), None).otherwise(F.col("s"))).union(spark.createDataFrame([("z", 1, 1.0, "u")], d.schema))
    got = {r["part"]: (r["n_rows"], r["n_other"], r["equal"]) for r in src.compared(src.manifest(d, ["part"]), src.manifest(wrong, ["part"]), ["part"]).collect()}
    assert got == {"x": (40, 40, False), "y": (1, 0, False), "z": (0, 1, False), None: (1, 0, False)}


def test_normal_order_medians(spark):
    n = 200
    x = spark.range(1, n + 1).select(F.col("id").cast("double").alias("i")).select("i", stats.normal_value(stats.filliben(F.lit(float(n)), F.col("i"))).alias("z"))
    for r in x.collect():
        i = int(r["i"])
        p = 0.5 ** (1 / n) if i == n else 1 - 0.5 ** (1 / n) if i == 1 else (i - 0.3175) / (n + 0.365)
        assert math.isclose(r["z"], statistics.NormalDist().inv_cdf(p), abs_tol=1e-8)
    d = spark.createDataFrame([(i, statistics.NormalDist(3, 2).inv_cdf((i + 0.5) / 99)) for i in range(99)] + [(99, None)], "slot long, v double")
    r = stats.qq_sample(d, "v", ["slot"]).first()
    assert math.isclose(r["slope"], 2, rel_tol=0.02) and math.isclose(r["intercept"], 3, rel_tol=0.01) and r["r2"] > 0.999


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_spectra_of_batches_equal_those_of_single_segments(spark, batch):
    import numpy as np

    rng = random.Random(batch)
    own = {"a": {i + 5: rng.gauss(0, 1) for i in range(150) if i != 77}, "b": {i: 1.0 for i in range(16)}, "short": {i: 1.0 for i in range(9)}}
    d = spark.createDataFrame([(s, i, x) for s, v in own.items() for i, x in v.items()] + [("a", 82, None)], "series_id string, slot long, y double")
    got = {(r["series_id"], r["bin"]): (r["power"], r["segments"]) for r in stats.welch(d, "y", 16, batch).collect()}
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    want = {}
    for s, v in own.items():
        first, ps = min(v), []
        for k in range(first, max(v), 8):
            if all(k + i in v for i in range(16)):
                y = np.array([v[k + i] for i in range(16)])
                p = np.abs(np.fft.rfft((y - y.mean()) * w)) ** 2 / (w * w).sum()
                p[1:-1] *= 2
                ps.append(p)
        want |= {(s, b): (float(np.mean([p[b] for p in ps])), len(ps)) for b in range(9) if ps}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("block", [1, 2, 64])
def test_days_correlate_over_the_minutes_both_have(spark, block):
    rng = random.Random(block)
    day = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)
    own = {(s, i): {m: 1e4 + rng.gauss(0, 1) for m in range(20) if rng.random() < 0.7} for s in "ab" for i in (0, 1, 2, 5, 9)}
    own["a", 3], own["a", 4] = {m: 7.0 for m in range(20)}, {}
    rows = [(s, day(i), m, x) for (s, i), v in own.items() for m, x in v.items()] + [("a", day(4), 3, None)]
    d = spark.createDataFrame(rows, "series_id string, date date, place int, v double")
    x = stats.day_correlations(d, "v", 20, block)
    got = {(r["series_id"], r["day_a"], r["day_b"]): (r["n"], r["r"]) for r in x.collect()}
    want = {}
    for (s, i), v in own.items():
        for (t, j), u in own.items():
            both = sorted(v.keys() & u.keys())
            if s == t and i < j and both:
                a, b = [v[m] for m in both], [u[m] for m in both]
                want[s, day(i), day(j)] = (len(both), statistics.correlation(a, b) if len(both) > 1 and len(set(a)) > 1 and len(set(b)) > 1 else None)
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and (r is None) == (got[k][1] is None) and (r is None or math.isclose(r, got[k][1], abs_tol=1e-6))
    assert "place" not in str(x.schema)


def test_sketches_of_days_merge_to_those_of_spans(spark):
    rng = random.Random(0)
    rows = [(i % 10, rng.expovariate(1), i % 3000) for i in range(20_000)] + [(99, None, None)]
    parts = stats.sketches(spark.createDataFrame(rows, "day int, v double, k int").repartition(5), "v", ["day"], "k")
    v = sorted(r[1] for r in rows if r[1] is not None)
    all_ = stats.merged(parts.withColumn("all", F.lit(1)), ["all"], [0.1, 0.5, 0.99]).first()
    assert all_["n_rows"] == 20_001 and all_["n"] == 20_000 and abs(all_["n_distinct"] / 3000 - 1) < 0.06
    for p, q in zip([0.1, 0.5, 0.99], all_["q"], strict=True):
        assert abs(sum(x <= q for x in v) / len(v) - p) < 0.02
    none = stats.merged(parts, ["day"], [0.5]).where("day = 99").first()
    assert none["q"] is None and none["n"] == 0 and none["n_distinct"] == 0


@pytest.mark.parametrize("period", [4, 7, 24])
def test_trends_of_even_periods_take_half_of_both_ends(spark, period):
    day = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)
    v = [(i % period) * 3.0 + 0.5 * i for i in range(4 * period)]
    rows = spark.createDataFrame([("0", day(i), x) for i, x in enumerate(v)], "series_id string, date date, v double")
    half = period // 2
    for chunk in (9, 4320):
        got = [r for r in stats.decompose(rows, "v", period, chunk).orderBy("date").collect()]
        for i, r in enumerate(got):
            inside = half <= i < len(v) - half
            assert (r["trend"] is None) != inside
            if inside:
                ends = (v[i - half] + v[i + half]) / 2 if period % 2 == 0 else v[i - half] + v[i + half]
                assert math.isclose(r["trend"], (sum(v[i - half + 1 : i + half]) + ends) / period) and abs(r["residual"]) < 1e-9


@pytest.mark.parametrize("most", [1e-300, 1.0, 1e9, 1e300])
def test_means_are_the_same_to_the_last_bit_in_whatever_order_rows_come(spark, most):
    rng = random.Random(5)
    loads = [rng.uniform(-1, 1) * most * 10 ** -rng.randrange(6) for _ in range(3000)] + [0.0, -0.0, None]
    b = seconds(spark, loads).withColumn("n", F.monotonically_increasing_id())
    means = {fx.resample(x, 86400).first()["avg_load"] for x in (b.coalesce(1), b.orderBy("n").coalesce(1), b.orderBy(F.desc("n")).coalesce(1), b.orderBy("load").coalesce(1), b.repartition(7, "load"))}
    assert len(means) == 1
    want = math.fsum(v / 3002 for v in loads if v is not None)
    assert math.isclose(means.pop(), want, rel_tol=1e-11)


def test_bins_with_loads_that_are_no_numbers_have_no_mean(spark):
    loads = [math.inf, 1.0, math.nan, 1.0, 1.7e308, 1.7e308, None, None, 5e-324, 5e-324, 3.0, None, -math.inf, math.inf]
    got = [r["avg_load"] for r in fx.resample(seconds(spark, loads), 2).orderBy("slot").collect()]
    assert got == [None, None, None, None, 5e-324, 3.0, None]


def test_layer_manifest_finds_the_same_content_where_sums_depend_on_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, T0 + dt.timedelta(seconds=40 * i % 86400), i % 5, "view", round(rng.uniform(0, 1e9), 2), "") for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.layer_manifest(spark, str(tmp_path)).collect()
    assert [(r["date"], r["n_rows"], r["n_other"], r["equal"]) for r in got] == [(T0.date(), 96, 96, True)]
