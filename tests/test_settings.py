import pytest

from wattloom.plans.settings import Settings, canonical_resolution, resolutions


def test_schema_has_44_columns_in_order():
    c = Settings().columns()
    assert len(c) == 44 and c[:3] == ["timestamp", "avg_load", "day_class"] and c[-1] == "slope_60"
    assert [f.name for f in Settings().schema()] == c


def test_resolutions():
    assert canonical_resolution("60s") == "1min" and resolutions("custom", ["60s", "1min", "5m"]) == ["1min", "5min"]
    assert len(resolutions("all")) == 8
    with pytest.raises(ValueError):
        canonical_resolution("7s")


@pytest.mark.parametrize("bad", [{"lags": (5,)}, {"rolling": ()}, {"splits": {"a": (1, 5), "b": (7, 9)}}, {"drop_warning_pct": 101.0}, {"feature_sets": {"x": ("avg_load",)}}, {"feature_sets": {"x": ("nope",)}}])
def test_invalid_settings(bad):
    Settings().validate()
    with pytest.raises(ValueError):
        Settings(**bad).validate()
