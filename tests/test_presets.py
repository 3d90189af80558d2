"""Smoke tests: both dataset presets load, an unknown one raises, and the
feature counts match the configured recipes (38 / 39 numeric + 2 categorical)."""

from __future__ import annotations

import pytest

from hindcast.presets import load_preset


def test_presets_load():
    a, m = load_preset("avocado"), load_preset("m5")
    assert (a.horizon, a.freq, m.horizon, m.freq) == (12, "W", 28, "D")
    assert a.series_id_cols == ("region", "type")


def test_unknown_preset_raises():
    with pytest.raises(FileNotFoundError, match="choose one of"):
        load_preset("nope")


def test_feature_counts(spark):
    import pandas as pd

    from hindcast.operators.features import build_feature_matrix
    from tests.helpers import to_spark

    pdf = pd.DataFrame(
        {
            "Date": pd.date_range("2020-01-05", periods=3, freq="W"),
            "AveragePrice": [1.0, 2.0, 3.0],
            "Total Volume": [1.0, 2.0, 3.0],
            "region": "a",
            "type": "t",
        }
    )
    _, fs = build_feature_matrix(to_spark(spark, pdf), load_preset("avocado"))
    assert (len(fs.numeric), len(fs.categorical)) == (38, 2)
    pdf2 = pd.DataFrame(
        {
            "date": pd.date_range("2020-01-01", periods=3, freq="D"),
            "sales": [1.0, 2.0, 3.0],
            "sell_price": [1.0, 1.0, 1.0],
            "event_name_1": ["x", None, "y"],
            "snap_flag": [0, 1, 0],
            "store_id": "s",
            "item_id": "i",
        }
    )
    _, fs2 = build_feature_matrix(to_spark(spark, pdf2), load_preset("m5"))
    # the string event column is routed to the categorical inputs
    assert (len(fs2.numeric), len(fs2.categorical)) == (38, 3)
