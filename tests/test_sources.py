"""Sources: missing file, malformed CSV, missing date column, NaN -> null."""

from __future__ import annotations

import pytest

from hindcast.presets import load_preset
from hindcast.sources.readers import read_panel

SCHEMA = "Date string, AveragePrice double, `Total Volume` double, region string, type string"


def _write(tmp_path, text: str) -> str:
    d = tmp_path / "raw"
    d.mkdir()
    (d / "part.csv").write_text(text)
    return str(d)


def test_missing_file_names_the_path(spark, tmp_path):
    missing = str(tmp_path / "nope.csv")
    with pytest.raises(FileNotFoundError, match="nope.csv"):
        read_panel(spark, missing, load_preset("avocado"), fmt="csv", schema=SCHEMA)


def test_csv_with_schema_parses_dates_and_nan(spark, tmp_path):
    path = _write(
        tmp_path,
        "Date,AveragePrice,Total Volume,region,type\n2020-01-05,1.5,10,TotalUS,conventional\n2020-01-12,NaN,11,TotalUS,conventional\n",
    )
    df = read_panel(spark, path, load_preset("avocado"), fmt="csv", schema=SCHEMA)
    rows = df.orderBy("Date").collect()
    assert str(rows[0]["Date"]) == "2020-01-05"
    assert rows[1]["AveragePrice"] is None  # NaN is missing (T1)


def test_malformed_csv_fails_fast(spark, tmp_path):
    path = _write(tmp_path, "Date,AveragePrice,Total Volume,region,type\n2020-01-05,abc,10,TotalUS,conventional\n")
    with pytest.raises(Exception):
        read_panel(spark, path, load_preset("avocado"), fmt="csv", schema=SCHEMA).collect()


def test_malformed_date_fails(spark, tmp_path):
    path = _write(tmp_path, "Date,AveragePrice,Total Volume,region,type\nnot-a-date,1.0,10,TotalUS,conventional\n")
    with pytest.raises(Exception):
        read_panel(spark, path, load_preset("avocado"), fmt="csv", schema=SCHEMA).collect()


def test_missing_date_column_raises_before_any_job(spark, tmp_path):
    path = _write(tmp_path, "When,AveragePrice\n2020-01-05,1.0\n")
    with pytest.raises(KeyError, match="Date"):
        read_panel(spark, path, load_preset("avocado"), fmt="csv", schema="When string, AveragePrice double")
