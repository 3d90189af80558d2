"""Series identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.spec import PanelSpec

SEP = "|"
# pandas renders a missing id part as the text "None"; concat_ws would
# silently drop it and let ('a', null) collide with ('a',).
MISSING_PART = "None"


def series_key(spec: PanelSpec) -> Column:
    """One string id per series: id columns joined by ``|``; the panel name
    when the panel has no id columns."""
    if not spec.series_id_cols:
        return F.lit(spec.name)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING_PART)) for c in spec.series_id_cols]
    return F.concat_ws(SEP, *parts) if len(parts) > 1 else parts[0]


def with_series_id(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumn("series_id", series_key(spec))
