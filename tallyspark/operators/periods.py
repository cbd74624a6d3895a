"""Change of a measure from one period to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_change(
    totals: DataFrame, keys: Sequence[str], period: str, measure: str, step: str = "1 month"
) -> DataFrame:
    """Adds `<measure>_prior` and `<measure>_change` per key.

    `period` holds the first day of each period, as a date or in ISO text. The
    prior value is that of the period one `step` before by the calendar; it is
    null if that period is missing. `totals` is already one row per key and
    period, so a window partition is as long as the calendar.
    """
    by_period = Window.partitionBy(*keys).orderBy(period)
    start = F.col(period).cast("date")
    follows = (F.lag(start).over(by_period) + F.expr(f"INTERVAL {step}")).cast("date") == start
    prior = F.when(follows, F.lag(measure).over(by_period))
    return totals.withColumn(f"{measure}_prior", prior).withColumn(
        f"{measure}_change", F.col(measure) - F.col(f"{measure}_prior")
    )
