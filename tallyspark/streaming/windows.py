"""Event-time windows, the same transformation for batch and stream."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.money import cents, has_no_cents


# Watermarks need instants. Times without a zone become instants of UTC and
# come back as such, so that no zone of the session, nor its summer time, moves them.


def _instant(name: str) -> Column:
    return F.expr(
        f"make_timestamp(year({name}), month({name}), day({name}), hour({name}), minute({name}), "
        f"extract(SECOND FROM {name}), 'UTC')"
    )


def _without_zone(name: str) -> Column:
    seconds = f"CAST(unix_micros({name}) AS DECIMAL(20, 0)) / 1000000"
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({seconds} AS DECIMAL(18, 6)))")


def event_windows(events: DataFrame, width: str = "1 hour", *, late: str | None) -> DataFrame:
    """Count and value total per window and event type.

    `late` must be stated: in a stream, rows later than this are dropped, and
    `dropped_as_late` counts them; None drops none and keeps all state. In
    batch it has no effect. `ts` is a timestamp without a zone, and so are the
    window's ends. `unvalued_count` counts values that have no cents.
    """
    rows = events.select(_instant("ts").alias("ts"), "event_type", "value")
    if late is not None:
        rows = rows.withWatermark("ts", late)
    return (
        rows.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum(cents(F.col("value"))).alias("value_cents"),
            F.count_if(has_no_cents(F.col("value"))).alias("unvalued_count"),
        )
        .select(
            _without_zone("w.start").alias("window_start"),
            _without_zone("w.end").alias("window_end"),
            "event_type",
            "event_count",
            "value_cents",
            "unvalued_count",
        )
    )


def dropped_as_late(progress: Iterable[Mapping[str, Any]]) -> int:
    """Rows that the watermark has dropped, from a query's `recentProgress`."""
    return sum(
        int(operator.get("numRowsDroppedByWatermark", 0))
        for batch in progress
        for operator in batch["stateOperators"]
    )
