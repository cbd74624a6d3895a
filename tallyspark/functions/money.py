"""Column helpers for amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Money as whole cents, so sums do not depend on the order of the rows.

    Null where the amount is no finite number or too large; `has_no_cents`
    counts those.
    """
    return F.round(amount * 100).try_cast("long")


def has_no_cents(amount: Column) -> Column:
    """Whether an amount that is there has no value in cents."""
    return amount.isNotNull() & cents(amount).isNull()
