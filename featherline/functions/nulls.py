"""Aggregates and conditions with explicit missing-value rules.

``strict_*`` return NULL as soon as one selected input is missing, the way a
statistics package does unless told to skip missing values.  The built-in
aggregates of the same name skip them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_min(x: Column) -> Column:
    return F.when(F.count(x) == F.count(F.lit(1)), F.min(x))


def strict_max(x: Column) -> Column:
    return F.when(F.count(x) == F.count(F.lit(1)), F.max(x))


def strict_sum(x: Column, where: Column) -> Column:
    """Sum over rows where `where` holds; an unknown `where` or `x` makes it NULL."""
    unknown = where.isNull() | (where & x.isNull())
    return F.when(F.count_if(unknown) == 0, F.coalesce(F.sum(F.when(where, x)), F.lit(0)))


def lenient_sum(x: Column, where: Column) -> Column:
    """Sum over rows where `where` holds, missing skipped; 0 when nothing is left."""
    return F.coalesce(F.sum(F.when(where, x)), F.lit(0))


def if_known(cond: Column, then: Column, other: Column) -> Column:
    """Two-way choice that stays NULL when the condition is unknown."""
    return F.when(cond, then).when(~cond, other)


def among(x: Column, values) -> Column:
    """Membership that is false, never NULL, for a missing `x`."""
    return F.coalesce(x.isin(*values), F.lit(False))


def standard_error(x: Column) -> Column:
    """Sample deviation over the known values, divided by the root of all rows."""
    return F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))
