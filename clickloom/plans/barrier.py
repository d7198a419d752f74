"""Keeping Catalyst from repeating long expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(c: Column) -> Column:
    """The same value, produced by a generator of one row.

    A filter on a projected column is pushed below the projection together with a copy of the column's expression.
    A filter on a generated column stays above it, so a long expression that is later filtered on runs once.
    """
    return F.explode(F.array(c))
