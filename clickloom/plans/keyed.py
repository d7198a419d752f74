"""Keyed reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``.

    An aggregate rather than a ranking window, so rows of a hot key are folded before the shuffle. Rows without a key
    belong to no group and are left out.
    """
    rest = [c for c in df.columns if c not in keys]
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
