"""Stores that micro-batches are merged into: their size follows the live keys, not the history of the stream.

A store is a table in buckets of its key. Each micro-batch is folded to its last row per key and merged into the buckets
it touches, which are swapped in by one decided change; merging a batch twice changes nothing, so a batch that the
engine repeats after a failure does no harm.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.plans.keyed import latest_per_key
from clickloom.plans.swap import TableFiles, recover, replace

_BUCKET = "bucket"


class LatestStore:
    """The greatest row per key by ``order``, which must hold the time column ``ts`` (Unix seconds) if rows expire.

    ``keep_seconds`` drops keys whose row is older than that, seen from the newest row the store has met; a row that
    comes later than that is dropped too. Rows without a key are left out.
    """

    def __init__(self, path: str, schema: str, key: str, order: list[str], buckets: int = 64,
                 keep_seconds: int | None = None, ts: str = "ts"):
        self.path, self.schema, self.key, self.order = path, schema, key, order
        self.buckets, self.keep_seconds, self.ts = buckets, keep_seconds, ts

    def _stored(self, spark: SparkSession) -> DataFrame:
        TableFiles(spark, self.path).make()
        return spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """One row per live key: a scan, nothing is folded."""
        return self._stored(spark).drop(_BUCKET)

    def merge(self, batch: DataFrame) -> None:
        spark = batch.sparkSession
        recover(spark, self.path)
        stored = self._stored(spark)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(_BUCKET)
        changes = latest_per_key(batch, [self.key], self.order).select(*stored.drop(_BUCKET).columns, bucket)
        changes.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = {r[0] for r in changes.select(_BUCKET).distinct().collect()}  # one value per bucket
            live = None
            if self.keep_seconds is not None:
                newest = stored.select(self.ts).unionAll(changes.select(self.ts)).agg(F.max(self.ts)).first()[0]
                if newest is not None:
                    live = F.col(self.ts) >= newest - self.keep_seconds
                    touched |= {r[0] for r in stored.where(~live).select(_BUCKET).distinct().collect()}
            if not touched:
                return
            both = stored.where(F.col(_BUCKET).isin(sorted(touched))).unionByName(changes)
            merged = latest_per_key(both, [_BUCKET, self.key], self.order)
            merged = merged if live is None else merged.where(live)

            def write(folder: str) -> None:
                merged.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)

            replace(spark, self.path, write, [f"{_BUCKET}={b}" for b in sorted(touched)])
        finally:
            changes.unpersist()

    def save(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.merge(batch)
