"""Running a stream over what is there now, into parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from clickloom.plans.workspace import work_folder
from clickloom.streaming.jobs import STATE_STORE


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_batches(df: DataFrame, name: str, save: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all available input, giving every micro-batch to ``save``."""
    spark = df.sparkSession
    with _settings(spark, STATE_STORE):
        writer = df.writeStream.option("checkpointLocation", f"{work_folder(spark, name)}/checkpoint")
        writer.trigger(availableNow=True).outputMode(mode).foreachBatch(save).start().awaitTermination()


def run_available(df: DataFrame, name: str, mode: str = "append") -> str:
    """Process all available input and return the folder of the output.

    Append mode uses the exactly-once file sink. Other modes write every micro-batch to its own ``batch_id``
    directory, which a retried batch overwrites.
    """
    spark = df.sparkSession
    root = work_folder(spark, name)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with _settings(spark, STATE_STORE):
        writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", out).outputMode("append").start()
        else:
            query = writer.outputMode(mode).foreachBatch(save).start()
        query.awaitTermination()
    return out
