"""Request limits on a stream, decided by the batch job on each micro-batch and a small carried table.

Requests wait until the newest one seen is ``delay`` seconds ahead of them; then every request of their second is here,
and they are decided in order of time. What later decisions need of earlier ones is the window that is still open at
each address: its requests per second, at most ``window + 1`` rows, which the batch job takes as requests that were
counted before. Windows that ended are not carried on, so an idle address leaves nothing behind. No address is followed
by one task, and the decisions are those of the batch job however the input is cut or shuffled within the delay.

Each micro-batch writes its decisions and its state under its own number and reads the state before it, so a repeated
micro-batch writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.security import RATE_LIMIT_MAX, RATE_LIMIT_WINDOW, rate_limit, request_windows
from clickloom.plans.swap import TableFiles

_REQUEST = "ip string, id bigint, ts bigint"
_CARRIED = "ip string, ts bigint, n bigint"
_DECIDED = f"{_REQUEST}, allowed boolean"


class CarriedLimits:
    """``take`` is given to ``foreachBatch``; ``flush`` decides what still waits when the stream has ended.

    Requests that come after their second was decided are too late: they have ``allowed`` null and count for nothing.
    """

    def __init__(self, root: str, max_requests: int = RATE_LIMIT_MAX, window: int = RATE_LIMIT_WINDOW, delay: int = 600):
        self.root, self.max_requests, self.window, self.delay = root.rstrip("/"), max_requests, window, delay

    def _before(self, files: TableFiles, number: int) -> int | None:
        return max((n for n in map(int, files.names("state")) if n < number), default=None)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        self._decide(batch.select("ip", "id", "ts").where("ip is not null"), batch_id, False)

    def flush(self, spark: SparkSession) -> None:
        files = TableFiles(spark, self.root)
        last = max(map(int, files.names("state")), default=-1)
        self._decide(spark.createDataFrame([], _REQUEST), last + 1, True)

    def _decide(self, rows: DataFrame, number: int, all_of_them: bool) -> None:
        spark, files = rows.sparkSession, TableFiles(rows.sparkSession, self.root)
        before, folder = self._before(files, number), f"{self.root}/state/{number}"

        def state(part: str, schema: str) -> DataFrame:
            if before is None:
                return spark.createDataFrame([], schema)
            return spark.read.schema(schema).parquet(f"{self.root}/state/{before}/{part}")

        done = state("time", "done bigint, newest bigint").first()
        done_before, newest_before = (done[0], done[1]) if done else (None, None)
        late = F.lit(False) if done_before is None else F.col("ts") <= done_before
        waiting = state("waiting", _REQUEST).unionByName(rows.where(~late))
        # Kept for the steps below: the micro-batch is read once.
        waiting.write.mode("overwrite").parquet(f"{folder}/all")
        waiting = spark.read.schema(_REQUEST).parquet(f"{folder}/all")
        newest = max((n for n in (waiting.agg(F.max("ts")).first()[0], newest_before) if n is not None), default=None)
        if newest is None:
            decided = None
        else:
            decided = newest if all_of_them else newest - self.delay
            decided = decided if done_before is None else max(decided, done_before)
        ready = waiting.where(F.lit(False) if decided is None else F.col("ts") <= decided)
        carried = state("carried", _CARRIED)
        out = rate_limit(ready, self.max_requests, self.window, carried=carried).select("ip", "id", "ts", "allowed")
        missed = rows.where(late).select("*", F.lit(None).cast("boolean").alias("allowed"))
        out.unionByName(missed).write.mode("overwrite").parquet(f"{self.root}/out/batch_id={number}")
        open_windows = request_windows(ready, self.window, carried=carried).where(
            F.lit(False) if decided is None else F.col("window_start") + self.window > decided)
        open_windows.select("ip", "ts", "n").write.mode("overwrite").parquet(f"{folder}/carried")
        rest = waiting if decided is None else waiting.where(F.col("ts") > decided)
        rest.write.mode("overwrite").parquet(f"{folder}/waiting")
        spark.createDataFrame([(decided, newest)], "done bigint, newest bigint").write.mode("overwrite").parquet(f"{folder}/time")
        files.delete(f"state/{number}/all")
        # The engine may repeat this micro-batch, but none before it.
        for old in map(int, files.names("state")):
            if old < (before if before is not None else number):
                files.delete(f"state/{old}")

    def decisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_DECIDED}, batch_id bigint").parquet(f"{self.root}/out").drop("batch_id")
