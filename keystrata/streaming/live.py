"""Structured Streaming forms: last value per key, and message delivery by a stream-static join."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="keystrata-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def last_values(log: DataFrame) -> DataFrame:
    """Streaming keyspace: the value of the largest seq per key, deletes kept as tombstones."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("cmd", "value"), "seq").alias("w")).select("key", "seq", F.col("w.cmd").alias("cmd"), F.col("w.value").alias("value"))


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns the result as a table; in
    update mode the last version of each key stands."""
    spark, at = df.sparkSession, work_folder(df.sparkSession)

    def put(batch: DataFrame, n: int):
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/part={n}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{at}/out").drop("part")


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EXPIRED = "key string, seq long, deadline long"


class Deadlines(StatefulProcessor):
    """State of a key: the seq and deadline of its last write.  A timer stands at the deadline; one
    that fires after a later write moved it finds another deadline and does nothing."""

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, deadline long")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for seq, deadline in zip(pdf["seq"], pdf["deadline"]):
                old = self.last.get() if self.last.exists() else None
                if old is None or seq > old[0]:
                    if old is not None:
                        self.handle.deleteTimer(int(old[1]))
                    self.last.update((int(seq), int(deadline)))
                    self.handle.registerTimer(int(deadline))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists():
            seq, deadline = self.last.get()
            if deadline == at:
                self.last.clear()
                yield pd.DataFrame({"key": [key[0]], "seq": [seq], "deadline": [deadline]})

    def close(self):
        pass


def expiring(writes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """key, seq, deadline of each key whose last write writes(key, seq, at timestamp, deadline ms)
    passed its deadline, emitted when the watermark of `at` does: state and timers are kept per
    key, so memory holds the keys with a deadline only.  Needs the RocksDB state store."""
    by = writes.withWatermark("at", late).groupBy("key")
    return by.transformWithStateInPandas(Deadlines(), EXPIRED, "Append", "EventTime")
