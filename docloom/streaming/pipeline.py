"""Streams: the ingestion pipeline with its status rule, and windowed counts with late data."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.documents import final_status
from docloom.operators.files import validated

THRESHOLD, TRIES, DEEPEST = 0.3, 3, 20


def daily_counts(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Events and values of each day and type; the same plan over a table or a stream."""
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    days = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return days.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def process(batch: DataFrame, recognise: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """Files to documents: recognise adds text and confidence by path, classify a type by path."""
    good = validated(batch, "path", "length").filter("valid")
    read = good.select("path", "length", "modificationTime").join(recognise(good), "path", "left")
    typed = read.join(classify(read.select("path", "text")), "path", "left")
    return typed.withColumn("status", final_status(F.col("text"), F.lit(False), F.coalesce("confidence", F.lit(0.0)), threshold))


def ingest(stream: DataFrame, out: str, checkpoint: str, recognise, classify, threshold: float = THRESHOLD, wait: float = 1.0) -> StreamingQuery:
    """Run the pipeline over a landing stream; a batch that is replayed overwrites its own folder.

    What fails is tried again after waits that double; then it is cut in two by hashes of paths, and so on, until the
    files that cannot be processed stand alone and are quarantined with their error.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for folder in ("documents", "quarantine"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{folder}/batch={number}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        h, todo = F.xxhash64("path"), [(batch, 0, "all")]
        while todo:
            part, bits, name = todo.pop()
            for attempt in range(TRIES if not bits else 1):
                try:
                    process(part, recognise, classify, threshold).write.mode("overwrite").parquet(f"{out}/documents/batch={number}/part={name}")
                    break
                except Exception as e:  # noqa: BLE001  recorded below
                    last = e
                    time.sleep(wait * 2**attempt if not bits else 0)
            else:
                if bits < DEEPEST and len(part.select("path").limit(2).collect()) > 1:
                    todo += [(part.filter(F.getbit(h, F.lit(bits)) == k), bits + 1, f"{name}{k}") for k in (0, 1)]
                    continue
                failed = part.select("path", F.lit(TRIES).alias("tries"), F.lit(str(last)[:500]).alias("error_log"), F.lit("failed").alias("status"))
                failed.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}/part={name}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
