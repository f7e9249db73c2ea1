"""Streams: continuous ingestion, audit sink, windowed metrics with watermarks, state with a lifetime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling_metrics(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if ts.isStreaming else ts
    return ts.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def audit_sink(events: DataFrame, path: str, checkpoint: str):
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def ingest(docs: DataFrame, checkpoint: str, write):
    """Micro-batches handed to ``write(batch, id)``, the same transformations as in a batch."""
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def sliding_counts(events: DataFrame, window: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if ts.isStreaming else ts
    return ts.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))


def seen_counts(events: DataFrame, key: str, ttl_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, n: events of each key so far; a key that stays away for ``ttl_ms`` of event time is forgotten."""

    def count(k, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n, last = (state.get[0] if state.exists else 0), 0
        for b in batches:
            n += len(b)
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n,))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    timed = events.select(key, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy(key).applyInPandasWithState(count, f"{key} long, n long", "n long", "update", "EventTimeTimeout")


def write_once(made: DataFrame, path: str, batch_id: int) -> None:
    """The rows of a micro-batch in the folder of its number: a batch that is run again replaces what it wrote, so each counts once."""
    made.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest_once(docs: DataFrame, out: str, checkpoint: str, make=None):
    """A started stream whose batches, through ``make``, are each in ``out`` exactly once, however often they are run."""
    return ingest(docs, checkpoint, lambda df, n: write_once(df if make is None else make(df), out, n))


def run_to_end(stream: DataFrame, path: str, mode: str = "append", write=None) -> DataFrame:
    """Runs a stream over what is there, into parquet below ``path``, and reads it; ``write`` may change each batch first.

    Batches are written once each; in complete mode the last one is all there is.  Called again with the same path, it goes on.
    """
    spark, out = stream.sparkSession, f"{path}/out"

    def batch(df, n):
        made = df if write is None else write(df)
        if mode == "complete":
            made.write.mode("overwrite").parquet(out)
        else:
            write_once(made, out, n)

    q = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(out)
    return found if mode == "complete" else found.drop("batch")
