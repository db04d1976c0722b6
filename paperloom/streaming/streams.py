"""Progress, quality and logs as streams (SM1-SM10, WN6), on Structured Streaming.

Each function takes a streaming DataFrame; the same logic in batch is in ``operators.ordered``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly(events: DataFrame, time: str, value: str, late: str = "1 hour") -> DataFrame:
    """SM5, AG22: operations and mean value per hour, late ones up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("hour"), "n", "mean_value")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """SM10: pairs of start and end of work per key, as sessions without a longer gap."""
    got = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deliveries_once(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """SM4: an entry delivered twice within the watermark counts once."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_status(events: DataFrame, key: str, time: str) -> DataFrame:
    """SM4: running state of each key: the status logged last, ties by entry."""
    return events.groupBy(key).agg(F.max_by("status", F.struct(time, "entry_id")).alias("status"), F.count(F.lit(1)).alias("n_states"))


def chunk_metrics(chunks: DataFrame, key: str, text: str, time: str) -> DataFrame:
    """SM1-SM3: characters, words and chunks so far of each streamed answer."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length(text)).alias("n_chars"), F.sum(words).alias("n_words"), F.min(time).alias("first"), F.max(time).alias("last"))


def dedup_since_last_kept(log: DataFrame, key: str, seconds: float = 1.0) -> DataFrame:
    """SM9, WN6: (key, event_id, t) of messages not within ``seconds`` of the last one of their key that was kept.

    ``log`` has the key, event_id and t in seconds. The state of a key is one number; it is kept for as
    long as the query runs, since a dropped message does not extend the horizon."""

    def keep(name, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            if last is None or r.t - last > seconds:
                last = float(r.t)
                out.append((name[0], int(r.event_id), float(r.t)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", "t"])

    kind = dict(log.dtypes)[key]
    return log.select(key, "event_id", "t").groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, event_id bigint, t double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """SM6-SM8: the whole result of all that is there now, written anew to a folder with each batch; goes on from the checkpoint."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(path)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """SM6-SM8: all that is there now appended to a folder; stopped and resumed by its checkpoint."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
