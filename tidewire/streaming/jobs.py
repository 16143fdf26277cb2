"""Structured Streaming: dedup, windows, counters with reset, and upserts of micro-batches.

Every job reads a folder or glob as a stream, keeps its offsets and state in
the shared checkpoint folder, and runs over what is there (``availableNow``);
the same jobs run continuously with another trigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The event table as a stream with event time in ``at``."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    name = f"{table}.parque[t]"  # a glob, so that one file works as well as a folder
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}")
    return df.withColumn("at", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per key and tumbling window that the watermark has closed."""
    w = F.window("at", width)
    out = stream.withWatermark("at", delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def session_counts(stream: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts per key and session that the watermark has closed."""
    w = F.session_window("at", gap)
    return stream.withWatermark("at", delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), key, "n")


def reset_counters(stream: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Counters of attempts and failures per key in windows that open at the first row and reset after ``hours``.

    The window is not aligned to the clock, so it is state of the key. One row
    per key and micro-batch: its counters after the batch.
    """
    out = f"{key} long, opened_at timestamp, attempts long, failures long"
    state = "opened timestamp, attempts long, failures long"

    def update(k: tuple, batches: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        opened, attempts, failures = group.get if group.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for at, kind in zip(rows["at"], rows["event_type"]):
            if opened is None or (at - pd.Timestamp(opened)).total_seconds() >= hours * 3600:
                opened, attempts, failures = at, 0, 0
            attempts += 1
            failures += kind == "error"
        group.update((pd.Timestamp(opened).to_pydatetime(), int(attempts), int(failures)))
        yield pd.DataFrame({key: [k[0]], "opened_at": [opened], "attempts": [attempts], "failures": [failures]})

    return stream.groupBy(key).applyInPandasWithState(update, out, state, "update", "NoTimeout")


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the versions under a target folder, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [f.getPath() for f in fs.listStatus(path) if f.isDirectory() and f.getPath().getName()[:1] == "v" and f.getPath().getName()[1:].isdigit()]
    return sorted(int(p.getName()[1:]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def upsert_batches(stream: DataFrame, target: str, key: str, order: str, keep: int = 2) -> None:
    """Keep the latest row of each key in a parquet table under ``target``; a batch writes a new version beside the old ones.

    The stream's state lies in the target folder, so a restart goes on where
    the last run ended and merges into what is stored. A version is named by
    its batch behind those that were there before the stream's first one; a
    batch that is replayed after a failure writes the same version again. Older
    versions than ``keep`` are removed. Rows without a key are left out.
    """
    spark = stream.sparkSession
    offset_path = f"{target}/_offset"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm_path(f"{target}/_state")) and fs.exists(jvm_path(f"{offset_path}/_SUCCESS")):
        offset = spark.read.parquet(offset_path).first()[0]
    else:  # a first run, or one whose state is lost: what is stored stays below
        offset = max(_versions(spark, target), default=-1) + 1
        spark.range(offset, offset + 1).coalesce(1).write.mode("overwrite").parquet(offset_path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        cols, version = batch.columns, offset + batch_id
        stored = [v for v in _versions(spark, target) if v < version]
        rows = batch
        if stored:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/v{stored[-1]}").unionByName(batch)
        latest = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{target}/v{version}")
        for v in stored[: 1 - keep] if keep > 1 else stored:
            fs.delete(jvm_path(f"{target}/v{v}"), True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{target}/_state").trigger(availableNow=True).start().awaitTermination()


def current_version(spark: SparkSession, target: str) -> DataFrame:
    """The table after the latest finished batch."""
    return spark.read.parquet(f"{target}/v{_versions(spark, target)[-1]}")
