"""Streaming ingestion: landing folders, completed days, sessions, dedupe, versioned merge."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.partitioned import PartitionedVersions
from ..operators.similarity import cluster_batch
from ..session import scratch_path


def landing(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", fmt: str = "parquet",
            files_per_batch: int | None = None) -> DataFrame:
    """Files arriving in a folder as a stream."""
    r = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(folder)


def run_available(stream: DataFrame, mode: str, name: str, root: str | None = None) -> DataFrame:
    """Process what is there, write it to a table in the shared folder, and return that table."""
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    if mode == "append":
        q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", root + "/checkpoint")
             .trigger(availableNow=True).start(root + "/out"))
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/part={batch_id}")
        q = (stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", root + "/checkpoint")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(root + "/out")


def completed_days(readings: DataFrame, at: str, zone: str, keys: list[str], value: str, delay: str = "2 hours") -> DataFrame:
    """Daily mean and count in local time, emitted only once the day is over.

    The watermark sits on the shifted wall-clock column, because the window does.
    """
    d = readings.withColumn("local_ts", F.from_utc_timestamp(at, zone)).withWatermark("local_ts", delay)
    g = d.groupBy(F.window("local_ts", "1 day").alias("w"), *keys).agg(
        F.avg(value).alias("mean_value"), F.count(value).alias("n_readings"))
    return g.select(F.to_date("w.start").alias("day"), *keys, "mean_value", "n_readings")


def session_events(rows: DataFrame, at: str, key: str, gap: str, delay: str = "2 hours", value: str | None = None) -> DataFrame:
    """Sessions per key closed by a gap, emitted when the watermark passes them."""
    extra = [F.max(value).alias("max_value")] if value else []
    g = rows.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), *extra)
    end = F.col("w.end") - F.expr(f"INTERVAL {gap}")
    return g.select(key, F.col("w.start").alias("start_at"), end.alias("end_at"), "n", *(["max_value"] if value else []))


def first_arrivals(rows: DataFrame, at: str, key: list[str], delay: str = "2 days") -> DataFrame:
    """Drop repeats of a natural key that arrive within the delay of each other."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def message_counts(rows: DataFrame, at: str) -> DataFrame:
    """Running message count and last arrival (update or complete mode)."""
    return rows.groupBy().agg(F.count("*").alias("n_messages"), F.max(at).alias("last_message_at"))


def cluster_stream(rows: DataFrame, id_col: str, at: str, root: str, window_hours: int = 72, threshold: float = 0.6) -> DataFrame:
    """Cluster headlines as they arrive; rows carry ``tokens``. Each batch appends its own part of the table."""
    spark = rows.sparkSession
    schema = rows.schema
    ddl = schema.add("cluster_id", schema[id_col].dataType)

    def part(n: int) -> str:
        return f"{root}/clusters/batch={n}"

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = session.createDataFrame([], ddl)
        if batch_id:
            before = session.read.schema(ddl).parquet(*[part(n) for n in range(batch_id)])
        cluster_batch(before, batch, id_col, at, "tokens", window_hours, threshold).select(*ddl.names).write.mode("overwrite").parquet(part(batch_id))

    q = rows.writeStream.foreachBatch(step).option("checkpointLocation", root + "/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(ddl).parquet(f"{root}/clusters/*")


def merge_stream(rows: DataFrame, seen_at: str, root: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
                 on_change: Callable[[DataFrame, int], None] | None = None, buckets: int = 64) -> DataFrame:
    """Feed a stream into a versioned observation table.

    Every micro-batch is a commit of its own to a table in partitions: only partitions it touches are read and rewritten, and
    a batch that is run again after its commit stood changes nothing. ``prepare`` shapes a micro-batch into observation
    rows; ``on_change`` (derived series, rules) is called with the table only when the batch stored something new.
    """
    store = PartitionedVersions(rows.sparkSession, f"{root}/table", buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        own = PartitionedVersions(batch.sparkSession, f"{root}/table", buckets)
        done = own.absorb(batch_id, prepare(batch) if prepare else batch, seen_at)
        if on_change is not None and done.rewritten:
            on_change(own.read(batch_id), batch_id)

    q = (rows.writeStream.foreachBatch(step).option("checkpointLocation", root + "/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store.read()
