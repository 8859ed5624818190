"""Resumable scoring as a stream: files in, scored rows out, each key once.

Input may be delivered more than once. State is bounded by the watermark for the deduplication of
the stream, and the sink is keyed by batch, so that a batch which runs again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of keys in a sink.
BUCKETS = 64


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as a stream; a single file is read from its folder by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the delay; later repeats are caught by the sink's own keys."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def bucket(key: str) -> Column:
    """Bucket of a key in a keyed sink."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def run_to_end(stream: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, sink: str, checkpoint: str) -> None:
    """Score everything that is there, append rows whose key the sink lacks, and stop.

    The sink is divided by buckets of the key and by batch. A batch reads the key column of the buckets that
    it touches only, and replaces what an earlier run of itself has written.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        rows = score(batch).dropDuplicates([key]).withColumn("bucket", bucket(key))
        if _exists(spark, sink):
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
            done = spark.read.parquet(sink).where(F.col("bucket").isin(touched) & (F.col("batch") != number)).select(key)
            rows = rows.join(done, key, "left_anti")
        writer = rows.withColumn("batch", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch", "bucket").parquet(sink)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_updates(stream: DataFrame, keys: list[str], sink: str, checkpoint: str) -> None:
    """Write the changed rows of an aggregate after each batch into the sink's folder of that batch, and stop
    at the end. Nothing but changed groups moves, nothing reaches the driver."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_updates(spark: SparkSession, sink: str, keys: list[str], schema: str) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.schema(schema + ", batch bigint").parquet(sink)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def latest_values(stream: DataFrame, key: str, time: str, value: str, delay: str, window: str) -> DataFrame:
    """Latest value of each key in each event-time window, late rows dropped beyond the delay."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return marked.groupBy(F.window(time, window), key).agg(F.max_by(value, time).alias(value), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, value, "n")
