"""Shared Spark plumbing: table access, lineage cuts, hot-key joins, Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: A key is hot when it alone holds more than one in HOT_SHARE rows. At most HOT_SHARE keys can
#: be hot, which is the proof of the size bound for everything that is broadcast about them.
HOT_SHARE = 1000
#: Below this many rows per key a key is never worth special handling.
HOT_FLOOR = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the one all executors share, which `spark.checkpoint.dir` names.

    Where the setting is missing a local session gets a temporary folder; a cluster's executors could
    not read that, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="turnsieve-")
    return f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder the session names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def hot_keys(df: DataFrame, key: str, floor: int = HOT_FLOOR) -> list:
    """Keys that hold more than one in HOT_SHARE rows, so at most HOT_SHARE of them.

    One aggregation over the key column; the number of all rows is counted only if a key is large
    enough to matter.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    largest = counts.where(F.col("n") > floor).orderBy(F.col("n").desc(), key).limit(HOT_SHARE).collect()
    if not largest:
        return []
    total = df.count()
    return [r[0] for r in largest if r["n"] * HOT_SHARE > total]


def hot_join(left: DataFrame, right: DataFrame, key: str, floor: int = HOT_FLOOR, counts: DataFrame | None = None) -> DataFrame:
    """Left join of many rows (`left`) with one row per key (`right`), safe under skew.

    A key with more than `floor` rows is hot; at most HOT_SHARE keys are, the largest, so that any other
    key holds less than one in HOT_SHARE rows. Rows of cold keys meet their partner in one shuffle, which
    keeps the partitioning `right` has from being aggregated by its key. Rows of hot keys are divided
    by a hash of themselves into one part for each `floor` rows, and their few partners are repeated
    for every part. Only the hash and number of parts of hot keys are broadcast, 12 bytes each.
    It is one lazy plan; no job runs while it is built. Null keys keep a null partner; no row is
    dropped or repeated. `counts` (key, n) saves counting the keys where they have been counted.
    """
    hashed = F.xxhash64(key)
    sizes = (left.groupBy(hashed.alias("_key")).agg(F.count("*").alias("_n")) if counts is None else counts.select(hashed.alias("_key"), F.col("n").alias("_n"))).where(F.col("_n") > floor)
    hot = F.broadcast(sizes.orderBy(F.col("_n").desc(), "_key").limit(HOT_SHARE).select("_key", F.ceil(F.col("_n") / floor).cast("int").alias("_parts")))
    keyed, one = left.withColumn("_key", hashed), right.withColumn("_key", hashed).join(hot, "_key")
    cold = keyed.join(hot, "_key", "left_anti").drop("_key").join(right, key, "left")
    whole = [F.col(f.name) for f in left.schema.fields if isinstance(f.dataType, AtomicType)]
    many = keyed.join(hot, "_key").withColumn("_part", F.pmod(F.xxhash64(*whole), F.col("_parts")).cast("int")).drop("_parts", "_key")
    few = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_key")
    return cold.unionByName(many.join(few, [key, "_part"], "left").drop("_part"))


def map_rows(df: DataFrame, fn: Callable[[list[list]], list[list]], schema: str) -> DataFrame:
    """Apply `fn` to Arrow batches as column lists; returns columns in the order of `schema`.

    `fn` gets one Python list for each input column and returns one list for each output column
    (any number of rows). Text is converted once for each batch, never row by row through pickle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                columns = fn([part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy rows when the input has fewer splits than the session cores.

    Large inputs have more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
