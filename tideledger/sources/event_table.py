"""The canonical event table: Parquet, partitioned by chain and block bucket.

Rows are range-clustered by (block, log) inside a bucket, so block filters
prune partitions and row groups; account and market filters use row-group
statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.operators.checks import event_rules, exploded, require_clean, with_event_id
from tideledger.schema import EVENT

BUCKET_BLOCKS = 216_000  # a day of 400 ms blocks


def bucket_of(block) -> "F.Column":
    return F.floor(block / BUCKET_BLOCKS).cast("long")


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Range-partition by block so one task writes one stretch of one bucket."""
    rows = with_event_id(events).withColumn("block_bucket", bucket_of(F.col("block_number")))
    (
        rows.repartitionByRange("chain_id", "block_bucket", "block_number", "log_index")
        .sortWithinPartitions("chain_id", "block_bucket", "block_number", "log_index")
        .write.partitionBy("chain_id", "block_bucket")
        .mode(mode)
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str, from_block: int | None = None, to_block: int | None = None) -> DataFrame:
    """The table, with block bounds turned into partition bounds."""
    rows = spark.read.parquet(path)
    if from_block is not None:
        rows = rows.where((F.col("block_bucket") >= from_block // BUCKET_BLOCKS) & (F.col("block_number") >= from_block))
    if to_block is not None:
        rows = rows.where((F.col("block_bucket") <= to_block // BUCKET_BLOCKS) & (F.col("block_number") <= to_block))
    names = [f.name for f in EVENT.fields if f.name in rows.columns]
    return rows.select(*names, "event_id")


def append_events(events: DataFrame, path: str) -> None:
    """Append a validated batch; an id that exists already is an error.

    An id contains its block hash, so only the block range of the batch is read.
    """
    spark = events.sparkSession
    rows = with_event_id(events)
    require_clean(exploded(rows, ["event_id"], event_rules(rows)), "invalid event")
    require_clean(rows.groupBy("event_id").count().where("count > 1"), "repeated event in batch")
    ends = rows.agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi")).first()
    if ends.lo is None:
        raise DataQualityError("nothing to append")
    known = read_events(spark, path, ends.lo, ends.hi).select("event_id")
    require_clean(rows.select("event_id").join(known, "event_id", "left_semi"), "event exists already")
    write_events(rows, path, "append")
