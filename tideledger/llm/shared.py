"""Written tables in the shared folder, and input columns made safe."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.session import checkpoint_folder

ARROW_ROWS = 1000
NO_ID = -(1 << 63)


class Workspace:
    """Tables written to the folder of spark.checkpoint.dir, which every executor can read.

    A written table cuts the lineage: a lost executor costs its running tasks, not the
    stages before.  `drop` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def free(self) -> None:
        """Lets Spark remove shuffle files of finished steps now, not at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            parents = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
            for parent in parents:
                if parent.split("://")[-1].lstrip("/").startswith(self.folder.split("://")[-1].split(":")[-1].lstrip("/")):
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(parent)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the input has; a missing one is an error."""
    return docs.select(*[docs[f"`{c}`"].alias(c) for c in columns])


def id_of(column: str) -> Column:
    """The id as a long; a null one as the smallest long, so that joins and arrays hold it."""
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(NO_ID))


def id_back(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by)
