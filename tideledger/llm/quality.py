"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

One pass turns every document into a row of statistics, written to the shared folder.  The
trees are fitted on at most about `rows` labelled rows (documented bound), picked by a hash of
the id; what reaches the driver are their statistics.  Scoring reads the written rows.  An id
with several texts is learned with the one of the least statistics, an id with both labels
with each of them.

Defined results: null and empty texts have statistics too and get a score; with no labelled
row of one of the classes every score is the share of label 1, or 0.5; a label row that
repeats counts once per repetition; repeated documents get equal scores; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.llm import forest
from tideledger.llm.language import last_hash
from tideledger.llm.shared import Workspace, bare, small_batches
from tideledger.llm.statistics import NAMES, statistics
from tideledger.llm.words import pieces

ROWS = 20_000


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc, features): the statistics as 32-bit floats."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                rows = [x.tobytes() for x in statistics(piece).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.rows), pa.array(rows, pa.binary())], ["doc", "features"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(describe, "doc long, features binary")


def sampled(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """About `rows` labelled ids (doc, y), picked by a hash."""
    own = bare(labels, key, label).where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), (F.col(label) > 0).cast("int").alias("y"))
    return own.where(F.xxhash64("doc", F.lit(17)) <= last_hash(max(1, own.count()), rows)).limit(2 * rows)


def matrix(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(rows, key=lambda r: r["doc"])
    x = np.array([np.frombuffer(bytes(r["features"]), np.float32) for r in rows], np.float64).reshape(-1, width)
    return x, np.array([r["y"] for r in rows], np.float64)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS) -> DataFrame:
    """Per document row: id, score (0 to 1)."""
    spark = docs.sparkSession
    small_batches(spark)
    features = Workspace(spark, "quality").keep(described(bare(docs, key, text), key, text), "features")
    # A label belongs to one text of its id, however many rows the id has; label rows count each.
    one = features.join(sampled(labels, key, label, rows).groupBy("doc", "y").agg(F.count("*").alias("times")), "doc").groupBy("doc", "y", "times").agg(F.min("features").alias("features"))
    sample = one.select("doc", "features", "y", F.explode(F.expr("array_repeat(0, cast(times as int))"))).collect()
    x, y = matrix(sample, len(NAMES))
    model = spark.sparkContext.broadcast(forest.fit(x, y))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64) if raw else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.sigmoid(model.value.margins(x)))], ["doc", "score"])

    return features.mapInArrow(predict, "doc long, score double").withColumnRenamed("doc", key)
