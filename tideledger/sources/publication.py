"""Publishing one compact snapshot per source, versioned and never regressing.

Each accepted snapshot is a new version folder; the newest version is served.
One writer per source is assumed, as one streaming query gives.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.functions.keys import digest_text
from tideledger.operators.evidence import checkpoint_hash
from tideledger.streaming.store import Commit, Store

MAX_BYTES = 1_000_000
SNAPSHOT_SCHEMA = (
    "source string, version long, as_of_block long, as_of_log int, as_of_block_hash string, processed_block long,"
    " inputs_hash string, payload string, content_hash string, observed_at_ms long"
)
FACTS = ["as_of_block_hash", "inputs_hash"]


def _versions(spark: SparkSession, path: str, source: str) -> DataFrame:
    try:
        rows = spark.read.schema(SNAPSHOT_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # only a missing folder is a fresh start
            raise
        rows = spark.createDataFrame([], SNAPSHOT_SCHEMA)
    return rows.where(F.col("source") == source)


def latest(spark: SparkSession, path: str, source: str):
    newest = _versions(spark, path, source).agg(F.max_by(F.struct("*"), "version").alias("s")).first()
    return newest.s


def compact(tables: dict[str, DataFrame], limit_bytes: int = MAX_BYTES) -> DataFrame:
    """One JSON payload of the small tables of a snapshot, bounded in size.

    Row sizes are added up first, so nothing beyond the bound is collected into a row.
    """
    parts = None
    for name, table in tables.items():
        rows = table.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("row"))
        parts = rows if parts is None else parts.unionByName(rows)
    size = parts.agg(F.coalesce(F.sum(F.length("row") + 1), F.lit(0)).alias("n")).first().n
    if size > limit_bytes:
        raise DataQualityError("compact snapshot exceeds its size bound")
    grouped = parts.groupBy("name").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    item = F.struct("name", "rows")
    return grouped.agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))


def publish_snapshot(
    payload: DataFrame, path: str, source: str, *, as_of_block: int, as_of_log: int | None, as_of_block_hash: str,
    processed_block: int, inputs_hash: str, observed_at_ms: int | None = None,
) -> int:
    """Write the next version, unless it regresses or contradicts the last one."""
    if not 1 <= len(source.encode()) <= 64:
        raise DataQualityError("publication source must be 1..64 bytes")
    spark = payload.sparkSession
    last = latest(spark, path, source)
    top = 2**32 - 1
    mine = (as_of_block, top if as_of_log is None else as_of_log)
    if last is not None:
        theirs = (last.as_of_block, top if last.as_of_log is None else last.as_of_log)
        facts = {"as_of_block_hash": as_of_block_hash, "inputs_hash": inputs_hash}
        same_facts = all(last[f] == facts[f] for f in FACTS)
        if theirs > mine or last.processed_block > processed_block or (theirs == mine and not same_facts):
            raise DataQualityError("publication regresses or contradicts the same cutoff")
    version = 0 if last is None else last.version + 1
    now = int(time.time() * 1000) if observed_at_ms is None else observed_at_ms
    row = payload.select(
        F.lit(source).alias("source"), F.lit(version).cast("long").alias("version"), F.lit(as_of_block).cast("long").alias("as_of_block"),
        F.lit(as_of_log).cast("int").alias("as_of_log"), F.lit(as_of_block_hash).alias("as_of_block_hash"),
        F.lit(processed_block).cast("long").alias("processed_block"), F.lit(inputs_hash).alias("inputs_hash"), "payload",
        digest_text(F.col("payload")).alias("content_hash"), F.lit(now).cast("long").alias("observed_at_ms"),
    )
    row.write.mode("append").parquet(path)
    return version


def _advances(last: dict | None, facts: dict) -> bool:
    """Whether a cutoff follows the last one, or repeats it with the same facts."""
    if last is None:
        return True
    top = 2**32 - 1
    mine, theirs = ((x["as_of_block"], top if x["as_of_log"] is None else x["as_of_log"]) for x in (facts, last))
    same = all(last[c] == facts[c] for c in FACTS)
    return theirs <= mine and last["processed_block"] <= facts["processed_block"] and (theirs != mine or same)


def publish_tables(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, source: str, *, as_of_block: int, as_of_log: int | None,
    as_of_block_hash: str, processed_block: int, inputs_hash: str, observed_at_ms: int | None = None,
) -> int:
    """Publishes tables of any size as the next version of a source.

    The tables are written first; the commit file of the version is then created without
    overwriting.  Of two writers that read the same last version one wins and the other raises.
    """
    if not 1 <= len(source.encode()) <= 64 or "/" in source:
        raise DataQualityError("publication source must be 1..64 bytes without a slash")
    store = Store(spark, f"{root}/{source}")
    last = store.last()
    facts = dict(as_of_block=as_of_block, as_of_log=as_of_log, as_of_block_hash=as_of_block_hash, processed_block=processed_block, inputs_hash=inputs_hash)
    if not _advances(None if last is None else last.facts, facts):
        raise DataQualityError("publication regresses or contradicts the same cutoff")
    version = 0 if last is None else last.version + 1
    token = store.token(version)
    folders, hashes = {}, {}
    for name, table in tables.items():
        folders[name] = store.write(None, token, name, table, F.lit("all"))
        written = store.read(Commit(version, {name: folders[name]}), name)
        told = None if written is None else checkpoint_hash(written, sorted(table.columns)).first()
        hashes[name] = None if told is None else told.hash
    now = int(time.time() * 1000) if observed_at_ms is None else observed_at_ms
    store.commit(Commit(version, folders, {**facts, "observed_at_ms": now, "hashes": hashes}))
    return version


def load_tables(spark: SparkSession, root: str, source: str, max_age_s: int, now_ms: int | None = None) -> dict[str, DataFrame]:
    """Tables of the newest version, if it is fresh and they are what was published."""
    if not 1 <= max_age_s <= 86_400:
        raise DataQualityError("snapshot age must be 1..86400 seconds")
    store = Store(spark, f"{root}/{source}")
    last = store.last()
    if last is None:
        raise DataQualityError("snapshot is missing")
    age = (int(time.time() * 1000) if now_ms is None else now_ms) - last.facts["observed_at_ms"]
    if not 0 <= age <= max_age_s * 1000:
        raise DataQualityError("snapshot is stale")
    tables = {}
    for name in last.tables:
        rows = store.read(last, name)
        if rows is None:
            continue
        tables[name] = rows.drop("bucket")
        if checkpoint_hash(tables[name], sorted(tables[name].columns)).first().hash != last.facts["hashes"][name]:
            raise DataQualityError("snapshot content does not match its hash")
    return tables


def load_snapshot(spark: SparkSession, path: str, source: str, max_age_s: int, now_ms: int | None = None):
    """The newest snapshot, if fresh and unchanged since it was written."""
    if not 1 <= max_age_s <= 86_400:
        raise DataQualityError("snapshot age must be 1..86400 seconds")
    newest = _versions(spark, path, source).agg(F.max_by(F.struct("*"), "version").alias("s")).select("s.*")
    row = newest.withColumn("intact", digest_text(F.col("payload")) == F.col("content_hash")).first()
    if row is None or row.version is None:
        raise DataQualityError("snapshot is missing")
    age = (int(time.time() * 1000) if now_ms is None else now_ms) - row.observed_at_ms
    if not 0 <= age <= max_age_s * 1000:
        raise DataQualityError("snapshot is stale")
    if not row.intact:
        raise DataQualityError("snapshot content does not match its hash")
    return row
