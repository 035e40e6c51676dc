"""Micro-batch ingestion of the event stream.

``Ingest.process`` is a ``foreachBatch`` function.  A batch is written under
its own batch id with overwrite, so a retried batch replaces itself; the
manifest row is written last and makes the batch visible.  Anything that would
rewrite the past goes to the quarantine folder or stops the query.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideledger.errors import DataQualityError
from tideledger.operators import checks, signals
from tideledger.operators.checks import require_clean, with_event_id
from tideledger.operators.ledger import kind_is, sequence
from tideledger.params import AsOf, Coverage, Registry
from tideledger.schema import EVENT, RESET_KINDS, TRADING_KINDS
from tideledger.streaming.state import merge_positions

MANIFEST = (
    "batch_id long, last_seq long, last_event_id string, last_ms long, processed_block long, coverage_start long, events long,"
    " ids_hash string, quarantined boolean, reason string"
)
STALL_MS, SUCCESS_MS = 120_000, 90_000


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of the append-only event folder; offsets live in the query checkpoint."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated ids that arrive within the watermark; state is bounded by it."""
    timed = with_event_id(stream).withColumn("event_time", F.timestamp_millis("timestamp_ms"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def hourly_flows(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Hourly partial flows per market, closed by the watermark (append mode)."""
    fill, resets = kind_is("maker_fill"), kind_is(*RESET_KINDS)
    timed = stream.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay)
    return (
        timed.where(kind_is(*TRADING_KINDS))
        .groupBy(F.window("event_time", "1 hour").alias("hour"), "perpetual_id")
        .agg(
            F.coalesce(F.sum(F.when(fill, F.col("price_pns") * F.col("lot_lns"))), F.lit(0)).alias("volume_native"),
            F.count(F.when(fill, F.lit(1))).alias("trades"),
            F.coalesce(F.sum(F.when(fill, F.col("fee_cns"))), F.lit(0)).alias("fill_fees_cns"),
            F.count(F.when(resets, F.lit(1))).alias("resets"),
        )
        .select(F.col("hour.start").alias("hour_start"), "perpetual_id", "volume_native", "trades", "fill_fees_cns", "resets")
    )


def rolling_from_hours(hours: DataFrame, events: DataFrame, as_of: AsOf, length_ms: int) -> DataFrame:
    """Window volume per market from closed hours plus the raw events around them.

    Raw events are read for the first, cut hour and for the time after the last
    hour the watermark has closed.
    """
    start = as_of.timestamp_ms - length_ms
    hour_ms = 3_600_000
    first_whole = -(-start // hour_ms) * hour_ms
    begin = F.unix_millis(F.col("hour_start"))
    closed = hours.agg(F.max(begin).alias("h")).first().h
    last_whole = first_whole if closed is None else max(first_whole, closed + hour_ms)
    last_whole = min(last_whole, max(first_whole, (as_of.timestamp_ms + 1) // hour_ms * hour_ms))
    whole = hours.where((begin >= first_whole) & (begin < last_whole)).select("perpetual_id", "volume_native", "trades")
    edge_time = ((F.col("timestamp_ms") >= start) & (F.col("timestamp_ms") < first_whole)) | (F.col("timestamp_ms") >= last_whole)
    edge = events.where(kind_is("maker_fill") & as_of.includes() & edge_time).select(
        "perpetual_id", (F.col("price_pns") * F.col("lot_lns")).alias("volume_native"), F.lit(1).cast("long").alias("trades")
    )
    return whole.unionByName(edge).groupBy("perpetual_id").agg(
        F.sum("volume_native").alias("volume_native"), F.sum("trades").alias("trades")
    ).where("trades > 0")


def canonical_only(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """After a reorganisation: only rows whose block hash is the canonical one."""
    return events.join(blocks.select("block_number", "block_hash"), ["block_number", "block_hash"], "left_semi")


def freshness(status: DataFrame, now_ms: int, max_lag_blocks: int) -> DataFrame:
    """Availability of a served stream from its observation rows."""
    reason = (
        F.when(F.col("quarantined"), "quarantined")
        .when(F.lit(now_ms) - F.col("last_success_ms") > SUCCESS_MS, "no-recent-success")
        .when(F.lit(now_ms) - F.col("last_progress_ms") > STALL_MS, "no-block-progress")
        .when(F.col("head_block") - F.col("processed_block") > max_lag_blocks, "lagging")
    )
    return status.withColumns({"reason": reason, "available": reason.isNull()})


@dataclass(frozen=True)
class Ingest:
    """Folders and limits of one ingestion query."""

    spark: SparkSession
    root: str
    registry: Registry
    coverage_start: int
    max_events: int | None = None

    def folder(self, name: str, batch_id: int) -> str:
        return f"{self.root}/{name}/batch_id={batch_id}"

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            # Only a table without any file is a fresh start; a damaged one stops the query.
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def last(self):
        rows = self._read("manifest", MANIFEST)
        return None if rows is None else rows.agg(F.max_by(F.struct("*"), "batch_id").alias("m")).first().m

    def events(self) -> DataFrame | None:
        """Committed events: only batches that have an accepted manifest row."""
        rows, done = self._read("events"), self._read("manifest", MANIFEST)
        if rows is None or done is None:
            return None
        # Manifest rows are one per micro-batch.
        return rows.join(F.broadcast(done.where("not quarantined").select("batch_id")), "batch_id", "left_semi")

    def state(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(self.folder("state", batch_id))

    def verify_anchor(self, source: DataFrame) -> None:
        """The last ingested event must still be in the source, unchanged."""
        last = self.last()
        if last is None:
            return
        same = with_event_id(source).where(
            (F.col("event_id") == last.last_event_id) & (sequence() == last.last_seq) & (F.col("timestamp_ms") == last.last_ms)
        )
        if not same.take(1):
            raise DataQualityError("the last ingested event is no longer in the source")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        last = self.last()
        if last is not None and last.quarantined:
            raise DataQualityError(f"stream is quarantined: {last.reason}")
        if last is not None and last.batch_id == batch_id:
            last = self._before(batch_id)
        if last is not None and last.coverage_start != self.coverage_start:
            raise DataQualityError("coverage start changed")
        after = -1 if last is None else last.last_seq
        rows = with_event_id(batch).drop("event_time").persist()
        try:
            self._commit(rows, batch_id, after, last)
        finally:
            rows.unpersist()

    def _before(self, batch_id: int):
        rows = self._read("manifest", MANIFEST).where(F.col("batch_id") < batch_id)
        return rows.agg(F.max_by(F.struct("*"), "batch_id").alias("m")).first().m

    def _commit(self, rows: DataFrame, batch_id: int, after: int, last) -> None:
        late = rows.where(sequence() <= after)
        fresh = rows.where(sequence() > after)
        facts = fresh.agg(
            F.count(F.lit(1)).alias("n"), F.max(sequence()).alias("seq"), F.max("block_number").alias("block"),
            F.max("timestamp_ms").alias("ms"), F.max_by("event_id", sequence()).alias("id"), F.max_by("timestamp_ms", sequence()).alias("last_ms"),
        ).first()
        late.write.mode("overwrite").parquet(self.folder("late", batch_id))
        if facts.n == 0:
            return
        if self.max_events is not None and facts.n > self.max_events:
            raise DataQualityError(f"batch holds more than {self.max_events} events")
        as_of = AsOf(self.registry.chain_id, facts.block, "", facts.ms)
        require_clean(checks.validate_events(fresh), "invalid event in stream")
        require_clean(checks.ledger_guards(fresh, self.registry, as_of), "ledger guard in stream")
        fresh.write.mode("overwrite").parquet(self.folder("events", batch_id))
        prior = None if last is None else self.state(last.batch_id)
        merge_positions(prior, fresh, as_of).write.mode("overwrite").parquet(self.folder("state", batch_id))
        self._manifest(batch_id, facts, as_of)

    def _manifest(self, batch_id: int, facts, as_of: AsOf, quarantined: bool = False, reason: str | None = None) -> None:
        row = (batch_id, facts.seq, facts.id, facts.last_ms, as_of.block_number, self.coverage_start, facts.n, "", quarantined, reason)
        frame = self.spark.createDataFrame([row], MANIFEST).drop("batch_id")
        frame.write.mode("overwrite").parquet(self.folder("manifest", batch_id))

    def accept_cutoff(self, processed_block: int, cutoff_block: int, ids_hash: str, previous: dict | None) -> dict:
        """Accept an evaluation cutoff, or quarantine on regression or changed facts."""
        now = dict(processed_block=processed_block, cutoff_block=cutoff_block, ids_hash=ids_hash)
        if previous is None:
            return now
        reason = None
        if processed_block < previous["processed_block"] or cutoff_block < previous["cutoff_block"]:
            reason = "cutoff or processed block went back"
        elif cutoff_block == previous["cutoff_block"] and ids_hash != previous["ids_hash"]:
            reason = "the same cutoff has other facts"
        if reason is not None:
            last = self.last()
            if last is not None:
                frame = self._read("manifest", MANIFEST).where(F.col("batch_id") == last.batch_id)
                marked = frame.withColumns({"quarantined": F.lit(True), "reason": F.lit(reason)}).drop("batch_id")
                marked.write.mode("overwrite").parquet(self.folder("manifest", last.batch_id + 1))
            raise DataQualityError(f"quarantined: {reason}")
        return now

    def carry_signals(self, report: DataFrame, as_of: AsOf, batch_id: int) -> DataFrame:
        """Compare a report with the last stored one and store the result."""
        stored = self._read("signals")
        current = report
        if stored is not None:
            before = stored.where(F.col("batch_id") < batch_id)
            last = before.agg(F.max("batch_id").alias("b")).first().b
            if last is not None:
                previous = self.spark.read.parquet(self.folder("signals", last))
                block = previous.agg(F.max("as_of_block").alias("b")).first().b
                if block is not None:
                    current, _ = signals.carry_forward(previous, block, None, report, as_of)
        path = self.folder("signals", batch_id)
        current.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def start(self, stream: DataFrame, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()

    def with_start(self, coverage_start: int) -> "Ingest":
        return replace(self, coverage_start=coverage_start)


def processed_progress(manifest: DataFrame, coverage: Coverage) -> DataFrame:
    """The block watermark is the indexer's, not the last event's: quiet is not stalled."""
    seen = manifest.agg(F.max("processed_block").alias("last_event_block"))
    return seen.select(
        F.lit(coverage.processed_block).cast("long").alias("processed_block"),
        "last_event_block",
        (F.lit(coverage.processed_block) - F.col("last_event_block")).alias("silence_blocks"),
    )
