import pytest
from pyspark.sql import functions as F

import cohort as sample
import kit
from tideledger.errors import DataQualityError
from tideledger.operators import ledger
from tideledger.params import AsOf
from tideledger.schema import EVENT
from tideledger.streaming import ingest, state

CUT_MS = sample.T0 + 10 * sample.DAY
CUT = AsOf(143, sample.block_at(CUT_MS), "0xcut", CUT_MS)


def write_parts(spark, path, parts):
    """The cohort in time order, one file per part."""
    rows = sorted(sample.ROWS, key=lambda r: (r["block_number"], r["log_index"]))
    size = -(-len(rows) // parts)
    for i in range(parts):
        kit.frame(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(path)
    return rows


def run(spark, tmp_path, parts=3):
    source = str(tmp_path / "source")
    job = ingest.Ingest(spark, str(tmp_path / "lake"), kit.registry(), sample.DEPLOYED)
    rows = sorted(sample.ROWS, key=lambda r: (r["block_number"], r["log_index"]))
    size = -(-len(rows) // parts)
    for i in range(parts):
        kit.frame(spark, rows[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(source)
        job.start(ingest.read_stream(spark, source), str(tmp_path / "ck")).awaitTermination()
    return job, source


def test_stream_equals_batch_and_retry_is_idempotent(spark, tmp_path):
    job, source = run(spark, tmp_path)
    last = job.last()
    assert last.batch_id == 2
    events = sample.events(spark)
    columns = [c for c in ledger.position_state(events, CUT).columns if c != "last_block"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    served = rows(state.served_positions(job.state(last.batch_id)))
    assert served == rows(ledger.position_state(events, CUT))
    assert job.events().count() == events.count()
    job.verify_anchor(spark.read.schema(EVENT).parquet(source))
    with pytest.raises(DataQualityError):
        job.verify_anchor(spark.read.schema(EVENT).parquet(source).where(F.col("block_number") < 1))
    ids = [r.event_id for r in job.events().where("batch_id = 2").select("event_id").collect()]
    again = ingest.with_event_id(events).where(F.col("event_id").isin(ids))
    job.process(again, 2)
    assert job.events().count() == events.count() and rows(state.served_positions(job.state(2))) == served
    # late rows are set aside, not dropped silently and not applied
    job.process(sample.events(spark).limit(5), 3)
    assert spark.read.parquet(job.folder("late", 3)).count() == 5 and job.last().batch_id == 2
    with pytest.raises(DataQualityError):
        job.with_start(sample.DEPLOYED + 1).process(again, 4)
    ok = job.accept_cutoff(10, 10, "a", None)
    assert job.accept_cutoff(11, 11, "b", ok)["cutoff_block"] == 11
    with pytest.raises(DataQualityError):
        job.accept_cutoff(10, 10, "other", ok)
    with pytest.raises(DataQualityError, match="quarantined"):
        job.process(again, 5)


def test_failed_batch_commits_nothing(spark, tmp_path):
    job = ingest.Ingest(spark, str(tmp_path / "lake"), kit.registry(), sample.DEPLOYED, max_events=2)
    with pytest.raises(DataQualityError):
        job.process(kit.frame(spark, kit.open_position()), 0)
    bad = kit.open_position()
    bad[1]["lot_lns"] = None
    with pytest.raises(DataQualityError):
        ingest.Ingest(spark, str(tmp_path / "lake"), kit.registry(), sample.DEPLOYED).process(kit.frame(spark, bad), 0)
    assert job.events() is None and job.last() is None


def test_dedupe_and_hourly_flows(spark, tmp_path):
    source = str(tmp_path / "source")
    write_parts(spark, source, 2)
    spark.read.parquet(source).limit(4).write.mode("append").parquet(source)
    stream = ingest.distinct_stream(ingest.read_stream(spark, source), "30 days").drop("event_time")
    out, ck = str(tmp_path / "distinct"), str(tmp_path / "ck1")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == len(sample.ROWS)
    hours = ingest.hourly_flows(ingest.read_stream(spark, out), "1 minute")
    hourly, ck = str(tmp_path / "hours"), str(tmp_path / "ck2")
    hours.writeStream.format("parquet").option("path", hourly).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    events = sample.events(spark)
    exact = events.where(F.col("kind") == "maker_fill").where(F.col("timestamp_ms") >= CUT_MS - sample.DAY)
    exact = {r.perpetual_id: (r.v, r.n) for r in exact.groupBy("perpetual_id").agg(F.sum(F.col("price_pns") * F.col("lot_lns")).alias("v"), F.count("*").alias("n")).collect()}
    rolled = {r.perpetual_id: (r.volume_native, r.trades) for r in ingest.rolling_from_hours(spark.read.parquet(hourly), events, CUT, sample.DAY).collect()}
    assert rolled == exact


def test_freshness_and_reorg(spark):
    status = spark.createDataFrame(
        [(1, False, 100_000, 100_000, 10, 10), (2, False, 0, 100_000, 10, 10), (3, False, 100_000, 0, 10, 10), (4, True, 100_000, 100_000, 10, 10), (5, False, 100_000, 100_000, 99, 10)],
        "id int, quarantined boolean, last_success_ms long, last_progress_ms long, head_block long, processed_block long",
    )
    got = {r.id: r.reason for r in ingest.freshness(status, 125_000, 20).collect()}
    assert got == {1: None, 2: "no-recent-success", 3: "no-block-progress", 4: "quarantined", 5: "lagging"}
    rows = kit.open_position()
    other = [{**rows[1], "block_hash": "0xfork"}]
    events = kit.frame(spark, rows + other)
    blocks = spark.createDataFrame([(r["block_number"], r["block_hash"]) for r in rows[:2]], "block_number long, block_hash string")
    assert ingest.canonical_only(events, blocks).count() == 3


def test_signals_carry_over_batches(spark, tmp_path):
    from tideledger.operators import signals
    from tideledger.operators.accounting import effective_marks, price_positions, replay_eligibility
    from tideledger.params import Coverage

    events, reg = sample.events(spark), kit.registry()
    rows = price_positions(ledger.position_state(events, CUT), effective_marks(events, None, CUT), reg, CUT)
    eligible = replay_eligibility(events, CUT, Coverage(143, sample.DEPLOYED, CUT.block_number), reg)
    report = signals.signal_report(rows, eligible, None, None, CUT)
    job = ingest.Ingest(spark, str(tmp_path / "lake"), reg, sample.DEPLOYED)
    first = job.carry_signals(report, CUT, 0)
    second = job.carry_signals(report, CUT, 1)
    assert {r.change for r in first.collect()} == {"baseline"} and {r.change for r in second.collect()} == {"unchanged"}
