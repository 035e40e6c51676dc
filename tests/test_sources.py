import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import cohort as sample
import kit
from tideledger.errors import DataQualityError
from tideledger.operators import accounting, analytics, evidence, ledger
from tideledger.params import AsOf, Coverage
from tideledger.plans import snapshot
from tideledger.sources import documents, event_table, publication, raw_logs

REGISTRY_DOC = dict(
    chain_id=143, exchange_address=kit.EXCHANGE, deployed_at_block=kit.DEPLOYED,
    collateral=dict(symbol="AUSD", address="0x" + "0" * 40, decimals=6), excluded_perpetuals=[30],
    markets=[dict(m) for m in kit.MARKETS],
)


def bundle_file(tmp_path, rows, **over):
    doc = dict(
        name="b", registry=REGISTRY_DOC, coverage=dict(chain_id=143, start_block=kit.DEPLOYED, processed_block=54773080),
        as_of=dict(chain_id=143, block_number=54773080, block_hash="0xcut", timestamp_ms=1770003600000), events=rows,
        market_state=[dict(perpetual_id=1, mark_pns=712000, block_number=54773080, timestamp_ms=1770003600000)],
    )
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps({**doc, **over}))
    return str(path)


def test_bundle_end_to_end(spark, tmp_path):
    b = documents.read_bundle(spark, bundle_file(tmp_path, kit.open_increase_reduce_close()))
    row = ledger.position_state(b.events, b.as_of).first()
    assert (row.realized_pnl_cns, row.fees_cns) == (619_950_000, 103_500)
    positions = accounting.position_risk(b.events, b.registry, b.as_of, supplied_marks=b.marks)
    metric = analytics.protocol_metrics(b.events, positions, b.registry, b.as_of).first()
    assert (kit.coins(metric.taker_volume_u), metric.open_interest_u, metric.tvl_u, metric.liquidations) == (212620, 0, 0, 0)


@pytest.mark.parametrize("over", [dict(events=[]), dict(registry=None), dict(coverage=dict(chain_id=1, start_block=1, processed_block=2))])
def test_bundle_rejections(spark, tmp_path, over):
    with pytest.raises(DataQualityError):
        documents.read_bundle(spark, bundle_file(tmp_path, kit.open_position(), **over))


def test_registry_file(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(REGISTRY_DOC))
    assert len(documents.read_registry(spark, str(path)).markets) == 5
    path.write_text(json.dumps({**REGISTRY_DOC, "markets": [kit.MARKETS[0], kit.MARKETS[0]]}))
    with pytest.raises(DataQualityError):
        documents.read_registry(spark, str(path))


def raw(abi, kind, payload, block=kit.DEPLOYED + 5, log=0, **over):
    from tideledger.schema import PROVENANCE_TUPLES

    v = PROVENANCE_TUPLES[2]
    row = dict(
        id=f"143:0xb{block}:0xt{log}:{log}", chainId=143, blockNumber=block, blockHash=f"0xb{block}", parentHash="0xp", txHash=f"0xt{log}",
        logIndex=log, timestampMs=1, srcAddress=kit.EXCHANGE, abiEventName=abi, kind=kind, accountId=None, perpetualId=None,
        positionType=None, payloadJson=json.dumps(payload), schemaVersion=v[0], handlerVersion=v[1], classifierVersion=v[2],
        ingestionProfile=v[3], abiFingerprint=v[4],
    )
    return {**row, **over}


OPEN = dict(accountId="9", perpId="1", positionType=0, leverageHdths="700", depositCNS="10", pricePNS=5, lotLNS="7", insFeeCNS="0",
            protFeeCNS="1", priceResiduePNSQ16="12")


def project(spark, *rows):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in raw_logs.RAW_SCHEMA.split(", ")) for r in rows], raw_logs.RAW_SCHEMA)
    good, bad = raw_logs.project_raw_logs(df)
    return good.collect(), {v for r in bad.collect() for v in r.violations}


def test_raw_projection(spark):
    subject = dict(accountId=9, perpetualId=1, positionType=0)
    good, bad = project(
        spark,
        raw("PositionOpenedV2", "POSITION_OPENED", OPEN, **subject),
        raw("MarkUpdated", "MARK_UPDATED", dict(perpId=1, pricePNS="99"), log=1, perpetualId=1),
        raw("FundingEventCompleted", "MARKET_FUNDING",
            dict(perpId=1, actualRatePct100k=-5, fundingPricePNS=1, fundingPaymentPNS="-3", fundingSumPNS="-3",
                 fundingEventBlock=kit.DEPLOYED + 9, allowOverwrite=True), log=2, perpetualId=1),
    )
    assert not bad
    rows = {r.kind: r for r in good}
    opened = rows["position_opened"]
    assert (opened.position_type, opened.price_residue_pnsq16, opened.lot_lns, opened.leverage_hdths) == (1, 12, 7, 700)
    assert rows["mark_updated"].mark_price_pns == 99
    funding = rows["market_funding"]
    assert (funding.funding_payment_pns, funding.funding_allow_overwrite, funding.funding_rate_pct100k) == (-3, True, -5)


@pytest.mark.parametrize(
    "change, violation",
    [
        (dict(accountId=8), "account_differs"),
        (dict(perpetualId=None), "perpetualId_differs"),
        (dict(positionType=1), "positionType_differs"),
        (dict(kind="POSITION_CLOSED"), "kind_differs"),
        (dict(abiEventName="Nothing"), "unknown_abi_event"),
        (dict(schemaVersion="x"), "unknown_version_tuple"),
        (dict(id="143:a:b:0"), "id_differs"),
        (dict(payloadJson="[1]"), "payload_not_object"),
        (dict(payloadJson=json.dumps({**OPEN, "lotLNS": "-7"})), "payload_field_negative"),
        (dict(payloadJson=json.dumps({k: v for k, v in OPEN.items() if k != "lotLNS"})), "payload_field_invalid"),
    ],
)
def test_raw_rejections(spark, change, violation):
    base = raw("PositionOpenedV2", "POSITION_OPENED", OPEN, accountId=9, perpetualId=1, positionType=0)
    good, bad = project(spark, {**base, **change})
    assert not good and violation in bad


def test_event_table(spark, tmp_path):
    path = str(tmp_path / "events")
    first, second = kit.open_increase_reduce_close()[:4], kit.open_increase_reduce_close()[4:]
    event_table.write_events(kit.frame(spark, first), path)
    event_table.append_events(kit.frame(spark, second), path)
    assert event_table.read_events(spark, path).count() == 10
    assert event_table.read_events(spark, path, 54773040, 54773060).count() == 4
    with pytest.raises(DataQualityError):
        event_table.append_events(kit.frame(spark, second[:1]), path)
    plan = event_table.read_events(spark, path, 54773040)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_bucket" in plan and "PushedFilters: [IsNotNull(block_number)" in plan


def test_publication(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    payload = publication.compact({"a": spark.range(3), "b": spark.range(1)})
    args = dict(as_of_log=None, as_of_block_hash="0x1", inputs_hash="h", observed_at_ms=1_000)
    assert publication.publish_snapshot(payload, path, "main", as_of_block=10, processed_block=10, **args) == 0
    assert publication.publish_snapshot(payload, path, "main", as_of_block=11, processed_block=11, **args) == 1
    for over in (dict(as_of_block=10, processed_block=11), dict(as_of_block=12, processed_block=10)):
        with pytest.raises(DataQualityError):
            publication.publish_snapshot(payload, path, "main", **over, **args)
    with pytest.raises(DataQualityError):
        publication.publish_snapshot(payload, path, "main", as_of_block=11, processed_block=11, **{**args, "inputs_hash": "other"})
    assert publication.load_snapshot(spark, path, "main", 60, now_ms=2_000).as_of_block == 11
    with pytest.raises(DataQualityError):
        publication.load_snapshot(spark, path, "main", 60, now_ms=100_000)
    with pytest.raises(DataQualityError):
        publication.load_snapshot(spark, path, "other", 60, now_ms=2_000)
    with pytest.raises(DataQualityError):
        publication.compact({"a": spark.range(100)}, limit_bytes=10)


def test_snapshot_and_export(spark, tmp_path):
    cut_ms = sample.T0 + 10 * sample.DAY
    block = sample.block_at(cut_ms)
    cut = AsOf(143, block, "0x" + sha256(f"block-{block}".encode()).hexdigest(), cut_ms)
    events = sample.events(spark).persist()
    tables = snapshot.build_snapshot(events, kit.registry(), cut, Coverage(143, sample.DEPLOYED, cut.block_number))
    assert {r.severity: r.signals for r in tables["severity_counts"].collect()}["warning"] >= 1
    assert tables["manifest"].first().event_count == events.count()
    snapshot.demo_walk(tables, 102)
    watch = snapshot.watchlist_snapshot(events, [102, 103, 105], kit.registry(), cut, Coverage(143, sample.DEPLOYED, cut.block_number))
    assert watch["wallets"].count() == 3 and watch["overlap"].count() == 3
    shuffled = events.repartition(5)
    hashes = [evidence.ids_hash_exact(e, cut).first()[0] for e in (events, shuffled)]
    trees = [evidence.ids_hash_tree(e, cut).first()[1] for e in (events, shuffled)]
    assert hashes[0] == hashes[1] and trees[0] == trees[1]
    documents.export_evidence(tables["manifest"], str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)already.exists"):
        documents.export_evidence(tables["manifest"], str(tmp_path / "out"))
    with pytest.raises(DataQualityError):
        snapshot.build_snapshot(events.unionByName(events.limit(1)), kit.registry(), cut, Coverage(143, sample.DEPLOYED, cut.block_number))


def broken(events, rule):
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("tx_hash")))
    change = {
        "broken transition": ("position_increased", "start_lot_lns", F.col("start_lot_lns") + 1),
        "negative flow": ("collateral_withdrawal", "amount_cns", -F.col("amount_cns")),
        "unlisted market": ("maker_fill", "perpetual_id", F.lit(99)),
    }[rule]
    kind, column, value = change
    target = events.agg(first(kind)).first()[0]
    return events.withColumn(column, F.when(F.col("tx_hash") == target, value).otherwise(F.col(column)).cast(events.schema[column].dataType))


@pytest.mark.parametrize("rule", ["broken transition", "negative flow", "unlisted market"])
def test_snapshots_fail_closed(spark, rule):
    cut_ms = sample.T0 + 10 * sample.DAY
    block = sample.block_at(cut_ms)
    cut = AsOf(143, block, "0x" + sha256(f"block-{block}".encode()).hexdigest(), cut_ms)
    events, coverage = sample.events(spark), Coverage(143, sample.DEPLOYED, cut.block_number)
    with pytest.raises(DataQualityError, match="broken transition|negative|invalid event|unlisted|ledger guard"):
        snapshot.build_snapshot(broken(events, rule), kit.registry(), cut, coverage)


def test_a_supplied_mark_must_not_contradict(spark):
    cut_ms = sample.T0 + 10 * sample.DAY
    cut = AsOf(143, sample.block_at(cut_ms), "0xcut", cut_ms)
    events = sample.events(spark)
    canonical = ledger.latest_marks(events, cut).withColumn("oracle_pns", F.lit(None).cast("decimal(38,0)"))
    assert accounting.mark_conflicts(events, canonical, cut).count() == 0
    assert accounting.mark_conflicts(events, canonical.withColumn("mark_pns", F.col("mark_pns") + 1), cut).count() == canonical.count()


def test_registry_and_context_evidence(spark):
    registered = kit.registry().frame(spark)
    observed = registered.where("perpetual_id <> 31").withColumn(
        "price_decimals", F.when(F.col("perpetual_id") == 1, 2).otherwise(F.col("price_decimals"))
    )
    change = {r.perpetual_id: r.change for r in evidence.registry_diff(registered, observed).collect()}
    assert change[1] == "changed" and change[31] == "absent" and change[10] == "same"
    assert evidence.observation_violations(observed).count() == 0
    assert evidence.observation_violations(observed.unionByName(observed.limit(1))).count() == 1
    assert [r.violation for r in evidence.proof_mismatches(registered, observed).collect()] == ["price_decimals_differs"]


def test_payload_text_provenance_and_hashes(spark):
    from tideledger.functions.keys import canonical_payload
    from tideledger.operators import signals

    text = spark.range(1).select(canonical_payload(F.expr("map('b', '2', 'a', '1')")).alias("p")).first().p
    assert text == '{"a":"1","b":"2"}'
    rules = signals.rule_table(spark)
    assert rules.count() == 9 and rules.select("rule_hash").distinct().count() == 9 and signals.rules_hash().startswith("sha256:")
    row = raw("MarkUpdated", "MARK_UPDATED", dict(perpId=1, pricePNS="99"), log=1, perpetualId=1)
    values = tuple(row[c.split()[0]] for c in raw_logs.RAW_SCHEMA.split(", "))
    df, _ = raw_logs.project_raw_logs(spark.createDataFrame([values], raw_logs.RAW_SCHEMA))
    profile = evidence.provenance_profile(df, kit.as_of(kit.DEPLOYED + 10)).first()
    assert (profile.ingestion_profile, profile.events) == ("risk-hotpath-v3", 1)
    observed = kit.registry().frame(spark)
    context = evidence.observed_context(observed, 0, kit.as_of(kit.DEPLOYED + 10), 1_000)
    assert context.where("stale").count() == 5 and context.select("row_hash").distinct().count() == 5
    a, b = (evidence.checkpoint_hash(x, ["perpetual_id", "symbol"]).first().hash for x in (observed, observed.repartition(3)))
    assert a == b
