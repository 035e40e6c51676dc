"""Pinned windows, published tables, table hashes and watchlists against a population."""

import random

import pytest
from pyspark.sql import functions as F

import cohort as sample
import kit
from tideledger.errors import DataQualityError
from tideledger.operators import cohort, evidence
from tideledger.params import Coverage
from tideledger.plans import scans, snapshot
from tideledger.sources import publication
from tideledger.streaming.store import Store


def pinned(rows, **over):
    rows = sorted(rows, key=lambda r: (r["block_number"], r["log_index"]))
    first, last = (scans.Header(r["block_number"], r["block_hash"], r["timestamp_ms"]) for r in (rows[0], rows[-1]))
    anchor = f"{kit.CHAIN}:{rows[-1]['block_hash']}:{rows[-1]['tx_hash']}:{rows[-1]['log_index']}"
    return scans.PinnedWindow(**{**dict(chain_id=kit.CHAIN, contract_address=kit.EXCHANGE, first=first, last=last, events=len(rows), anchor_event_id=anchor), **over})


def test_each_precondition_can_fail(spark):
    rows = kit.open_increase_reduce_close()
    pin = pinned(rows)
    assert scans.pinned_violations(kit.frame(spark, rows), pin).count() == 0
    cases = {
        "outside_blocks": [*rows[:-1], {**rows[-1], "block_number": pin.last.block_number + 1}],
        "outside_times": [{**rows[1], "timestamp_ms": 1}, rows[0], *rows[2:]],
        "chain_differs": [{**rows[2], "chain_id": 1}, *rows[:2], *rows[3:]],
        "contract_differs": [{**rows[2], "contract_address": "0x0"}, *rows[:2], *rows[3:]],
        "first_header_differs": [{**rows[0], "block_hash": "0xother"}, *rows[1:]],
        "last_header_differs": [*rows[:-1], {**rows[-1], "timestamp_ms": rows[-1]["timestamp_ms"] - 1}],
        "count_differs": rows[:-1] + [rows[-1]] * 2,
        "anchor_absent": [*rows[:-1], {**rows[-1], "tx_hash": "0xother"}],
    }
    for name, faulty in cases.items():
        found = {r.violation for r in scans.pinned_violations(kit.frame(spark, faulty), pin).collect()}
        assert name in found, name
        with pytest.raises(DataQualityError):
            scans.require_pinned(kit.frame(spark, faulty), pin)
    assert {r.violation for r in scans.pinned_violations(kit.frame(spark, []), pin).collect()} == {"count_differs", "anchor_absent"}
    with pytest.raises(DataQualityError):
        pinned(rows, events=0)


def test_pinned_history(spark):
    rows = sorted(sample.ROWS, key=lambda r: (r["block_number"], r["log_index"]))
    events, reg = sample.events(spark), kit.registry()
    pin = pinned(rows)
    coverage = Coverage(kit.CHAIN, sample.DEPLOYED, pin.last.block_number)
    proofs = reg.frame(spark)
    tables = snapshot.pinned_history(events, pin, events, reg, proofs, coverage)
    assert tables["manifest"].first().event_count == len(rows)
    assert {r.part for r in tables["history"].collect()} == {"flow", "position"}
    assert 0 < tables["events"].count() <= len(rows)
    traded = next(r["perpetual_id"] for r in rows if r.get("perpetual_id"))
    with pytest.raises(DataQualityError, match="without a proof"):
        snapshot.pinned_history(events, pin, events, reg, proofs.where(F.col("perpetual_id") != traded), coverage)
    with pytest.raises(DataQualityError, match="proof differs"):
        snapshot.pinned_history(events, pin, events, reg, proofs.withColumn("price_decimals", F.col("price_decimals") + 1), coverage)
    with pytest.raises(DataQualityError, match="not the pinned one"):
        snapshot.pinned_history(events.limit(len(rows) - 1), pin, events, reg, proofs, coverage)


def test_published_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    facts = dict(as_of_block=10, as_of_log=None, as_of_block_hash="0x1", processed_block=10, inputs_hash="h", observed_at_ms=1_000)
    tables = {"a": spark.range(2000), "none": spark.range(0)}
    assert publication.publish_tables(spark, tables, root, "main", **facts) == 0
    assert publication.publish_tables(spark, tables, root, "main", **{**facts, "as_of_block": 11}) == 1
    for over in (dict(as_of_block=9), dict(as_of_block=12, processed_block=9), dict(as_of_block=11, inputs_hash="other"), dict(as_of_block=11, as_of_log=3)):
        with pytest.raises(DataQualityError, match="regresses"):
            publication.publish_tables(spark, tables, root, "main", **{**facts, **over})
    loaded = publication.load_tables(spark, root, "main", 60, now_ms=2_000)
    assert set(loaded) == {"a"} and loaded["a"].count() == 2000
    with pytest.raises(DataQualityError, match="stale"):
        publication.load_tables(spark, root, "main", 60, now_ms=100_000)
    with pytest.raises(DataQualityError, match="missing"):
        publication.load_tables(spark, root, "other", 60, now_ms=2_000)
    # Two writers that read the same last version: the slower one changes nothing.
    stale = Store(spark, f"{root}/main").last()
    publication.publish_tables(spark, tables, root, "main", **{**facts, "as_of_block": 12})
    monkeypatch.setattr(Store, "last", lambda self: stale)
    with pytest.raises(DataQualityError, match="another writer"):
        publication.publish_tables(spark, {"a": spark.range(1)}, root, "main", **{**facts, "as_of_block": 13})
    monkeypatch.undo()
    assert Store(spark, f"{root}/main").last().facts["as_of_block"] == 12
    folder = next((tmp_path / "out" / "main" / "a").glob(f"token={Store(spark, f'{root}/main').last().tables['a']['all'][0]}/*"))
    spark.range(1999).coalesce(1).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(DataQualityError, match="hash"):
        publication.load_tables(spark, root, "main", 60, now_ms=2_000)


def test_table_hash_of_any_order(spark):
    rows = [(i % 300, None if i % 7 == 0 else f"t{i % 40}") for i in range(3000)]
    told = set()
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        told.add(tuple(evidence.checkpoint_hash(spark.createDataFrame(rows, "a long, b string").repartition(seed * 3), ["a", "b"]).first()))
    assert len(told) == 1 and next(iter(told))[0] == 3000
    other = evidence.checkpoint_hash(spark.createDataFrame([*rows[:-1], (999, "x")], "a long, b string"), ["a", "b"]).first()
    assert other.hash != next(iter(told))[1]
    assert evidence.checkpoint_hash(spark.createDataFrame([], "a long, b string"), ["a", "b"]).count() == 0


def test_range_hash_splits_a_block(spark):
    """One block with more logs than a leaf holds."""
    rows = [kit.event("contract_added", kit.DEPLOYED, log) for log in range(2500)]
    events = kit.frame(spark, rows)
    hashes = {evidence.ids_hash_tree(e, kit.as_of(kit.DEPLOYED)).first().ordered_ids_tree_hash for e in (events, events.repartition(7))}
    assert len(hashes) == 1
    assert evidence.ids_hash_tree(kit.frame(spark, rows[:-1]), kit.as_of(kit.DEPLOYED)).first().ordered_ids_tree_hash not in hashes


def test_watchlist_against_all_wallets(spark):
    r = random.Random(4)
    markets = tuple(kit.market(i, f"M{i}", 1, 1, 1000, 2000) for i in range(1, 151))
    reg = kit.registry(markets=markets, excluded=())
    held = {a: {m: r.choice(["long", "short"]) for m in r.sample(range(1, 151), r.randrange(1, 9))} for a in range(60)}
    rows = [(a, m, f"M{m}", side, None, None) for a, own in held.items() for m, side in own.items()]
    frame = spark.createDataFrame(rows, "account_id long, perpetual_id int, symbol string, side_name string, notional_u decimal(38,0), deposit_u decimal(38,0)")
    masks = cohort.exposure_masks(frame, reg)
    watched = spark.createDataFrame([(a,) for a in (0, 7, 7, 31)], "account_id long")
    got = {(x.account_a, x.account_b): (x.shared_markets, x.union_markets, x.same_side_markets, x.opposing_markets) for x in cohort.watchlist_overlap(masks, watched).collect()}
    want = {}
    for a in (0, 7, 31):
        for b in held:
            if a != b:
                shared = held[a].keys() & held[b].keys()
                same = sum(held[a][m] == held[b][m] for m in shared)
                want[a, b] = (len(shared), len(held[a].keys() | held[b].keys()), same, len(shared) - same)
    assert got == want
    with pytest.raises(DataQualityError):
        cohort.watchlist_overlap(masks, watched, limit=2)
