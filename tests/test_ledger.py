from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import kit
from tideledger.errors import DataQualityError
from tideledger.operators import accounting, checks, ledger
from tideledger.params import Coverage


def test_lifecycle_totals(spark):
    events = kit.frame(spark, kit.open_increase_reduce_close())
    cut = kit.as_of(54773080)
    row = ledger.position_state(events, cut).first()
    assert (row.status, row.lot_lns, row.realized_pnl_cns, row.realized_funding_cns, row.fees_cns) == (
        "closed", 0, 619_950_000, 2_000_000, 103_500,
    )
    assert row.opened_block == 54773030 and row.closed_block == 54773080
    account = ledger.account_state(events, cut).where("account_id = 42").first()
    assert account.balance_cns == 20_000_000_000 and account.owner == "0x" + "1" * 40
    assert ledger.fill_log(events, cut).count() == 4


def test_history_equals_state_and_survives_hot_keys(spark):
    events = kit.frame(spark, kit.open_increase_reduce_close()).repartition(3)
    cut = kit.as_of(54773080)
    plain = ledger.position_history(events, cut)
    hot = ledger.position_history(events, cut, range_width=1)
    columns = sorted(plain.columns)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(plain) == rows(hot)
    shared = [c for c in ledger.position_state(events, cut).columns if c != "last_block"]
    assert rows_of(ledger.history_state(plain), shared) == rows_of(ledger.position_state(events, cut), shared)
    assert ledger.transition_violations(plain).count() == 0


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_open_position_risk(spark):
    events = kit.frame(spark, kit.open_position())
    cut = kit.as_of(54773030, ts=1770000900000)
    marks = kit.marks_frame(
        spark,
        [dict(perpetual_id=1, mark_pns=710000, oracle_pns=709800, block_number=54773030, timestamp_ms=1770000900000)],
    )
    row = accounting.position_risk(events, kit.registry(), cut, supplied_marks=marks, strict=True).first()
    coins = kit.coins
    assert coins(row.price_pnl_u) == 1000 and coins(row.notional_u) == 71000
    assert coins(row.maintenance_u) == 2800
    assert coins(row.zero_funding_equity_u) == 11000 and coins(row.zero_funding_buffer_u) == 8200
    assert coins(row.zero_funding_liquidation_u) == 62800
    assert row.equity_u is None and row.liquidation_u is None and row.total_pnl_u is None
    assert row.risk_status == "funding-unverified"


def test_liquidation_state(spark):
    events = kit.frame(spark, kit.liquidation())
    row = ledger.position_state(events, kit.as_of(54773070)).first()
    assert (row.status, row.realized_pnl_cns, row.realized_funding_cns) == ("liquidated", -7_500_000_000, -2_000_000)


def invert_rows(**over):
    fields = dict(
        account_id=42, perpetual_id=1, position_type=2, price_pns=690000, start_lot_lns=100000, end_lot_lns=50000,
        start_deposit_cns=10_000_000_000, end_deposit_cns=5_000_000_000, delta_pnl_cns=0, funding_cns=0,
    )
    return [*kit.open_position(), kit.event("position_inverted", 54773040, 0, **{**fields, **over})]


@pytest.mark.parametrize(
    "over, violation",
    [
        ({}, None),
        ({"position_type": 1}, "inversion_keeps_side"),
        ({"start_lot_lns": 1}, "start_lot_differs"),
        ({"start_deposit_cns": 1}, "start_deposit_differs"),
        ({"end_lot_lns": 0}, "open_size_not_positive"),
    ],
)
def test_inversion_and_its_rejections(spark, over, violation):
    history = ledger.position_history(kit.frame(spark, invert_rows(**over)), kit.as_of(54773050))
    found = {r.violation for r in ledger.transition_violations(history).collect()}
    assert found == ({violation} if violation else set())
    if violation is None:
        row = ledger.history_state(history).first()
        assert (row.side, row.lot_lns, row.entry_pns) == (2, 50000, 690000)


def test_residue_survives_reduction(spark):
    rows = kit.open_position()
    rows[1]["price_pns"], rows[1]["price_residue_pnsq16"] = 706667, 16384
    rows.append(
        kit.event("position_decreased", 54773040, 0, account_id=42, perpetual_id=1, position_type=1,
                  start_lot_lns=100000, end_lot_lns=50000, start_deposit_cns=10_000_000_000,
                  end_deposit_cns=5_000_000_000, delta_pnl_cns=0, funding_cns=0)
    )
    state = ledger.position_state(kit.frame(spark, rows), kit.as_of(54773050))
    entry = state.select(accounting.entry_q16().alias("e")).first().e
    assert Decimal(int(entry)) / 65536 / 10 == Decimal("70666.625")


def test_reopen_keeps_totals_and_double_open_is_flagged(spark):
    rows = kit.open_increase_reduce_close()
    again = kit.event("position_opened", 54773090, 0, account_id=42, perpetual_id=1, position_type=2,
                      deposit_cns=1, price_pns=700000, lot_lns=5, prot_fee_cns=500)
    state = ledger.position_state(kit.frame(spark, [*rows, again]), kit.as_of(54773090)).first()
    assert (state.status, state.realized_pnl_cns, state.fees_cns, state.closed_block) == ("open", 619_950_000, 104_000, None)
    twice = kit.event("position_opened", 54773091, 0, account_id=42, perpetual_id=1, position_type=2,
                      deposit_cns=1, price_pns=700000, lot_lns=5)
    history = ledger.position_history(kit.frame(spark, [*rows, again, twice]), kit.as_of(54773091))
    assert [r.violation for r in ledger.transition_violations(history).collect()] == ["already_open"]


def test_guards_and_event_rules(spark):
    rows = kit.open_position()
    reg, cut = kit.registry(), kit.as_of(54773030)
    assert checks.ledger_guards(kit.frame(spark, rows), reg, cut).count() == 0
    bad = [dict(r) for r in rows]
    bad[2]["log_index"], bad[2]["block_hash"] = 0, "0xother"
    found = {r.violation for r in checks.ledger_guards(kit.frame(spark, bad), reg, cut).collect()}
    assert found == {"repeated_position", "mixed_block_hash"}
    assert checks.adjacent_duplicates(kit.frame(spark, bad)).count() == 1
    bad = [dict(r) for r in rows]
    bad[1]["position_type"], bad[2]["lot_lns"], bad[0]["owner"] = None, None, "  "
    found = {r.violation for r in checks.validate_events(kit.frame(spark, bad)).collect()}
    assert found == {"missing_position_type", "side_not_explicit", "missing_lot_lns", "missing_owner"}
    bad = [dict(r) for r in rows]
    bad[1]["perpetual_id"] = 30
    assert checks.unlisted_market_events(kit.frame(spark, bad), reg).count() == 1
    assert checks.registry_rules(reg, spark).count() == 0
    broken = kit.registry(markets=(kit.market(1, " ", 19, 5, 100, 50),), excluded=(1, 1))
    found = {r.violation for r in checks.registry_rules(broken, spark).collect()}
    assert {"bad_symbol", "bad_scale", "bad_initial_fraction", "repeated_exclusion", "excluded_but_listed"} <= found


def test_gate(spark):
    events = kit.frame(spark, kit.open_position())
    cover = Coverage(kit.CHAIN, kit.DEPLOYED, 54773130)
    quiet = checks.require_gate(events, kit.as_of(54773130), cover, 0)
    assert (quiet["event_silence_blocks"], quiet["coverage_lag_blocks"]) == (100, 0)
    with pytest.raises(DataQualityError):
        checks.require_gate(events, kit.as_of(54774000), Coverage(kit.CHAIN, kit.DEPLOYED, 54773030), 0)


def test_liquidation_price_table(spark):
    cases = [
        (1, 10, 100, 0, 95), (1, 10, 100, -50, 100), (1, 10, 100, 50, 90),
        (2, 10, 100, 0, 105), (2, 10, 100, -50, 100), (2, 10, 100, 50, 110), (1, 1, 1000, 0, 0),
    ]
    for side, size, deposit, funding, expected in cases:
        df = spark.range(1).select(
            F.lit(side).alias("side"), F.lit(0).alias("entry_residue"), F.lit(100).cast("decimal(38,0)").alias("entry_pns"),
            F.lit(size).cast("decimal(38,0)").alias("lot_lns"), F.lit(0).alias("price_decimals"),
            F.lit(0).alias("size_decimals"), F.lit(2000).alias("maint_margin_frac_hdths"),
            (F.lit(deposit).cast("decimal(38,0)") * accounting.dec(kit.UNIT)).alias("deposit_u"),
        )
        entry_notional = accounting.entry_q16() * F.col("lot_lns") * accounting.amount_factor()
        price = accounting.liquidation_price(entry_notional, accounting.dec(funding) * accounting.dec(kit.UNIT))
        assert kit.coins(df.select(price.alias("p")).first().p) == expected


def test_eligibility_needs_provenance_one_profile_and_the_exchange(spark):
    """Null, mixed and inspection-only provenance and a foreign contract never count as replayable."""
    profiles = {
        1: ["risk-hotpath-v3", "risk-hotpath-v3"], 2: ["risk-hotpath-v3", None], 3: [None, None],
        4: ["risk-hotpath-v2", "risk-hotpath-v3"], 5: ["risk-hotpath-v1", "risk-hotpath-v1"], 6: ["risk-hotpath-v3", "risk-hotpath-v3"],
    }
    rows = []
    for account, given in profiles.items():
        for n, profile in enumerate(given):
            kind = "collateral_deposit" if n else "account_created"
            row = kit.event(kind, 54773020 + n, account, account_id=account, provenance=profile and dict(ingestion_profile=profile))
            rows.append(row | (dict(contract_address="0xother") if account == 6 and n else {}))
    events, cut, basis = kit.frame(spark, rows), kit.as_of(54773080), Coverage(kit.CHAIN, kit.DEPLOYED + 1, 54773080)

    def judged(**how):
        found = accounting.replay_eligibility(events, cut, basis, kit.registry(), **how)
        return {r.account_id: (r.basis, r.eligible) for r in found.collect()}

    expected = {
        1: ("account-birth", True), 2: ("missing-provenance", False), 3: ("missing-provenance", False), 4: ("mixed-profiles", False),
        5: ("ingestion-profile", False), 6: ("contract-mismatch", False),
    }
    assert judged(indexed=True) == expected
    assert judged() == {**expected, 3: ("account-birth", True)}


def test_report_of_few_rules_equals_the_whole_one(spark):
    events, cut = kit.frame(spark, kit.open_position() + kit.liquidation()), kit.as_of(54773080)
    from tideledger.operators import analytics, signals

    positions = accounting.position_risk(events, kit.registry(), cut)
    eligible = accounting.replay_eligibility(events, cut, Coverage(kit.CHAIN, kit.DEPLOYED, 54773080), kit.registry())
    whole = signals.signal_report(positions, eligible, analytics.market_state(positions), None, cut)
    found = {r.signal_id: r for r in whole.collect()}
    assert {r.rule_id for r in found.values()} == {"position-liquidated", "risk-input-unavailable"}
    for rule in [*signals.POSITION_RULES, "incomplete-history", "market-skew"]:
        part = signals.signal_report(positions, eligible, analytics.market_state(positions), None, cut, rules=(rule,))
        assert part.columns == whole.columns
        assert {r.signal_id: r for r in part.collect()} == {k: r for k, r in found.items() if r.rule_id == rule}
