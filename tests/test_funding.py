import pytest

import kit
from tideledger.errors import DataQualityError
from tideledger.operators import accounting, funding
from tideledger.operators.ledger import history_state
from tideledger.params import FundingScope

S = kit.DEPLOYED
REG = kit.registry(markets=(kit.market(1, "TST", 0, 5, 1000, 2000), kit.market(2, "OTH", 0, 5, 1000, 2000)))


def publish(at, target, payment, total, allow=False, log=0):
    return kit.event("market_funding", at, log, perpetual_id=1, funding_rate_pct100k=0, funding_payment_pns=payment,
                     funding_sum_pns=total, funding_event_block=target, funding_allow_overwrite=allow)


def scale(at, exp, log=1):
    return kit.event("funding_scale_updated", at, log, perpetual_id=1, funding_scaling_exp=exp)


def opened(at, side=1, log=0, lot=100000):
    return kit.event("position_opened", at, log, account_id=9, perpetual_id=1, position_type=side, price_pns=1000,
                     lot_lns=lot, deposit_cns=20_000_000)


def move(kind, at, start, end, funding_cns=0, side=1, log=0, **f):
    return kit.event(kind, at, log, account_id=9, perpetual_id=1, position_type=side, start_lot_lns=start,
                     end_lot_lns=end, start_deposit_cns=20_000_000, end_deposit_cns=20_000_000,
                     delta_pnl_cns=0, funding_cns=funding_cns, price_pns=1000, liq_price_pns=1000,
                     liq_lot_lns=start - end, deposit_cns=20_000_000, **f)


def base(side=1):
    return [kit.event("account_created", S, 0, account_id=9, owner="0x1"), scale(S, 0), publish(S + 1, S + 2, 0, 0),
            opened(S + 3, side)]


def value(spark, rows, cut, start=S, markets=(1,), log=None):
    events = kit.frame(spark, rows).repartition(3)
    at = kit.as_of(cut, log)
    scope = FundingScope(start, cut, markets)
    history = funding.funded_history(events, REG, at, scope)
    row = funding.unsettled_funding(history, REG, scope).first()
    return kit.coins(row.unsettled_u)


@pytest.mark.parametrize("cut, expected", [(S + 5, 0), (S + 6, -10), (S + 9, -10)])
def test_effective_block(spark, cut, expected):
    # lot 100000 at 5 digits is one coin of size; a payment of 10 moves a long by -10
    assert value(spark, [*base(), publish(S + 4, S + 6, 10, 10)], cut) == expected


@pytest.mark.parametrize("side, payment, expected", [(1, 10, -10), (1, -10, 10), (2, 10, 10), (2, -10, -10)])
def test_sides_and_signs(spark, side, payment, expected):
    assert value(spark, [*base(side), publish(S + 4, S + 6, payment, payment)], S + 6) == expected


def test_settlement_in_the_effective_block(spark):
    rows = [*base(), publish(S + 4, S + 6, 10, 10), move("position_decreased", S + 6, 100000, 50000, -4_000_000)]
    assert value(spark, rows, S + 6) == -6


def test_overwrite_and_later_scale(spark):
    rows = [*base(), publish(S + 4, S + 6, 10, 10), publish(S + 5, S + 6, 20, 20, True), scale(S + 5, 2, 3)]
    assert value(spark, rows, S + 6) == -20
    assert value(spark, [*rows, publish(S + 7, S + 8, 10, 10)], S + 8) == kit.Decimal("-20.1")


def test_unknown_scale_until_reset(spark):
    rows = [r for r in base() if r["kind"] != "funding_scale_updated"] + [publish(S + 4, S + 6, 10, 10)]
    assert value(spark, rows, S + 6) is None
    assert value(spark, [*rows, move("position_increased", S + 7, 100000, 200000)], S + 7) == 0


def test_bounded_start_and_scope(spark):
    late = [r for r in base() if r["block_number"] > S + 2]
    later = [publish(S + 4, S + 6, 10, 10), scale(S + 4, 0, 5)]
    assert value(spark, [*late, *later], S + 6, start=S + 3) is None
    reset = move("position_increased", S + 7, 100000, 200000)
    assert value(spark, [*late, *later, reset], S + 7, start=S + 3) == 0
    assert value(spark, base(), S + 6, markets=(2,)) is None
    with pytest.raises(DataQualityError):
        FundingScope(S, S + 1, (1, 1)).validate(REG, kit.as_of(S + 1))


def test_inversion_resets_and_closing_is_zero(spark):
    rows = [*base(), publish(S + 4, S + 6, 10, 10)]
    assert value(spark, [*rows, move("position_inverted", S + 7, 100000, 50000, side=2)], S + 7) == 0
    half = move("position_liquidated", S + 6, 100000, 50000, -4_000_000)
    assert value(spark, [*rows, half], S + 6) == -6
    assert value(spark, [*rows, half, move("position_closed", S + 7, 50000, 0)], S + 7) == 0


def test_risk_with_funding_and_evidence(spark):
    rows = [*base(), publish(S + 4, S + 6, 10, 10),
            kit.event("mark_updated", S + 6, 5, perpetual_id=1, mark_price_pns=1010)]
    events, at, scope = kit.frame(spark, rows), kit.as_of(S + 6), FundingScope(S, S + 6, (1,))
    row = accounting.position_risk(events, REG, at, scope).first()
    assert [kit.coins(v) for v in (row.price_pnl_u, row.unsettled_u, row.total_pnl_u, row.equity_u)] == [10, -10, 0, 20]
    assert row.risk_status == "canonical-funding-covered" and row.mark_event_id.endswith(":5")
    history = funding.funded_history(events, REG, at, scope)
    schedule = funding.funding_schedule(events, REG, at, scope)
    proof = funding.checkpoint_evidence(history, schedule, funding.unsettled_funding(history, REG, scope), at, scope).first()
    ids = [i.split(":")[2] for i in proof.payment_event_ids]
    assert ids == [f"0xt{S + 4}_0", f"0xt{S}_1"] and proof.settlement_event_ids == []
    assert history_state(history).count() == 1


def test_timeline(spark):
    rows = [publish(S + 1, S + 5, 1, 1), publish(S + 2, S + 5, 2, 2, True), publish(S + 5, S + 9, 3, 5), scale(S + 6, 1)]
    events = kit.frame(spark, rows)
    assert funding.timeline_violations(events, kit.as_of(S + 7)).count() == 0
    row = funding.funding_timeline(events, kit.as_of(S + 7)).first()
    assert (row.observations, row.replacements, row.active_effective_block, row.pending, row.scale_exp) == (4, 1, S + 5, 1, 1)
    bad = {
        "bad_overwrite": [publish(S + 1, S + 5, 1, 1), publish(S + 2, S + 5, 2, 2)],
        "target_regresses": [publish(S + 1, S + 5, 1, 1), publish(S + 2, S + 7, 2, 3)],
        "sum_discontinuous": [publish(S + 1, S + 5, 1, 1), publish(S + 5, S + 9, 2, 9)],
    }
    for name, rows in bad.items():
        found = {r.violation for r in funding.timeline_violations(kit.frame(spark, rows), kit.as_of(S + 9)).collect()}
        assert found == {name}


def test_native_overflow_fails(spark):
    rows = base()
    rows[-1]["lot_lns"] = 10**37
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|overflow|ARITHMETIC"):
        value(spark, [*rows, publish(S + 4, S + 6, 10**6, 10**6)], S + 6)
