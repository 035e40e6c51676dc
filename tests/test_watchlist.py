"""Facts of watched accounts: input profiles, held markets and accounts that cannot be replayed."""

import pytest
from pyspark.sql import functions as F

import kit
from tideledger.params import Coverage, FundingScope
from tideledger.plans import snapshot
from tideledger.schema import PROVENANCE

CUT = kit.as_of(54773075)
LATE = Coverage(143, kit.DEPLOYED + 5, CUT.block_number)


def opened(account, block, market):
    common = dict(account_id=account, perpetual_id=market)
    return [
        kit.event("account_created", block, account_id=account, owner="0x" + "1" * 40),
        kit.event("position_opened", block, 1, **common, position_type=1, leverage_hdths=700, deposit_cns=10_000_000_000,
                  price_pns=700000, lot_lns=100000, ins_fee_cns=0, prot_fee_cns=69000),
    ]


@pytest.fixture(scope="module")
def facts(spark):
    marks = [kit.event("mark_updated", 54773070 + i, 7, perpetual_id=m, mark_price_pns=712000 + i) for i in range(3) for m in (1, 10, 20)]
    rows = [*opened(1, 54773030, 1), *opened(2, 54773031, 20), *opened(3, 54773032, 10)[1:], *opened(4, 54773033, 1), *marks]
    profile = F.expr("case account_id when 2 then 'risk-hotpath-v2' else 'risk-hotpath-v3' end")
    given = F.struct(*[(profile if n == "ingestion_profile" else F.lit(None).cast("string")).alias(n) for n in PROVENANCE.names])
    events = kit.frame(spark, rows).withColumn("provenance", given)
    listed = spark.createDataFrame([(1,), (2,), (3,), (9,)], "account_id long")
    scope = FundingScope(kit.DEPLOYED, CUT.block_number, (1,))
    return snapshot.watched(events, listed, kit.registry(), CUT, LATE, scope)


def test_wallets_of_each_profile(facts):
    rows = {r.account_id: r for r in facts["wallets"].collect()}
    assert set(rows) == {1, 2, 3}  # the fourth is not watched, the ninth has no event
    assert (rows[1].market_input_profile, rows[2].market_input_profile, rows[3].market_input_profile) == ("canonical-v3", "unavailable-legacy-profile", None)
    assert rows[1].quality in ("canonical-funding-covered", "funding-checkpoint-unverified")
    assert (rows[2].quality, rows[3].quality) == ("marks-unavailable", "incomplete-history")
    assert kit.coins(rows[2].fees_u) == kit.coins(rows[1].fees_u) > 0
    assert rows[3].owner is None and rows[3].fees_u is None and rows[3].free_balance_u is None


def test_inputs_are_those_of_held_markets(facts):
    assert [(r.perpetual_id, r.kind, r.mark_price_pns) for r in facts["inputs"].collect()] == [(1, "mark_updated", 712002)]


def test_prices_count_for_covered_accounts_only(facts):
    rows = {r.account_id: r for r in facts["positions"].collect()}
    assert set(rows) == {1, 2} and rows[1].mark_pns == 712002 and rows[2].mark_pns is None and rows[2].unsettled_u is None
