"""References must match the cutoff, the scope and the ledger before a figure is compared."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import kit
from tideledger.errors import DataQualityError
from tideledger.operators import accounting, evidence

CUT = kit.as_of(54773075)
REG = kit.registry()


def cut_columns():
    return {
        "chain_id": F.lit(CUT.chain_id), "as_of_block": F.lit(CUT.block_number), "as_of_block_hash": F.lit(CUT.block_hash),
        "as_of_log_index": F.lit(None).cast("int"), "as_of_timestamp_ms": F.lit(CUT.timestamp_ms),
    }


@pytest.fixture(scope="module")
def book(spark):
    events = kit.frame(spark, kit.open_position())
    marks = kit.marks_frame(spark, [dict(perpetual_id=1, mark_pns=712000, block_number=CUT.block_number, timestamp_ms=CUT.timestamp_ms)])
    positions = accounting.position_risk(events, REG, CUT, supplied_marks=marks).withColumn("entry_q16", accounting.entry_q16())
    return events, positions


def accounts(book):
    wallets = accounting.wallets(*book, REG, CUT)
    return wallets, wallets.select("account_id", "realized_pnl_u", "realized_funding_u", "fees_u", "free_balance_u").withColumns(cut_columns())


def statuses(rows):
    return {r.field: r.status for r in rows.collect()}


def test_account_totals(book):
    wallets, reference = accounts(book)
    one = reference.where("account_id = 42")
    changed = one.withColumns({"fees_u": F.col("fees_u") + 1, "free_balance_u": F.lit(None).cast("decimal(38,0)")})
    found = statuses(evidence.account_reconcile(wallets, changed, CUT))
    assert found == dict(realized_pnl_u="matched", realized_funding_u="matched", fees_u="mismatch", free_balance_u="unverified")


@pytest.mark.parametrize(
    "fault, name",
    [
        ("1L as as_of_block", "other_block"),
        ("'0x' as as_of_block_hash", "other_block_hash"),
        ("0 as as_of_log_index", "other_log"),
        ("cast(null as long) as as_of_timestamp_ms", "other_time"),
        ("1L as chain_id", "other_chain"),
        ("5000L as account_id", "unknown_account"),
        (None, "repeated_account"),
    ],
)
def test_account_references_that_fail(book, fault, name):
    wallets, reference = accounts(book)
    one = reference.where("account_id = 42")
    bad = one.unionByName(one) if fault is None else one.selectExpr(*[c for c in one.columns if not fault.endswith(f" as {c}")], fault)
    with pytest.raises(PySparkException, match=name):
        evidence.account_reconcile(wallets, bad, CUT).collect()


def references(spark, rows):
    schema = "account_id long, perpetual_id int, status string, lot_lns decimal(38,0), deposit_cns decimal(38,0), side_name string, entry_q16 decimal(38,0)"
    data = [(*r[:3], *(None if x is None else Decimal(x) for x in r[3:5]), r[5], None if r[6] is None else Decimal(r[6])) for r in rows]
    return spark.createDataFrame(data, schema).withColumns(cut_columns())


OPEN = (42, 1, "open", 100_000, 10_000_000_000, "long", 700_000 * 65_536)
EMPTY = (42, 10, "closed", 0, 0, None, None)


def test_positions_of_a_scope(spark, book):
    _, positions = book
    rows = evidence.position_reconcile(positions, references(spark, [OPEN, EMPTY]), CUT, (1, 10))
    assert {(r.perpetual_id, r.field, r.status) for r in rows.collect()} == {
        *((1, f, "matched") for f in ("status", "size", "deposit", "side", "entry")),
        *((10, f, "matched") for f in ("status", "size", "deposit")),
    }
    short = (42, 1, "open", 99_999, 10_000_000_000, "short", 700_000 * 65_536)
    wrong = statuses(evidence.position_reconcile(positions, references(spark, [short]), CUT, (1,)))
    assert (wrong["size"], wrong["side"], wrong["entry"]) == ("mismatch", "mismatch", "matched")
    away = evidence.excluded_positions(positions, references(spark, [EMPTY]), (10,))
    assert [(r.account_id, r.perpetual_id, r.status) for r in away.collect()] == [(42, 1, "open")]


@pytest.mark.parametrize(
    "rows, name",
    [
        ([OPEN], "incomplete_scope"),
        ([OPEN, EMPTY, EMPTY], "repeated_position"),
        ([OPEN, (42, 20, "closed", 0, 0, None, None)], "outside_scope"),
        ([OPEN, (42, 10, "closed", 1, 0, None, None)], "closed_not_empty"),
        ([OPEN, (42, 10, "paused", 0, 0, None, None)], "bad_status"),
        ([OPEN, (42, 10, "closed", None, 0, None, None)], "missing_amount"),
        ([(42, 1, "open", 1, 0, None, 5), EMPTY], "open_incomplete"),
    ],
)
def test_position_references_that_fail(spark, book, rows, name):
    reference = references(spark, rows)
    found = {r.violation for r in evidence.position_reference_violations(reference, CUT, (1, 10)).collect()}
    assert name in found
    with pytest.raises(PySparkException, match="position reference"):
        evidence.position_reconcile(book[1], reference, CUT, (1, 10)).collect()


def test_scopes_that_fail(spark, book):
    for cut, scope in ((CUT, ()), (CUT, (1, 1)), (CUT, (0, 1)), (kit.as_of(54773075, 3), (1,))):
        with pytest.raises(DataQualityError):
            evidence.position_reconcile(book[1], references(spark, [OPEN]), cut, scope)


def test_risk_with_the_liquidation_price(spark, book):
    events, _ = book
    marks = kit.marks_frame(spark, [dict(perpetual_id=1, mark_pns=712000, block_number=CUT.block_number, timestamp_ms=CUT.timestamp_ms)])
    rows = accounting.position_risk(events, REG, CUT, supplied_marks=marks).withColumns(
        {"unsettled_u": F.lit(0).cast("decimal(38,0)"), "liquidation_u": F.col("zero_funding_liquidation_u")}
    )
    fields = "maintenance_cns price_pnl_cns funding_cns total_pnl_cns equity_cns buffer_cns".split()
    ticks = rows.select(evidence.liquidation_ticks().alias("t")).first().t
    # long of 1 coin at 70,000, deposit 10,000, maintenance 4 %: 70,000 + 2,800 - 10,000
    assert ticks == 628_000
    reference = spark.createDataFrame([(42, 1)], "account_id long, perpetual_id int").withColumns(
        {f: F.lit(None).cast("decimal(38,0)") for f in fields} | {"liquidation_pns": F.lit(628_000).cast("decimal(38,0)")}
    )
    found = statuses(evidence.risk_scorecard(rows, reference, kit.UNIT // 10**6))
    assert found.pop("liquidation_pns") == "matched" and set(found.values()) == {"unverified"}
    off = reference.withColumn("liquidation_pns", F.col("liquidation_pns") + 1)
    assert statuses(evidence.risk_scorecard(rows, off, kit.UNIT // 10**6))["liquidation_pns"] == "mismatch"
    for bad, name in ((reference.withColumn("perpetual_id", F.lit(20)), "not_open"), (reference.unionByName(reference), "repeated_position")):
        with pytest.raises(PySparkException, match=name):
            evidence.risk_scorecard(rows, bad, kit.UNIT // 10**6).collect()
