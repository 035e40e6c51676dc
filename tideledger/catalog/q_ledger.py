"""Ledger, funding, accounting and analytics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideledger.catalog import binding as b
from tideledger.catalog import sqlbook as q
from tideledger.catalog.common import (
    CNS_UNITS,
    cns,
    eligibility,
    history,
    longs,
    plain_positions,
    positions,
    query,
    states,
    wallet_rows,
)
from tideledger.functions.exact import known_sum, trunc_div
from tideledger.operators import accounting, analytics, checks, evidence, funding, ledger
from tideledger.operators.ledger import POSITION, kind_is
from tideledger.params import Coverage
from tideledger.plans import snapshot
from tideledger.schema import PROVENANCE
from tideledger.session import checkpoint_folder
from tideledger.sources import publication

CUT, BLOCK = b.CUT, b.CUT.block_number
P = "account_id, CAST(perpetual_id AS BIGINT) AS perpetual_id"
LEDGER, PREV_LEDGER = q.ledger(), q.ledger(q.PREV, "_p")


def ident():
    return ["account_id", F.col("perpetual_id").cast("long").alias("perpetual_id")]


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


# ---- ledger -------------------------------------------------------------

HIST_SQL = (
    f"SELECT {P}, event_id, kind, status, {big('lot', 'lot_lns')}, {big('dep', 'deposit_cns')}, {big('side', 'side')}, "
    f"{big('entry', 'entry_pns')}, {big('res', 'entry_residue')}, {big('lev', 'leverage_hdths')}, {big('pnl', 'realized_pnl_cns')}, "
    f"{big('fund', 'realized_funding_cns')}, {big('fees', 'fees_cns')}, {big('opened_block', 'opened_block')}, "
    "CASE WHEN status<>'open' THEN CAST(ended_block AS BIGINT) END AS closed_block, last_event_id FROM hist"
)
STATE_COLUMNS = [
    "lot_lns", "deposit_cns", "side", "entry_pns", "entry_residue", "leverage_hdths", "realized_pnl_cns",
    "realized_funding_cns", "fees_cns", "opened_block", "closed_block",
]


@query("W1_position_history", q.with_book(LEDGER) + HIST_SQL)
def position_history(spark, sf):
    rows = ledger.position_history(b.book(spark, sf), CUT)
    return rows.select(*ident(), "event_id", "kind", "status", *longs(*STATE_COLUMNS), "last_event_id")


@query("W2_position_state", q.with_book(LEDGER) + HIST_SQL.replace("event_id, kind, status", "status", 1).replace("FROM hist", "FROM st"))
def position_state(spark, sf):
    rows = ledger.position_state(b.book(spark, sf), CUT)
    return rows.select(*ident(), "status", *longs(*STATE_COLUMNS), "last_event_id")


@query(
    "W3_transition_checks",
    q.with_book(LEDGER.replace("FROM book WHERE", "FROM (SELECT * REPLACE (CASE WHEN kind='position_increased' AND log_index%3=0 THEN 'order_request' ELSE kind END AS kind) FROM book) WHERE"))
    + """, c AS (SELECT *, lag(lot) OVER w AS plot, lag(dep) OVER w AS pdep, lag(side) OVER w AS pside, lag(status) OVER w AS pst FROM hist WINDOW w AS (PARTITION BY account_id, perpetual_id ORDER BY block_number, log_index)),
d AS (SELECT *, COALESCE(pst='open' AND plot>0,false) AS was FROM c)
SELECT violation, count(*) AS events FROM (SELECT unnest(list_filter([
 CASE WHEN kind='position_opened' AND was THEN 'already_open' END,
 CASE WHEN kind<>'position_opened' AND NOT was THEN 'no_open_position' END,
 CASE WHEN kind IN ('position_increased','position_decreased','position_deleveraged','position_inverted') AND was AND start_lot_lns<>plot THEN 'start_lot_differs' END,
 CASE WHEN start_deposit_cns IS NOT NULL AND was AND start_deposit_cns<>pdep THEN 'start_deposit_differs' END,
 CASE WHEN kind='position_increased' AND end_lot_lns<=plot THEN 'increase_not_larger' END,
 CASE WHEN kind='position_decreased' AND end_lot_lns>=plot THEN 'decrease_not_smaller' END,
 CASE WHEN kind='position_inverted' AND position_type=pside THEN 'inversion_keeps_side' END,
 CASE WHEN kind NOT IN ('position_opened','position_inverted') AND was AND position_type<>0 AND position_type<>pside THEN 'side_differs' END
], lambda x: x IS NOT NULL)) AS violation FROM d) GROUP BY 1""",
)
def transition_checks(spark, sf):
    """The book with a third of its increases turned into order requests, so transitions break."""
    lost = kind_is("position_increased") & (F.col("log_index") % 3 == 0)
    events = b.book(spark, sf).withColumn("kind", F.when(lost, "order_request").otherwise(F.col("kind")))
    bad = ledger.transition_violations(ledger.position_history(events, CUT))
    return bad.groupBy("violation").agg(F.count(F.lit(1)).alias("events"))


SEQ = "(block_number*2147483648+log_index)"


@query(
    "W4_account_state",
    q.with_book() + f"SELECT account_id, CAST(COALESCE(arg_max(balance_cns, {SEQ}) FILTER (WHERE balance_cns IS NOT NULL),0) AS BIGINT) AS balance_cns, max(CASE WHEN kind='account_created' THEN '0x{'cd' * 20}' END) AS owner, arg_max(event_id,{SEQ}) AS last_event_id, count(*) AS event_count FROM book WHERE account_id IS NOT NULL AND block_number<={BLOCK} GROUP BY 1",
)
def account_state(spark, sf):
    rows = ledger.account_state(b.book(spark, sf), CUT)
    return rows.select("account_id", *longs("balance_cns"), "owner", "last_event_id", "event_count")


@query(
    "W5_fill_log",
    q.with_book() + f"SELECT event_id, {P}, 'maker' AS liquidity, {big('price_pns', 'price_pns')}, {big('lot_lns', 'lot_lns')}, {big('fee_cns', 'fee_cns')} FROM book WHERE kind='maker_fill' AND block_number<={BLOCK}",
)
def fill_log(spark, sf):
    return ledger.fill_log(b.book(spark, sf), CUT).select("event_id", *ident(), "liquidity", *longs("price_pns", "lot_lns", "fee_cns"))


@query(
    "W6_latest_marks",
    q.with_book(q.marks()) + "SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, CAST(mark_pns AS BIGINT) AS mark_pns, mark_event_id, mark_ms AS timestamp_ms FROM cmark",
)
def latest_marks(spark, sf):
    return ledger.latest_marks(b.book(spark, sf), CUT).select(*longs("perpetual_id", "mark_pns"), "mark_event_id", "timestamp_ms")


@query(
    "W7_validity_intervals",
    q.with_book(LEDGER) + f"SELECT {P}, event_id, block_number AS valid_from, COALESCE(next_block,{BLOCK + 1}) AS valid_to, {big('lot', 'lot_lns')} FROM hist",
)
def validity(spark, sf):
    rows = ledger.validity_intervals(ledger.position_history(b.book(spark, sf), CUT), CUT)
    return rows.select(*ident(), "event_id", "valid_from", "valid_to", *longs("lot_lns"))


@query("W8_reset_spans", q.with_book(LEDGER) + f"SELECT {P}, event_id, kind, span FROM hist")
def reset_spans(spark, sf):
    rows = funding.reset_spans(ledger.position_history(b.book(spark, sf), CUT))
    return rows.select(*ident(), "event_id", "kind", *longs("span"))


ELIGIBLE_SQL = f"""elig AS (SELECT account_id, count(*) AS event_count, min(block_number) AS first_block, max(block_number) AS last_block,
  arg_min(kind,{SEQ})='account_created' AS eligible, CASE WHEN arg_min(kind,{SEQ})='account_created' THEN 'account-birth' ELSE 'incomplete-history' END AS basis,
  arg_max(event_id,{SEQ}) AS last_event_id FROM book WHERE account_id IS NOT NULL AND block_number<={BLOCK} GROUP BY 1)"""


# Faults for the replay checks, in both dialects: events without provenance, an inspection-only
# profile, two profiles in one account, another contract.
PROFILE = """CASE WHEN account_id % 13 = 3 AND kind = 'position_increased' THEN NULL WHEN account_id % 13 = 5 THEN 'risk-hotpath-v1'
  WHEN account_id % 13 = 7 AND kind LIKE 'position%' THEN 'risk-hotpath-v2' ELSE 'risk-hotpath-v3' END"""
FOREIGN = "account_id % 13 = 9 AND kind = 'collateral_deposit'"
SOURCED_SQL = f"""acc AS (SELECT account_id, count(*) AS event_count, min(block_number) AS first_block, max(block_number) AS last_block, arg_max(event_id,{SEQ}) AS last_event_id,
  arg_min(kind,{SEQ}) AS first_kind, bool_or({FOREIGN}) AS foreign_contract, bool_or({PROFILE} IS NULL) AS unproven, count(DISTINCT {PROFILE}) AS profiles, min({PROFILE}) AS profile
  FROM book WHERE account_id IS NOT NULL AND block_number<={BLOCK} GROUP BY 1),
judged AS (SELECT *, CASE WHEN foreign_contract THEN 'contract-mismatch' WHEN unproven THEN 'missing-provenance' WHEN profiles>1 THEN 'mixed-profiles' WHEN profile='risk-hotpath-v1' THEN 'ingestion-profile'
  WHEN first_kind='account_created' THEN 'account-birth' ELSE 'incomplete-history' END AS basis FROM acc)"""


def sourced_events(spark, sf):
    """The book as an index would deliver it, with faults in some accounts."""
    given = F.struct(*[F.expr(PROFILE if n == "ingestion_profile" else "cast(null as string)").alias(n) for n in PROVENANCE.names])
    contract = F.when(F.expr(FOREIGN), "0xother").otherwise(F.col("contract_address"))
    return b.book(spark, sf).withColumns({"provenance": given, "contract_address": contract})


def sourced_accounts(spark, sf):
    return accounting.replay_eligibility(sourced_events(spark, sf), CUT, b.BOUNDED, b.REGISTRY, indexed=True)


@query("W10_replay_eligibility", q.with_book(SOURCED_SQL) + "SELECT account_id, basis='account-birth' AS eligible, basis, first_block FROM judged")
def replay_eligibility(spark, sf):
    return sourced_accounts(spark, sf).select("account_id", "eligible", "basis", "first_block")


@query("A16_account_slice_summary", q.with_book(SOURCED_SQL) + "SELECT account_id, event_count, first_block, last_block, last_event_id, basis='account-birth' AS eligible FROM judged")
def account_slice(spark, sf):
    return sourced_accounts(spark, sf).select("account_id", "event_count", "first_block", "last_block", "last_event_id", "eligible")


# ---- funding ------------------------------------------------------------

FUND = [LEDGER, q.funding()]


@query(
    "J4_payment_x_scale",
    q.with_book(q.funding().split("sched AS")[0].rstrip().rstrip(",")) + "SELECT event_id, CAST(perpetual_id AS BIGINT) AS perpetual_id, funding_event_block, CAST(scale_exp AS BIGINT) AS scale_exp FROM pubs_x",
)
def payment_x_scale(spark, sf):
    rows = funding.scale_at_publication(b.book(spark, sf), CUT)
    return rows.select("event_id", *longs("perpetual_id"), "funding_event_block", *longs("scale_exp"))


@query(
    "N1_funding_timeline",
    q.with_book(*FUND) + f"""SELECT CAST(o.perpetual_id AS BIGINT) AS perpetual_id, o.observations, CAST(o.scale_exp AS BIGINT) AS scale_exp, CAST(s.replacements AS BIGINT) AS replacements, s.active_effective_block, s.active_event_id, CAST(s.active_payment_pns AS BIGINT) AS active_payment_pns, CAST(s.active_sum_pns AS BIGINT) AS active_sum_pns, s.pending, s.next_effective_block
FROM (SELECT perpetual_id, count(*) AS observations, arg_max(funding_scaling_exp,{SEQ}) FILTER (WHERE kind='funding_scale_updated') AS scale_exp FROM book WHERE kind IN ('market_funding','funding_scale_updated') AND block_number<={BLOCK} GROUP BY 1) o
JOIN (SELECT perpetual_id, sum(replacements) AS replacements, max(effective_block) FILTER (WHERE effective_block<={BLOCK}) AS active_effective_block,
  arg_max(event_id,effective_block) FILTER (WHERE effective_block<={BLOCK}) AS active_event_id, arg_max(pay,effective_block) FILTER (WHERE effective_block<={BLOCK}) AS active_payment_pns,
  arg_max(sm,effective_block) FILTER (WHERE effective_block<={BLOCK}) AS active_sum_pns,
  count(*) FILTER (WHERE effective_block>{BLOCK}) AS pending, min(effective_block) FILTER (WHERE effective_block>{BLOCK}) AS next_effective_block FROM sched GROUP BY 1) s USING (perpetual_id)""",
)
def funding_timeline(spark, sf):
    rows = funding.funding_timeline(b.book(spark, sf), CUT)
    return rows.select(
        *longs("perpetual_id"), "observations", *longs("scale_exp", "replacements"), "active_effective_block", "active_event_id",
        *longs("active_payment_pns", "active_sum_pns"), "pending", "next_effective_block",
    )


@query(
    "N2_funding_schedule",
    q.with_book(*FUND) + "SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, effective_block, event_id, CAST(pay AS BIGINT) AS payment_pns, CAST(sx AS BIGINT) AS scale_exp, row_number() OVER (PARTITION BY perpetual_id ORDER BY effective_block) AS ordinal, min(effective_block) OVER (PARTITION BY perpetual_id) AS baseline_block FROM sched WHERE perpetual_id IN (1,2,3,4)",
)
def funding_schedule(spark, sf):
    rows = funding.funding_schedule(b.book(spark, sf), b.REGISTRY, CUT, b.SCOPE)
    joined = rows.join(F.broadcast(funding.baselines(rows)), "perpetual_id")  # one row per registry market
    return joined.select(*longs("perpetual_id"), "effective_block", "event_id", *longs("payment_pns", "scale_exp"), "ordinal", "baseline_block")


@query("N3_funding_scope", q.with_book() + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, count(*) AS early_inputs FROM book WHERE kind IN ('market_funding','funding_scale_updated') AND perpetual_id IN (1,2,3,4) AND block_number<{b.BASE_BLOCK + 30000} GROUP BY 1")
def funding_scope(spark, sf):
    """Funding inputs before a scope that starts later than the data."""
    late = type(b.SCOPE)(b.BASE_BLOCK + 30_000, BLOCK, b.SCOPE.market_ids).validate(b.REGISTRY, CUT)
    rows = funding.scope_violations(b.book(spark, sf), CUT, late)
    return rows.groupBy(F.col("perpetual_id").cast("long").alias("perpetual_id")).agg(F.count(F.lit(1)).alias("early_inputs"))


@query(
    "J3_funding_x_interval",
    q.with_book(*FUND) + f"SELECT {P}, event_id, payment_event_id, effective_block, CAST(amount//65536 AS BIGINT) AS amount_e14 FROM pay_pairs",
)
def funding_x_interval(spark, sf):
    events = b.book(spark, sf)
    schedule = funding.funding_schedule(events, b.REGISTRY, CUT, b.SCOPE)
    pairs = funding.interval_payments(history(spark, sf), schedule)
    return pairs.select(*ident(), "event_id", "payment_event_id", "effective_block", trunc_div(F.col("amount_u"), 65536).cast("long").alias("amount_e14"))


@query(
    "N4_unsettled_funding",
    q.with_book(*FUND) + f"SELECT {P}, CAST(unsettled//65536 AS BIGINT) AS unsettled_e14, reset_event_id, reset_block FROM unset",
)
def unsettled(spark, sf):
    rows = funding.unsettled_funding(history(spark, sf), b.REGISTRY, b.SCOPE)
    return rows.select(*ident(), trunc_div(F.col("unsettled_u"), 65536).cast("long").alias("unsettled_e14"), "reset_event_id", "reset_block")


@query(
    "N5_checkpoint_evidence",
    q.with_book(*FUND) + f"""SELECT st.account_id, CAST(st.perpetual_id AS BIGINT) AS perpetual_id, COALESCE(pp.n,0) AS payments, COALESCE(pp.first_id,'-') AS first_payment, COALESCE(se.n,0) AS settlements
FROM st LEFT JOIN (SELECT account_id, perpetual_id, span, count(DISTINCT payment_event_id) AS n, arg_min(payment_event_id, effective_block) AS first_id FROM pay_pairs GROUP BY 1,2,3) pp ON pp.account_id=st.account_id AND pp.perpetual_id=st.perpetual_id AND pp.span=st.span
LEFT JOIN (SELECT account_id, perpetual_id, span, count(*) AS n FROM hist WHERE kind IN ('position_decreased','position_liquidated','position_deleveraged') GROUP BY 1,2,3) se ON se.account_id=st.account_id AND se.perpetual_id=st.perpetual_id AND se.span=st.span
WHERE st.is_open""",
)
def checkpoint_evidence(spark, sf):
    rows = history(spark, sf)
    schedule = funding.funding_schedule(b.book(spark, sf), b.REGISTRY, CUT, b.SCOPE)
    found = funding.checkpoint_evidence(rows, schedule, funding.unsettled_funding(rows, b.REGISTRY, b.SCOPE), CUT, b.SCOPE)
    ids = F.filter("payment_event_ids", lambda x: ~x.contains(":0xs"))
    return found.select(
        *ident(), F.size(ids).cast("long").alias("payments"),
        F.when(F.size(ids) > 0, F.element_at(ids, 1)).otherwise("-").alias("first_payment"),
        F.size("settlement_event_ids").cast("long").alias("settlements"),
    )


# ---- accounting ---------------------------------------------------------

def u(expression: str, name: str) -> str:
    return big(f"({expression})//{CNS_UNITS}", name)


RISK_SQL = (
    f"SELECT {P}, symbol, status, risk_status, CASE WHEN side=1 THEN 'long' ELSE 'short' END AS side_name, {big('mark', 'mark_pns')}, "
    f"{u('dep_u', 'deposit')}, {u('not_u', 'notional')}, {u('pnl_u', 'price_pnl')}, {u('maint_u', 'maintenance')}, {u('uns', 'funding')}, "
    f"{u('tot_u', 'total_pnl')}, {u('eq_u', 'equity')}, {u('eq_u-maint_u', 'buffer')}, {u('liq_u', 'liquidation')}, {u('zliq_u', 'zero_funding_liquidation')}, "
    f"{u('zeq_u', 'zero_funding_equity')}, reset_event_id FROM risk"
)


def risk_view(rows):
    return rows.select(
        *ident(), "symbol", "status", "risk_status", "side_name", *longs("mark_pns"), cns("deposit_u").alias("deposit"),
        cns("notional_u").alias("notional"), cns("price_pnl_u").alias("price_pnl"), cns("maintenance_u").alias("maintenance"),
        cns("unsettled_u").alias("funding"), cns("total_pnl_u").alias("total_pnl"), cns("equity_u").alias("equity"),
        cns("buffer_u").alias("buffer"), cns("liquidation_u").alias("liquidation"),
        cns("zero_funding_liquidation_u").alias("zero_funding_liquidation"),
        cns("zero_funding_equity_u").alias("zero_funding_equity"), "reset_event_id",
    )


@query("K1_position_risk", q.with_book(*q.FULL_RISK) + RISK_SQL)
def position_risk(spark, sf):
    return risk_view(positions(spark, sf))


PLAIN = [LEDGER, q.marks(), q.risk(funded=False)]


@query(
    "J2_position_x_mark",
    q.with_book(*PLAIN) + f"SELECT {P}, status, {big('mark', 'mark_pns')}, {u('not_u', 'notional')} FROM risk",
)
def position_x_mark(spark, sf):
    return plain_positions(spark, sf).select(*ident(), "status", *longs("mark_pns"), cns("notional_u").alias("notional"))


@query("K3_stale_degrade", q.with_book(*PLAIN) + "SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, count(*) AS open_positions, count(mark) AS marked, count(*)-count(pnl_u) AS unknown_pnl FROM risk WHERE is_open GROUP BY 1")
def stale_degrade(spark, sf):
    rows = plain_positions(spark, sf).where("is_open")
    return rows.groupBy(F.col("perpetual_id").cast("long").alias("perpetual_id")).agg(
        F.count(F.lit(1)).alias("open_positions"), F.count("mark_pns").alias("marked"),
        (F.count(F.lit(1)) - F.count("price_pnl_u")).alias("unknown_pnl"),
    )


@query("M5_effective_entry", q.with_book(*PLAIN) + f"SELECT {P}, {big('eq16', 'entry_q16')} FROM risk")
def effective_entry(spark, sf):
    rows = ledger.position_state(b.book(spark, sf), CUT)
    return rows.select(*ident(), accounting.entry_q16().cast("long").alias("entry_q16"))


@query("M6_price_pnl", q.with_book(*PLAIN) + f"SELECT {P}, {u('pnl_u', 'price_pnl')} FROM risk WHERE is_open")
def price_pnl(spark, sf):
    return plain_positions(spark, sf).where("is_open").select(*ident(), cns("price_pnl_u").alias("price_pnl"))


@query("M7_maintenance_margin", q.with_book(*PLAIN) + f"SELECT {P}, {u('maint_u', 'maintenance')} FROM risk WHERE is_open")
def maintenance(spark, sf):
    return plain_positions(spark, sf).where("is_open").select(*ident(), cns("maintenance_u").alias("maintenance"))


@query("M8_liquidation_price", q.with_book(*q.FULL_RISK) + f"SELECT {P}, {u('liq_u', 'liquidation')}, {u('zliq_u', 'zero_funding_liquidation')} FROM risk WHERE is_open")
def liquidation_price(spark, sf):
    rows = positions(spark, sf).where("is_open")
    return rows.select(*ident(), cns("liquidation_u").alias("liquidation"), cns("zero_funding_liquidation_u").alias("zero_funding_liquidation"))


@query("M9_equity_and_buffer", q.with_book(*q.FULL_RISK) + f"SELECT {P}, {u('eq_u', 'equity')}, {u('eq_u-maint_u', 'buffer')}, {u('zeq_u', 'zero_equity')}, {u('zeq_u-maint_u', 'zero_buffer')} FROM risk WHERE is_open")
def equity_and_buffer(spark, sf):
    rows = positions(spark, sf).where("is_open")
    return rows.select(
        *ident(), cns("equity_u").alias("equity"), cns("buffer_u").alias("buffer"),
        cns("zero_funding_equity_u").alias("zero_equity"), cns("zero_funding_buffer_u").alias("zero_buffer"),
    )


@query("M10_risk_status", q.with_book(*q.FULL_RISK) + "SELECT risk_status, count(*) AS positions FROM risk GROUP BY 1")
def risk_status(spark, sf):
    return positions(spark, sf).groupBy("risk_status").agg(F.count(F.lit(1)).alias("positions"))


@query(
    "A8_null_poison_sum",
    q.with_book(*PLAIN) + f"SELECT account_id, CAST(CASE WHEN count(pnl_u)=count(*) THEN sum(pnl_u)//{CNS_UNITS} END AS BIGINT) AS price_pnl FROM risk GROUP BY 1",
)
def null_poison_sum(spark, sf):
    rows = plain_positions(spark, sf).groupBy("account_id").agg(known_sum(F.col("price_pnl_u")).alias("s"))
    return rows.select("account_id", cns("s").alias("price_pnl"))


TOTALS_SQL = f"""tot AS (SELECT account_id, sum(pnl) AS pnl, sum(fund) AS fund, sum(fees) AS fees,
  CASE WHEN count(pnl_u)=count(*) THEN sum(pnl_u) END AS pnl_u, CASE WHEN count(uns)=count(*) THEN sum(uns) END AS uns,
  CASE WHEN count(tot_u)=count(*) THEN sum(tot_u) END AS tot_u, count(*) FILTER (WHERE is_open) AS open_positions, count(*) AS positions,
  bool_and(NOT is_open OR mark IS NOT NULL) AS all_marked, bool_and(NOT is_open OR uns IS NOT NULL) AS all_funded FROM risk GROUP BY 1),
acc AS (SELECT account_id, COALESCE(arg_max(balance_cns,{SEQ}) FILTER (WHERE balance_cns IS NOT NULL),0) AS balance FROM book WHERE account_id IS NOT NULL AND block_number<={BLOCK} GROUP BY 1),
wal AS (SELECT a.account_id, a.balance, COALESCE(pnl,0) AS pnl, COALESCE(fund,0) AS fund, COALESCE(fees,0) AS fees,
  CASE WHEN positions IS NULL THEN 0 ELSE pnl_u END AS pnl_u, CASE WHEN positions IS NULL THEN 0 ELSE uns END AS uns, CASE WHEN positions IS NULL THEN 0 ELSE tot_u END AS tot_u,
  COALESCE(open_positions,0) AS open_positions, COALESCE(positions,0) AS positions, COALESCE(all_marked,true) AS all_marked, COALESCE(all_funded,true) AS all_funded
  FROM acc a LEFT JOIN tot USING (account_id))"""
WALLET = [*q.FULL_RISK, TOTALS_SQL]


@query(
    "A9_wallet_totals",
    q.with_book(*WALLET) + f"SELECT account_id, {big('pnl', 'realized_pnl')}, {big('fund', 'realized_funding')}, {big('fees', 'fees')}, {u('pnl_u', 'price_pnl')}, {u('uns', 'funding')}, {u('tot_u', 'total_pnl')} FROM tot",
)
def wallet_totals(spark, sf):
    rows = accounting.wallet_totals(positions(spark, sf))
    return rows.select(
        "account_id", cns("realized_pnl_u").alias("realized_pnl"), cns("realized_funding_u").alias("realized_funding"),
        cns("fees_u").alias("fees"), cns("price_pnl_u").alias("price_pnl"), cns("unsettled_u").alias("funding"),
        cns("total_pnl_u").alias("total_pnl"),
    )


@query(
    "K2_wallet_snapshot",
    q.with_book(*WALLET) + f"""SELECT w.account_id, {big('balance', 'free_balance')}, {u('w.pnl_u', 'price_pnl')}, {u('w.tot_u', 'total_pnl')}, COALESCE(l.position_list,'') AS position_list
FROM wal w LEFT JOIN (SELECT account_id, string_agg(perpetual_id||'='||status, ',' ORDER BY perpetual_id) AS position_list FROM risk GROUP BY 1) l USING (account_id)""",
)
def wallet_snapshot(spark, sf):
    priced = positions(spark, sf)
    wallets = accounting.wallets(b.book(spark, sf), priced, b.REGISTRY, CUT)
    rows = accounting.wallet_documents(wallets, priced)
    text = F.array_join(F.transform("position_list", lambda p: F.concat(p["perpetual_id"].cast("string"), F.lit("="), p["status"])), ",")
    return rows.select(
        "account_id", cns("free_balance_u").alias("free_balance"), cns("price_pnl_u").alias("price_pnl"),
        cns("total_pnl_u").alias("total_pnl"), F.coalesce(text, F.lit("")).alias("position_list"),
    )


@query(
    "F11_wallet_query",
    q.with_book(*WALLET, ELIGIBLE_SQL) + f"SELECT w.account_id, CASE WHEN e.eligible THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN e.eligible THEN CAST(w.balance AS BIGINT) END AS free_balance FROM wal w JOIN elig e USING (account_id) WHERE w.account_id=12",
)
def wallet_query(spark, sf):
    rows = accounting.wallet_quality(wallet_rows(spark, sf), eligibility(spark, sf)).where("account_id = 12")
    return rows.select(
        "account_id", F.when(F.col("eligible"), "available").otherwise("unavailable").alias("status"),
        F.when(F.col("eligible"), cns("free_balance_u")).alias("free_balance"),
    )


@query(
    "K9_wallet_quality",
    q.with_book(*WALLET, ELIGIBLE_SQL) + "SELECT w.account_id, CASE WHEN NOT e.eligible THEN 'incomplete-history' WHEN NOT all_marked THEN 'marks-unavailable' WHEN NOT all_funded THEN 'funding-checkpoint-unverified' ELSE 'canonical-funding-covered' END AS quality FROM wal w JOIN elig e USING (account_id)",
)
def wallet_quality(spark, sf):
    return accounting.wallet_quality(wallet_rows(spark, sf), eligibility(spark, sf)).select("account_id", "quality")


@query(
    "J14_mark_x_source_event",
    q.with_book(q.marks()) + "SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, CASE WHEN perpetual_id%2=1 THEN mark_event_id END AS mark_event_id FROM cmark",
)
def mark_x_source(spark, sf):
    """Canonical marks as supplied, half of them with another price."""
    canonical = ledger.latest_marks(b.book(spark, sf), CUT)
    odd = F.col("perpetual_id") % 2 == 1
    given = canonical.withColumn("mark_pns", F.when(odd, F.col("mark_pns")).otherwise(F.col("mark_pns") + 1))
    return accounting.attach_source_event(given, canonical).select(*longs("perpetual_id"), "mark_event_id")


# ---- analytics ----------------------------------------------------------

WINDOW_ROWS = [(i, w.id, w.start_ms if w.start_ms is not None else 0, w.complete)
               for i, w in enumerate(analytics.report_windows(b.TAPE_CUT, b.TAPE_FULL, b.REGISTRY))]
SEEN = Coverage(b.CHAIN, b.BASE_BLOCK, b.TAPE_CUT.block_number, b.TAPE_CUT.timestamp_ms - 10 * b.DAY_MS)
SEEN_ROWS = [(i, w.id, w.start_ms if w.start_ms is not None else 0, w.complete)
             for i, w in enumerate(analytics.report_windows(b.TAPE_CUT, SEEN, b.REGISTRY))]


def flow_sql(windows, table="tape", block=b.TAPE_CUT.block_number, tag="") -> str:
    scale = "65536*CAST(10**(14-price_decimals-size_decimals) AS HUGEINT)"
    return f"""win{tag} AS {q.values(windows, ['i', '"window"', 'start_ms', 'complete'])},
fe{tag} AS (SELECT w."window", w.complete, t.* FROM {table} t JOIN win{tag} w ON t.timestamp_ms>=w.start_ms WHERE t.block_number<={block}),
mf{tag} AS (SELECT f."window", f.complete, f.perpetual_id, mk.symbol,
  COALESCE(SUM(CASE WHEN kind='maker_fill' THEN CAST(price_pns AS HUGEINT)*lot_lns*{scale} END),0)//{CNS_UNITS} AS volume,
  count(*) FILTER (WHERE kind='maker_fill') AS trades, COALESCE(SUM(CASE WHEN kind='maker_fill' THEN fee_cns END),0) AS fill_fees,
  COALESCE(SUM(CASE WHEN kind IN {q.RESETS} THEN COALESCE(ins_fee_cns,0)+COALESCE(prot_fee_cns,0) END),0) AS protocol_fees,
  COALESCE(SUM(CASE WHEN kind IN {q.RESETS} THEN ins_fee_cns END),0) AS insurance_fees,
  count(*) FILTER (WHERE kind='position_liquidated') AS liquidations,
  COALESCE(SUM(CASE WHEN kind='position_liquidated' THEN CAST(liq_price_pns AS HUGEINT)*liq_lot_lns*{scale} END),0)//{CNS_UNITS} AS liquidation_notional,
  count(DISTINCT account_id) AS active_accounts
  FROM fe{tag} f JOIN mk ON mk.perpetual_id=f.perpetual_id WHERE kind IN {q.TRADING} GROUP BY 1,2,3,4)"""


FLOW_OUT = ["volume", "trades", "fill_fees", "protocol_fees", "insurance_fees", "liquidations", "liquidation_notional", "active_accounts"]
FLOW_LIST = ", ".join(big(c, c) for c in FLOW_OUT)


def flow_columns():
    names = ["taker_volume_u", "fill_fees_u", "protocol_fees_u", "insurance_fees_u", "liquidation_notional_u"]
    out = ["volume", "fill_fees", "protocol_fees", "insurance_fees", "liquidation_notional"]
    return [cns(n).alias(o) for n, o in zip(names, out)] + longs("trades", "liquidations", "active_accounts")


def tape_flows(spark, sf, basis):
    windows = analytics.report_windows(b.TAPE_CUT, basis, b.REGISTRY)
    return analytics.window_flows(b.tape(spark, sf), b.TAPE_REGISTRY, b.TAPE_CUT, windows)


@query("A1_market_flows", q.with_tape(flow_sql(WINDOW_ROWS)) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, symbol, {FLOW_LIST} FROM mf WHERE \"window\"='coverage'")
def market_flows(spark, sf):
    _, markets = tape_flows(spark, sf, b.TAPE_FULL)
    return markets.where("window = 'coverage'").select(*longs("perpetual_id"), "symbol", *flow_columns())


TOTAL_SQL = """tf AS (SELECT w."window", w.complete, COALESCE(s.volume,0) AS volume, COALESCE(s.trades,0) AS trades, COALESCE(s.fill_fees,0) AS fill_fees, COALESCE(s.protocol_fees,0) AS protocol_fees,
  COALESCE(s.insurance_fees,0) AS insurance_fees, COALESCE(s.liquidations,0) AS liquidations, COALESCE(s.liquidation_notional,0) AS liquidation_notional, COALESCE(a.n,0) AS active_accounts, COALESCE(d.dep,0) AS deposits, COALESCE(d.wd,0) AS withdrawals
  FROM win w LEFT JOIN (SELECT "window", sum(volume) AS volume, sum(trades) AS trades, sum(fill_fees) AS fill_fees, sum(protocol_fees) AS protocol_fees, sum(insurance_fees) AS insurance_fees, sum(liquidations) AS liquidations, sum(liquidation_notional) AS liquidation_notional FROM mf GROUP BY 1) s USING ("window")
  LEFT JOIN (SELECT "window", count(DISTINCT account_id) AS n FROM fe WHERE kind IN {trading} GROUP BY 1) a USING ("window")
  LEFT JOIN (SELECT "window", sum(CASE WHEN kind='collateral_deposit' THEN amount_cns END) AS dep, sum(CASE WHEN kind='collateral_withdrawal' THEN amount_cns END) AS wd FROM fe GROUP BY 1) d USING ("window"))""".replace("{trading}", q.TRADING)


def total_list(names):
    return ", ".join(f"CASE WHEN complete THEN CAST({c} AS BIGINT) END AS {c}" for c in names)


def totals_view(totals):
    return totals.select(
        "window", "status", *flow_columns(), cns("deposits_u").alias("deposits"), cns("withdrawals_u").alias("withdrawals"),
        cns("net_flow_u").alias("net_flow"),
    )


TOTAL_SELECT = f"SELECT \"window\", CASE WHEN complete THEN 'complete' ELSE 'incomplete' END AS status, {total_list([*FLOW_OUT, 'deposits', 'withdrawals'])}, CASE WHEN complete THEN CAST(deposits-withdrawals AS BIGINT) END AS net_flow FROM tf"


@query("A2_flow_totals", q.with_tape(flow_sql(WINDOW_ROWS), TOTAL_SQL) + TOTAL_SELECT)
def flow_totals(spark, sf):
    totals, _ = tape_flows(spark, sf, b.TAPE_FULL)
    return totals_view(totals)


@query("A3_window_flows", q.with_tape(flow_sql(SEEN_ROWS)) + f"SELECT \"window\", CAST(perpetual_id AS BIGINT) AS perpetual_id, symbol, {FLOW_LIST} FROM mf WHERE complete")
def window_flows(spark, sf):
    """Coverage observed for ten days: 24h and 7d are complete, 30d is not."""
    _, markets = tape_flows(spark, sf, SEEN)
    return markets.select("window", *longs("perpetual_id"), "symbol", *flow_columns())


@query(
    "A4_window_completeness",
    q.with_tape(flow_sql(SEEN_ROWS), TOTAL_SQL)
    + "SELECT \"window\", CASE WHEN complete THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN complete THEN CAST(volume AS BIGINT) END AS volume, e.n AS event_count, e.first_event_id, e.last_event_id FROM tf JOIN (SELECT \"window\", count(*) AS n, arg_min(event_id,{SEQ}) AS first_event_id, arg_max(event_id,{SEQ}) AS last_event_id FROM fe GROUP BY 1) e USING (\"window\")".replace("{SEQ}", "({'a': block_number, 'b': log_index, 'c': event_id})"),
)
def window_completeness(spark, sf):
    windows = analytics.report_windows(b.TAPE_CUT, SEEN, b.REGISTRY)
    events = b.tape(spark, sf)
    totals, _ = analytics.window_flows(events, b.TAPE_REGISTRY, b.TAPE_CUT, windows)
    counted = analytics.window_events(events, b.TAPE_CUT, windows)
    # Four windows.
    return totals.join(F.broadcast(counted), "window").select(
        "window", "status", cns("taker_volume_u").alias("volume"), "event_count", "first_event_id", "last_event_id"
    )


METRIC_SQL = f"""pm AS (SELECT COALESCE(e.perpetual_id,r.perpetual_id) AS perpetual_id, e.volume, r.oi, r.tvl, e.liquidations, e.fees,
   (SELECT count(DISTINCT a) FROM (SELECT account_id AS a FROM book x WHERE x.perpetual_id=e.perpetual_id AND x.account_id IS NOT NULL AND x.block_number<={BLOCK} UNION SELECT account_id FROM risk y WHERE y.is_open AND y.perpetual_id=e.perpetual_id)) AS active_accounts
  FROM (SELECT perpetual_id, SUM(CASE WHEN kind='maker_fill' THEN CAST(price_pns AS HUGEINT)*lot_lns*65536*CAST(10**(14-price_decimals-size_decimals) AS HUGEINT) END)//{CNS_UNITS} AS volume, count(*) FILTER (WHERE kind='position_liquidated') AS liquidations,
     SUM(CASE WHEN kind IN {q.RESETS} THEN COALESCE(ins_fee_cns,0)+COALESCE(prot_fee_cns,0) END) AS fees FROM book JOIN mk USING (perpetual_id) WHERE block_number<={BLOCK} GROUP BY 1) e
  LEFT JOIN (SELECT perpetual_id, COALESCE(SUM(not_u),0)//{CNS_UNITS} AS oi, SUM(dep_u)//{CNS_UNITS} AS tvl FROM risk WHERE is_open GROUP BY 1) r USING (perpetual_id))"""


@query("A5_protocol_metrics", q.with_book(*PLAIN, METRIC_SQL) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, {big('volume', 'volume')}, {big('oi', 'open_interest')}, {big('tvl', 'tvl')}, {big('fees', 'protocol_fees')}, liquidations, active_accounts FROM pm")
def protocol_metrics(spark, sf):
    rows = analytics.protocol_metrics(b.book(spark, sf), plain_positions(spark, sf), b.REGISTRY, CUT, strict=False)
    return rows.select(
        *longs("perpetual_id"), cns("taker_volume_u").alias("volume"), cns("open_interest_u").alias("open_interest"),
        cns("tvl_u").alias("tvl"), cns("protocol_fees_u").alias("protocol_fees"), *longs("liquidations", "active_accounts"),
    )


@query("Q2_metric_gate", q.with_book(*PLAIN, METRIC_SQL) + "SELECT count(*) AS markets, count(*) FILTER (WHERE volume<0) + count(*) FILTER (WHERE oi<0 OR tvl<0) AS violations FROM pm")
def metric_gate(spark, sf):
    rows = analytics.protocol_metrics(b.book(spark, sf), plain_positions(spark, sf), b.REGISTRY, CUT, strict=False)
    bad = checks.metric_gate(rows).agg(F.count(F.lit(1)).alias("violations"))
    return rows.agg(F.count(F.lit(1)).alias("markets")).crossJoin(F.broadcast(bad))  # two single rows


STATE_SQL = f"""ms AS (SELECT perpetual_id, symbol, count(*) AS open_positions, CASE WHEN count(not_u)=count(*) THEN COALESCE(SUM(CASE WHEN side=1 THEN not_u END),0) END AS long_u,
  CASE WHEN count(not_u)=count(*) THEN COALESCE(SUM(CASE WHEN side<>1 THEN not_u END),0) END AS short_u, SUM(dep_u) AS col_u, max(mark) AS mark FROM risk WHERE is_open GROUP BY 1,2),
ms2 AS (SELECT *, long_u+short_u AS oi_u, CASE WHEN long_u+short_u<>0 THEN ((long_u-short_u)*1000000)//(long_u+short_u) END AS skew FROM ms)"""
STATE = [*PLAIN, STATE_SQL]


@query("A6_market_state", q.with_book(*STATE) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, symbol, open_positions, {u('long_u', 'long_interest')}, {u('short_u', 'short_interest')}, {u('oi_u', 'open_interest')}, {u('col_u', 'collateral')}, {big('skew', 'skew_ppm')}, CASE WHEN oi_u IS NULL THEN 'mark-unavailable' ELSE 'complete' END AS status FROM ms2")
def market_state(spark, sf):
    return states(spark, sf).select(
        *longs("perpetual_id"), "symbol", "open_positions", cns("long_u").alias("long_interest"), cns("short_u").alias("short_interest"),
        cns("open_interest_u").alias("open_interest"), cns("collateral_u").alias("collateral"), "skew_ppm", "status",
    )


@query("A10_skew", q.with_book(*STATE) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, {big('skew', 'skew_ppm')} FROM ms2")
def market_skew(spark, sf):
    return states(spark, sf).select(*longs("perpetual_id"), "skew_ppm")


@query("A7_protocol_state", q.with_book(*STATE) + f"SELECT CASE WHEN bool_and(oi_u IS NOT NULL) THEN 'complete' ELSE 'partial' END AS status, CAST(sum(open_positions) AS BIGINT) AS open_positions, CASE WHEN count(oi_u)=count(*) THEN CAST(sum(oi_u)//{CNS_UNITS} AS BIGINT) END AS open_interest, CAST(sum(col_u)//{CNS_UNITS} AS BIGINT) AS collateral FROM ms2")
def protocol_state(spark, sf):
    row = analytics.protocol_state(states(spark, sf), b.FULL, b.REGISTRY)
    return row.select("status", *longs("open_positions"), cns("open_interest_u").alias("open_interest"), cns("collateral_u").alias("collateral"))


BOOK_WINDOWS = [(i, w.id, w.start_ms if w.start_ms is not None else 0, w.complete)
                for i, w in enumerate(analytics.report_windows(CUT, b.FULL, b.REGISTRY))]
BOOK_FLOWS = flow_sql(BOOK_WINDOWS, "book", BLOCK)


def book_flows(spark, sf, cut=CUT):
    windows = analytics.report_windows(cut, b.FULL, b.REGISTRY)
    return analytics.window_flows(b.book(spark, sf), b.REGISTRY, cut, windows)


@query("U5_market_coverage_merge", q.with_book(*STATE, BOOK_FLOWS) + f"SELECT CAST(COALESCE(m.perpetual_id,f.perpetual_id) AS BIGINT) AS perpetual_id, CAST(COALESCE(f.volume,0) AS BIGINT) AS volume, COALESCE(f.active_accounts,0) AS active_accounts, CAST(m.oi_u//{CNS_UNITS} AS BIGINT) AS open_interest, CAST(m.skew AS BIGINT) AS skew_ppm FROM ms2 m FULL JOIN (SELECT * FROM mf WHERE \"window\"='coverage') f USING (perpetual_id)")
def market_coverage(spark, sf):
    _, flows = book_flows(spark, sf)
    rows = analytics.market_coverage(flows.where("window = 'coverage'").drop("window"), states(spark, sf))
    return rows.select(*longs("perpetual_id"), cns("taker_volume_u").alias("volume"), *longs("active_accounts"), cns("open_interest_u").alias("open_interest"), "skew_ppm")


@query("K5_protocol_view", q.with_book(*STATE, BOOK_FLOWS, TOTAL_SQL) + f"SELECT CAST(volume AS BIGINT) AS volume, CAST(trades AS BIGINT) AS trades, active_accounts, (SELECT count(*) FROM ms2) AS markets, (SELECT CAST(sum(open_positions) AS BIGINT) FROM ms2) AS open_positions FROM tf WHERE \"window\"='coverage'")
def protocol_view(spark, sf):
    totals, _ = book_flows(spark, sf)
    view = snapshot.protocol_view(totals, states(spark, sf))
    return view.select(cns("taker_volume_u").alias("volume"), *longs("trades", "active_accounts", "markets", "open_positions"))


@query(
    "K4_historical_snapshot",
    q.with_book(*q.FULL_RISK, ELIGIBLE_SQL) + f"""SELECT 'flow' AS part, CAST(perpetual_id AS BIGINT) AS perpetual_id, CAST(sum(CAST(price_pns AS HUGEINT)*lot_lns*65536*CAST(10**(14-price_decimals-size_decimals) AS HUGEINT))//{CNS_UNITS} AS BIGINT) AS amount, count(*) AS n FROM book JOIN mk USING (perpetual_id) WHERE kind='maker_fill' AND block_number BETWEEN {b.PREVIOUS.block_number + 1} AND {BLOCK} GROUP BY 2
UNION ALL SELECT 'position', CAST(r.perpetual_id AS BIGINT), CAST(sum(r.dep_u)//{CNS_UNITS} AS BIGINT), count(*) FROM risk r JOIN elig e USING (account_id) WHERE e.eligible AND r.is_open GROUP BY 2""",
)
def historical_snapshot(spark, sf):
    """Flows of a pinned window for all accounts, positions for replayable accounts."""
    events = b.book(spark, sf)
    window = events.where(F.col("block_number").between(b.PREVIOUS.block_number + 1, BLOCK))
    return snapshot.historical(window, events, positions(spark, sf), eligibility(spark, sf), b.REGISTRY, CUT).select(
        "part", *longs("perpetual_id"), cns("amount_u").alias("amount"), *longs("n")
    )


WATCHED_SQL = """seen AS (SELECT DISTINCT account_id FROM book WHERE kind='position_opened'),
held AS (SELECT DISTINCT perpetual_id FROM st JOIN judged USING (account_id) WHERE is_open AND basis='account-birth' AND profile='risk-hotpath-v3')"""


def watched_facts(spark, sf):
    """Everybody who ever opened a position is watched."""
    events = sourced_events(spark, sf)
    return snapshot.watched(events, events.where(kind_is("position_opened")).select("account_id"), b.REGISTRY, CUT, b.BOUNDED)


@query(
    "K8_watchlist_wallets",
    q.with_book(LEDGER, q.marks(), SOURCED_SQL, WATCHED_SQL, f"""held_by AS (SELECT account_id, sum(pnl) AS pnl, sum(fees) AS fees, count(*) FILTER (WHERE is_open) AS n_open,
 bool_and(NOT is_open OR COALESCE({CUT.timestamp_ms}-c.mark_ms<60000,false)) AS all_marked FROM st LEFT JOIN cmark c USING (perpetual_id) GROUP BY 1),
bal AS (SELECT account_id, COALESCE(arg_max(balance_cns,{SEQ}) FILTER (WHERE balance_cns IS NOT NULL),0) AS balance FROM book WHERE account_id IS NOT NULL AND block_number<={BLOCK} GROUP BY 1)""")
    + f"""SELECT account_id, basis, {big("CASE WHEN ok THEN pnl END", 'realized_pnl')}, {big("CASE WHEN ok THEN fees END", 'fees')}, {big("CASE WHEN ok THEN balance END", 'free_balance')},
 CASE WHEN ok THEN CASE WHEN profile='risk-hotpath-v3' THEN 'canonical-v3' ELSE 'unavailable-legacy-profile' END END AS market_input_profile,
 CASE WHEN NOT ok THEN 'incomplete-history' WHEN profile<>'risk-hotpath-v3' OR NOT all_marked THEN 'marks-unavailable' WHEN n_open>0 THEN 'funding-checkpoint-unverified' ELSE 'canonical-funding-covered' END AS quality
FROM (SELECT account_id, basis, basis='account-birth' AS ok, profile, COALESCE(pnl,0) AS pnl, COALESCE(fees,0) AS fees, balance, COALESCE(all_marked,true) AS all_marked, COALESCE(n_open,0) AS n_open
 FROM judged JOIN seen USING (account_id) JOIN bal USING (account_id) LEFT JOIN held_by USING (account_id))""",
)
def watchlist_wallets(spark, sf):
    """Wallets of a watchlist with the profile of their inputs; none but replayable accounts have figures."""
    rows = watched_facts(spark, sf)["wallets"]
    return rows.select(
        "account_id", "basis", cns("realized_pnl_u").alias("realized_pnl"), cns("fees_u").alias("fees"), cns("free_balance_u").alias("free_balance"),
        "market_input_profile", "quality",
    )


@query(
    "K8_watchlist_inputs",
    q.with_book(LEDGER, q.marks(), SOURCED_SQL, WATCHED_SQL)
    + f"""SELECT kind, CAST(perpetual_id AS BIGINT) AS perpetual_id, count(*) AS events, arg_max(event_id,{SEQ}) AS last_event_id FROM book WHERE kind IN ('market_funding','funding_scale_updated') AND block_number<={BLOCK} AND perpetual_id IN (SELECT perpetual_id FROM held) GROUP BY 1,2
UNION ALL SELECT 'mark_updated', CAST(perpetual_id AS BIGINT), 1, mark_event_id FROM cmark WHERE perpetual_id IN (SELECT perpetual_id FROM held)""",
)
def watchlist_inputs(spark, sf):
    """Market inputs that a watchlist reads: funding of the held markets and one mark of each."""
    rows = watched_facts(spark, sf)["inputs"]
    return rows.groupBy("kind", F.col("perpetual_id").cast("long").alias("perpetual_id")).agg(
        F.count(F.lit(1)).alias("events"), F.max_by("event_id", ledger.sequence()).alias("last_event_id")
    )


STATE_TEXT = ["account_id", "perpetual_id", "status", "lot_lns", "deposit_cns"]


def _level_sql(name: str, source: str, key: str) -> str:
    return f"{name} AS (SELECT {key} AS up, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM {source} GROUP BY 1)"


@query(
    "E7_checkpoint_hashes",
    q.with_book(
        LEDGER, "tx AS (SELECT sha256(account_id||'|'||perpetual_id||'|'||status||'|'||CAST(lot AS BIGINT)||'|'||CAST(dep AS BIGINT)) AS h0, count(*) AS n FROM st GROUP BY 1)",
        "t0 AS (SELECT sha256(h0||':'||n) AS h, n FROM tx)", _level_sql("t1", "t0", "substr(h,1,9)"), _level_sql("t2", "t1", "substr(up,1,6)"),
        _level_sql("t3", "t2", "substr(up,1,3)"), _level_sql("t4", "t3", "''"),
    ) + "SELECT CAST(n AS BIGINT) AS rows, 'sha256:'||h AS hash FROM t4",
)
def checkpoint_hashes(spark, sf):
    """The hash of all position states, as a manifest holds it."""
    return evidence.checkpoint_hash(ledger.position_state(b.book(spark, sf), CUT), STATE_TEXT)


@query("S12_publish_tables", q.with_book(LEDGER) + f"SELECT {P}, status, {big('lot', 'lot_lns')} FROM st")
def publish_tables(spark, sf):
    """Position states published as a table and loaded again by its commit."""
    root = f"{checkpoint_folder(spark)}/published-{uuid.uuid4().hex}"
    state = ledger.position_state(b.book(spark, sf), CUT).select(*POSITION, "status", "lot_lns")
    facts = dict(as_of_block=CUT.block_number, as_of_log=None, as_of_block_hash=CUT.block_hash, processed_block=CUT.block_number, inputs_hash="book")
    publication.publish_tables(spark, {"positions": state}, root, "main", **facts)
    tables = publication.load_tables(spark, root, "main", 86_400)
    return tables["positions"].select(*ident(), "status", *longs("lot_lns"))


# ---- reconciliation -----------------------------------------------------

def at_cut():
    """The cutoff that a reference names."""
    return [
        F.lit(CUT.chain_id).alias("chain_id"), F.lit(CUT.block_number).alias("as_of_block"), F.lit(CUT.block_hash).alias("as_of_block_hash"),
        F.lit(None).cast("int").alias("as_of_log_index"), F.lit(CUT.timestamp_ms).alias("as_of_timestamp_ms"),
    ]


@query(
    "E2_account_reconcile",
    q.with_book(*WALLET) + f"""SELECT account_id, field, CASE WHEN actual IS NULL OR expected IS NULL THEN 'unverified' WHEN actual=expected THEN 'matched' ELSE 'mismatch' END AS status FROM (
  SELECT account_id, 'realized_pnl_u' AS field, pnl AS actual, pnl+CASE WHEN account_id%3=0 THEN 1 ELSE 0 END AS expected FROM wal UNION ALL
  SELECT account_id, 'realized_funding_u', fund, fund FROM wal UNION ALL SELECT account_id, 'fees_u', fees, CASE WHEN account_id%5<>0 THEN fees END FROM wal UNION ALL
  SELECT account_id, 'free_balance_u', balance, balance FROM wal)""",
)
def account_reconcile(spark, sf):
    """A reference at the same cutoff that differs for every third account and lacks fees for every fifth."""
    wallets = wallet_rows(spark, sf)
    a = F.col("account_id")
    reference = wallets.select(
        "account_id", (F.col("realized_pnl_u") + F.when(a % 3 == 0, F.lit(CNS_UNITS)).otherwise(F.lit(0))).alias("realized_pnl_u"),
        "realized_funding_u", F.when(a % 5 != 0, F.col("fees_u")).alias("fees_u"), "free_balance_u", *at_cut(),
    )
    return evidence.account_reconcile(wallets, reference, CUT).select("account_id", "field", "status")


SCOPED = (1, 2, 3, 4)
# A reference names every market of its scope for each account, open or closed.
PAIRS_SQL = f"""pairs AS (SELECT account_id, m.perpetual_id FROM (SELECT DISTINCT account_id FROM risk), (SELECT unnest({list(SCOPED)}) AS perpetual_id) m)"""
E3_SQL = f"""{PAIRS_SQL},
pr AS (SELECT account_id, perpetual_id, CASE WHEN is_open THEN 'open' ELSE 'closed' END AS status, CASE WHEN is_open THEN lot ELSE 0 END + CASE WHEN is_open AND account_id%4=0 THEN 1 ELSE 0 END AS rlot,
  CASE WHEN is_open THEN dep ELSE 0 END AS rdep, CASE WHEN is_open THEN side END AS rside, CASE WHEN is_open THEN eq16 END AS rentry, COALESCE(status,'closed') AS cstatus, COALESCE(lot,0) AS lot, COALESCE(dep,0) AS dep,
  CASE WHEN status='open' THEN side END AS cside, CASE WHEN status='open' THEN eq16 END AS centry FROM pairs LEFT JOIN risk USING (account_id, perpetual_id)),
pc AS (SELECT account_id, perpetual_id, 'status' AS field, cstatus=status AS ok FROM pr UNION ALL SELECT account_id, perpetual_id, 'size', lot=rlot FROM pr UNION ALL SELECT account_id, perpetual_id, 'deposit', dep=rdep FROM pr
  UNION ALL SELECT account_id, perpetual_id, 'side', cside IS NOT DISTINCT FROM rside FROM pr WHERE status='open' OR cstatus='open' UNION ALL SELECT account_id, perpetual_id, 'entry', centry IS NOT DISTINCT FROM rentry FROM pr WHERE status='open' OR cstatus='open')"""


def _position_reference(spark, sf):
    """Reference positions of four markets from the state, one lot off for every fourth account."""
    rows = plain_positions(spark, sf).withColumn("entry_q16", accounting.entry_q16())
    pairs = rows.select("account_id").distinct().select("account_id", F.explode(F.array(*[F.lit(m) for m in SCOPED])).alias("perpetual_id"))
    live, a = F.coalesce("is_open", F.lit(False)), F.col("account_id")
    zero = F.lit(0).cast("decimal(38,0)")
    known = rows.select(*POSITION, "is_open", "lot_lns", "deposit_cns", "side_name", "entry_q16")
    reference = pairs.join(known, POSITION, "left").select(
        *POSITION, F.when(live, "open").otherwise("closed").alias("status"),
        (F.when(live, F.col("lot_lns")).otherwise(zero) + F.when(live & (a % 4 == 0), F.lit(1)).otherwise(F.lit(0))).alias("lot_lns"),
        F.when(live, F.col("deposit_cns")).otherwise(zero).alias("deposit_cns"),
        F.when(live, F.col("side_name")).alias("side_name"), F.when(live, F.col("entry_q16")).alias("entry_q16"), *at_cut(),
    )
    return rows, reference


def _position_checks(spark, sf):
    return evidence.position_reconcile(*_position_reference(spark, sf), CUT, SCOPED)


@query("E3_position_reconcile", q.with_book(*PLAIN, E3_SQL) + f"SELECT {P}, field, CASE WHEN ok THEN 'matched' ELSE 'mismatch' END AS status FROM pc")
def position_reconcile(spark, sf):
    return _position_checks(spark, sf).select(*ident(), "field", "status")


@query("E3_excluded_positions", q.with_book(*PLAIN) + f"SELECT {P}, status FROM risk WHERE perpetual_id NOT IN {SCOPED}")
def excluded_positions(spark, sf):
    """Ledger positions in markets that the reference does not cover."""
    rows, reference = _position_reference(spark, sf)
    return evidence.excluded_positions(rows, reference, SCOPED).select(*ident(), "status")


@query(
    "E3_reference_faults",
    q.with_book(*PLAIN, E3_SQL) + f"""SELECT account_id, CAST(perpetual_id AS BIGINT) AS perpetual_id, violation FROM (
 SELECT account_id, perpetual_id, CASE account_id%23 WHEN 1 THEN 'other_block' WHEN 2 THEN 'other_block_hash' WHEN 3 THEN 'other_log' WHEN 4 THEN 'other_time' WHEN 5 THEN 'bad_status' WHEN 6 THEN 'negative_amount'
   WHEN 9 THEN 'other_chain' END AS violation FROM pr WHERE perpetual_id=2 OR account_id%23 IN (1,2,3,4,9)
 UNION ALL SELECT account_id, perpetual_id, 'closed_not_empty' FROM pr WHERE account_id%23=6 AND perpetual_id=2 AND status='closed'
 UNION ALL SELECT account_id, perpetual_id, 'open_incomplete' FROM pr WHERE account_id%23=6 AND perpetual_id=2 AND status='open'
 UNION ALL SELECT account_id, perpetual_id, 'open_incomplete' FROM pr WHERE account_id%23=10 AND status='open'
 UNION ALL SELECT account_id, CASE WHEN perpetual_id=3 THEN 9 ELSE perpetual_id END, 'outside_scope' FROM pr WHERE account_id%23=7 AND perpetual_id=3
 UNION ALL SELECT account_id, perpetual_id, 'incomplete_scope' FROM pr WHERE account_id%23=8 AND perpetual_id<>4
 UNION ALL SELECT account_id, perpetual_id, 'incomplete_scope' FROM pr, (VALUES (1),(2)) t(i) WHERE account_id%23=11 AND (i=1 OR perpetual_id=1)
 UNION ALL SELECT account_id, perpetual_id, 'repeated_position' FROM pr, (VALUES (1),(2)) t(i) WHERE account_id%23=11 AND perpetual_id=1) WHERE violation IS NOT NULL""",
)
def reference_faults(spark, sf):
    """The references with faults of every kind planted by account."""
    _, reference = _position_reference(spark, sf)
    fault, second = F.col("account_id") % 23, F.col("perpetual_id") == 2
    broken = reference.withColumns(
        {
            "as_of_block": F.when(fault == 1, F.col("as_of_block") - 1).otherwise(F.col("as_of_block")),
            "as_of_block_hash": F.when(fault == 2, F.lit("0xother")).otherwise(F.col("as_of_block_hash")),
            "as_of_log_index": F.when(fault == 3, F.lit(0)),
            "as_of_timestamp_ms": F.when(fault == 4, F.col("as_of_timestamp_ms") + 1).otherwise(F.col("as_of_timestamp_ms")),
            "status": F.when((fault == 5) & second, F.lit("paused")).otherwise(F.col("status")),
            "lot_lns": F.when((fault == 6) & second, F.lit(-1)).otherwise(F.col("lot_lns")).cast("decimal(38,0)"),
            "chain_id": F.when(fault == 9, F.col("chain_id") + 1).otherwise(F.col("chain_id")),
            "side_name": F.when(fault != 10, F.col("side_name")),
        }
    )
    moved = broken.withColumn("perpetual_id", F.when((fault == 7) & (F.col("perpetual_id") == 3), F.lit(9)).otherwise(F.col("perpetual_id")))
    short = moved.where((fault != 8) | (F.col("perpetual_id") != 4))
    twice = short.where((fault == 11) & (F.col("perpetual_id") == 1))
    return evidence.position_reference_violations(short.unionByName(twice), CUT, SCOPED).select(*ident(), "violation")


@query("J10_canonical_x_reference", q.with_book(*PLAIN, E3_SQL) + "SELECT field, CASE WHEN ok THEN 'matched' ELSE 'mismatch' END AS status, count(*) AS checks FROM pc GROUP BY 1,2")
def canonical_x_reference(spark, sf):
    return _position_checks(spark, sf).groupBy("field", "status").agg(F.count(F.lit(1)).alias("checks"))


@query("A15_scorecard_rollup", q.with_book(*PLAIN, E3_SQL) + "SELECT account_id, CASE WHEN bool_or(NOT ok) THEN 'mismatch' ELSE 'matched' END AS status, count(*) AS checks, count(*) FILTER (WHERE ok) AS matched FROM pc GROUP BY 1")
def scorecard_rollup(spark, sf):
    return evidence.rollup(_position_checks(spark, sf), ["account_id"])


SCORE_SQL = f"""sc AS (SELECT account_id, perpetual_id, maint_u//{CNS_UNITS} AS mt, pnl_u//{CNS_UNITS} AS pp, uns//{CNS_UNITS} AS fu, dep, liq_u//(65536*CAST(10**(14-pd) AS HUGEINT)) AS lq FROM risk WHERE is_open),
s2 AS (SELECT *, pp+fu AS tp, dep+pp+fu AS eq, dep+pp+fu-mt AS bu FROM sc)"""


@query("M17_component_projection", q.with_book(*q.FULL_RISK, SCORE_SQL) + f"SELECT {P}, {big('fu', 'funding')}, {big('tp', 'pnl')}, {big('eq', 'equity')}, {big('bu', 'buffer')} FROM s2")
def component_projection(spark, sf):
    rows = positions(spark, sf).where("is_open").withColumns(evidence.component_projection(CNS_UNITS))
    return rows.select(*ident(), *[F.col(f"projected_{c}_cns").cast("long").alias(c) for c in ("funding", "pnl", "equity", "buffer")])


@query(
    "E4_risk_scorecard",
    q.with_book(*q.FULL_RISK, SCORE_SQL) + f"""SELECT {P}, field, CASE WHEN a IS NULL OR e IS NULL THEN 'unverified' WHEN a=e THEN 'matched' ELSE 'mismatch' END AS status FROM (
 SELECT account_id, perpetual_id, 'maintenance_cns' AS field, mt AS a, mt AS e FROM s2 UNION ALL SELECT account_id, perpetual_id, 'price_pnl_cns', pp, pp+CASE WHEN account_id%6=0 THEN 1 ELSE 0 END FROM s2
 UNION ALL SELECT account_id, perpetual_id, 'funding_cns', fu, fu FROM s2 UNION ALL SELECT account_id, perpetual_id, 'total_pnl_cns', tp, tp FROM s2
 UNION ALL SELECT account_id, perpetual_id, 'equity_cns', eq, eq FROM s2 UNION ALL SELECT account_id, perpetual_id, 'buffer_cns', bu, bu FROM s2 UNION ALL SELECT account_id, perpetual_id, 'liquidation_pns', lq, lq+CASE WHEN account_id%7=0 THEN 1 ELSE 0 END FROM s2)""",
)
def risk_scorecard(spark, sf):
    """A reference that differs in price profit for every sixth account and in the liquidation price for every seventh."""
    rows = positions(spark, sf)
    unit = F.lit(CNS_UNITS).cast("decimal(38,0)")
    reference = rows.where("is_open").withColumns(evidence.component_projection(CNS_UNITS)).select(
        *POSITION, trunc_div(F.col("maintenance_u"), unit).alias("maintenance_cns"),
        (trunc_div(F.col("price_pnl_u"), unit) + F.when(F.col("account_id") % 6 == 0, F.lit(1)).otherwise(F.lit(0))).alias("price_pnl_cns"),
        F.col("projected_funding_cns").alias("funding_cns"), F.col("projected_pnl_cns").alias("total_pnl_cns"),
        F.col("projected_equity_cns").alias("equity_cns"), F.col("projected_buffer_cns").alias("buffer_cns"),
        (evidence.liquidation_ticks() + F.when(F.col("account_id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))).alias("liquidation_pns"),
    )
    return evidence.risk_scorecard(rows, reference, CNS_UNITS).select(*ident(), "field", "status")


@query(
    "E5_market_scorecard",
    q.with_book(q.marks()) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, CAST({CUT.timestamp_ms}-mark_ms AS BIGINT) AS mark_age_ms, field, status FROM cmark, (SELECT unnest(['mark_pns','timestamp_ms']) AS field) f, LATERAL (SELECT CASE WHEN field='timestamp_ms' AND perpetual_id=2 THEN 'mismatch' ELSE 'matched' END AS status)",
)
def market_scorecard(spark, sf):
    marks = ledger.latest_marks(b.book(spark, sf), CUT)
    off = F.when(F.col("perpetual_id") == 2, 1000).otherwise(0)
    reference = marks.select("perpetual_id", "mark_pns", (F.col("timestamp_ms") + off).alias("timestamp_ms"))
    return evidence.market_scorecard(marks, reference, CUT).select(*longs("perpetual_id"), "mark_age_ms", "field", "status")


@query("M16_truncated_match", q.with_book(*q.FULL_RISK) + f"SELECT {P}, tot_u//{CNS_UNITS}=eq_u//{CNS_UNITS}-dep_u//{CNS_UNITS} AS same FROM risk WHERE is_open AND tot_u IS NOT NULL")
def truncated_match(spark, sf):
    """Total profit against equity less deposit, both truncated to collateral units."""
    rows = positions(spark, sf).where("is_open and total_pnl_u is not null")
    unit = F.lit(CNS_UNITS).cast("decimal(38,0)")
    rest = (trunc_div(F.col("equity_u"), unit) - trunc_div(F.col("deposit_u"), unit)) * unit
    return rows.select(*ident(), evidence.truncated_equal(F.col("total_pnl_u"), rest, unit).alias("same"))


@query("J12_market_semi", q.with_book(LEDGER) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, kind, count(*) AS inputs FROM book WHERE kind IN ('mark_updated','market_funding','funding_scale_updated') AND block_number<={BLOCK} AND perpetual_id IN (SELECT perpetual_id FROM st WHERE is_open) GROUP BY 1,2")
def market_semi(spark, sf):
    """Market inputs only for markets with an open position."""
    events = b.book(spark, sf)
    held = ledger.position_state(events, CUT).where("is_open").select("perpetual_id").distinct()
    inputs = events.where(kind_is("mark_updated", "market_funding", "funding_scale_updated") & CUT.includes())
    rows = inputs.join(held, "perpetual_id", "left_semi")
    return rows.groupBy(F.col("perpetual_id").cast("long").alias("perpetual_id"), "kind").agg(F.count(F.lit(1)).alias("inputs"))


@query("J13_unproven_market_anti", q.with_tape() + f"SELECT DISTINCT CAST(perpetual_id AS BIGINT) AS perpetual_id FROM tape WHERE block_number<={b.TAPE_CUT.block_number} AND perpetual_id NOT IN (SELECT DISTINCT perpetual_id FROM tape WHERE kind='position_opened' AND perpetual_id%3<>0)")
def unproven_market(spark, sf):
    """Proofs exist for the markets that opened positions, except every third."""
    events = b.tape(spark, sf)
    proofs = events.where(kind_is("position_opened") & (F.col("perpetual_id") % 3 != 0)).select("perpetual_id").distinct()
    return evidence.unproven_markets(events, proofs, b.TAPE_CUT).select(*longs("perpetual_id"))


@query("J11_registry_diff", q.with_tape() + ", seen AS (SELECT DISTINCT perpetual_id FROM tape WHERE perpetual_id IS NOT NULL AND perpetual_id<>4) SELECT CAST(mk.perpetual_id AS BIGINT) AS perpetual_id, CASE WHEN s.perpetual_id IS NULL THEN 'absent' WHEN mk.perpetual_id%3=0 THEN 'changed' ELSE 'same' END AS change FROM mk LEFT JOIN seen s USING (perpetual_id)")
def registry_diff(spark, sf):
    """Observed metadata of the traded markets, with another scale for every third and one market gone."""
    registered = b.REGISTRY.frame(spark)
    seen = b.tape(spark, sf).where("perpetual_id is not null and perpetual_id <> 4").select("perpetual_id").distinct()
    third = F.col("perpetual_id") % 3 == 0
    observed = registered.join(seen, "perpetual_id", "left_semi").withColumn(
        "price_decimals", F.when(third, F.col("price_decimals") + 1).otherwise(F.col("price_decimals"))
    )
    return evidence.registry_diff(registered, observed).select(*longs("perpetual_id"), "change")


