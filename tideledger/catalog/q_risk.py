"""Signals, stress and cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideledger.catalog import binding as b
from tideledger.catalog import sqlbook as q
from tideledger.catalog.common import CNS_UNITS, cns, eligibility, longs, plain_positions, positions, query, states
from tideledger.catalog.q_ledger import (
    ELIGIBLE_SQL,
    STATE,
    TOTALS_SQL,
    P,
    big,
    book_flows,
    ident,
    u,
)
from tideledger.functions.exact import trunc_div
from tideledger.operators import accounting, cohort, ledger, signals
from tideledger.operators.analytics import market_state
from tideledger.plans.kept import written

CUT, PREV = b.CUT, b.PREVIOUS


def eligible_sql(cut, tag):
    return ELIGIBLE_SQL.replace("elig AS", f"elig{tag} AS").replace(f"block_number<={CUT.block_number}", f"block_number<={cut.block_number}")


def signal_sql(cut, tag="") -> list[str]:
    """CTEs down to sig{tag}: the whole report at a cutoff."""
    state = STATE[-1] if not tag else STATE[-1].replace("ms AS", "ms_p AS").replace("ms2 AS", "ms2_p AS").replace("FROM ms)", "FROM ms_p)").replace("FROM risk", "FROM risk_p")

    def grade(v, levels, gte=True):
        op = ">=" if gte else "<="
        arms = " ".join(f"WHEN {v}{op}{lim} THEN '{name}'" for name, lim in levels)
        lims = " ".join(f"WHEN {v}{op}{lim} THEN {lim}" for name, lim in levels)
        watch = levels[-1][1]
        score = v if watch == 0 else (f"CAST(({v}-{watch})*1000000//{watch} AS BIGINT)" if gte else f"CAST(({watch}-{v})*1000000//{watch} AS BIGINT)")
        return f"CASE {arms} END AS severity, {v} AS metric_ppm, CASE {lims} END AS threshold_ppm, {score} AS score_ppm"

    mine = f"mine{tag} AS (SELECT r.*, CASE WHEN side=1 THEN 'long' ELSE 'short' END AS sn FROM risk{tag} r JOIN elig{tag} e USING (account_id) WHERE e.eligible)"
    met = f"""met{tag} AS (SELECT *, CASE WHEN is_open AND mark IS NOT NULL THEN CAST((CASE WHEN side=1 THEN mark_u-liq_u ELSE liq_u-mark_u END)*1000000//mark_u AS BIGINT) END AS dist,
  CASE WHEN is_open AND mark IS NOT NULL AND dep_u>0 AND pnl_u<0 THEN CAST((-pnl_u)*1000000//dep_u AS BIGINT) END AS dd,
  CASE WHEN is_open AND mark IS NOT NULL AND dep_u>0 THEN CAST((not_u*1000000//dep_u)*100//im AS BIGINT) END AS util FROM mine{tag})"""
    none = "CAST(NULL AS BIGINT)"
    sig = f"""sig0{tag} AS (
 SELECT 'position-liquidated' AS rule_id, 'activity' AS category, 'warning' AS severity, {none} AS metric_ppm, {none} AS threshold_ppm, 0 AS score_ppm, account_id, perpetual_id, last_event_id FROM met{tag} WHERE status IN ('liquidated','deleveraged') AND {cut.timestamp_ms}-last_event_ms<=86400000
 UNION ALL SELECT 'risk-input-unavailable','data-quality','warning',{none},{none},0,account_id,perpetual_id,last_event_id FROM met{tag} WHERE is_open AND mark IS NULL
 UNION ALL SELECT 'liquidation-distance','risk',severity,metric_ppm,threshold_ppm,score_ppm,account_id,perpetual_id,last_event_id FROM (SELECT *, {grade('dist', [('critical', 50000), ('warning', 150000), ('watch', 250000)], False)} FROM met{tag}) WHERE severity IS NOT NULL
 UNION ALL SELECT 'risk-input-unavailable','data-quality','watch',{none},{none},0,account_id,perpetual_id,last_event_id FROM met{tag} WHERE is_open AND mark IS NOT NULL AND uns IS NULL
 UNION ALL SELECT 'collateral-drawdown','risk',severity,metric_ppm,threshold_ppm,score_ppm,account_id,perpetual_id,last_event_id FROM (SELECT *, {grade('dd', [('critical', 750000), ('warning', 500000), ('watch', 250000)])} FROM met{tag}) WHERE severity IS NOT NULL
 UNION ALL SELECT 'leverage-utilization','risk',severity,metric_ppm,threshold_ppm,score_ppm,account_id,perpetual_id,last_event_id FROM (SELECT *, {grade('util', [('critical', 1000000), ('warning', 800000), ('watch', 500000)])} FROM met{tag}) WHERE severity IS NOT NULL
 UNION ALL SELECT 'incomplete-history','data-quality','warning',{none},{none},0,account_id,NULL,NULL FROM elig{tag} WHERE NOT eligible
 UNION ALL SELECT 'market-skew','concentration',severity,metric_ppm,threshold_ppm,score_ppm,NULL,perpetual_id,NULL FROM (SELECT *, {grade('sk', [('warning', 750000), ('watch', 500000)])} FROM (SELECT *, CAST(abs(skew) AS BIGINT) AS sk FROM ms2{tag} WHERE skew IS NOT NULL)) WHERE severity IS NOT NULL
 UNION ALL SELECT 'liquidation-activity','activity',COALESCE(severity,'watch'),metric_ppm,COALESCE(threshold_ppm,0),COALESCE(score_ppm,0),NULL,perpetual_id,NULL FROM (SELECT *, {grade('act', [('critical', 200000), ('warning', 50000), ('watch', 0)])} FROM act{tag})),
sig{tag} AS MATERIALIZED (SELECT *, rule_id||':'||COALESCE(CAST(account_id AS VARCHAR),'-')||':'||COALESCE(CAST(perpetual_id AS VARCHAR),'-') AS signal_id,
  CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS srank, CASE category WHEN 'risk' THEN 4 WHEN 'activity' THEN 3 WHEN 'concentration' THEN 2 ELSE 1 END AS crank FROM sig0{tag})"""
    act = f"""act{tag} AS (SELECT f.perpetual_id, f.liquidations, f.ln, m.oi_u, CASE WHEN m.oi_u<>0 THEN CAST(f.ln*1000000//m.oi_u AS BIGINT) END AS act FROM
  (SELECT perpetual_id, count(*) AS liquidations, SUM(CAST(liq_price_pns AS HUGEINT)*liq_lot_lns*65536*CAST(10**(14-price_decimals-size_decimals) AS HUGEINT)) AS ln FROM book JOIN mk USING (perpetual_id)
   WHERE kind='position_liquidated' AND listed AND block_number<={cut.block_number} AND timestamp_ms>={cut.timestamp_ms - 86400000} GROUP BY 1) f LEFT JOIN ms2{tag} m USING (perpetual_id))"""
    return [q.ledger(cut, tag), q.marks(cut, tag), q.funding(cut, tag), q.risk(cut, tag), eligible_sql(cut, tag), state, act, mine, met, sig]


REPORT = signal_sql(CUT)
REPORT_PREV = signal_sql(PREV, "_p")
ORDER_SQL = "srank DESC, crank DESC, score_ppm DESC, signal_id"


def report(spark, sf, cut=CUT):
    """The whole report; what several of its rules read is written once."""
    rows = written(positions(spark, sf, cut), "positions")
    markets = written(market_state(rows), "markets")
    return signals.signal_report(rows, written(eligibility(spark, sf, cut), "accounts"), markets, day_flows(spark, sf, cut), cut)


def day_flows(spark, sf, cut=CUT):
    return book_flows(spark, sf, cut)[1].where("window = '24h'")


def rule_query(name, rule_id):
    sql = q.with_book(*REPORT) + f"SELECT signal_id, severity, metric_ppm, threshold_ppm, CAST(score_ppm AS BIGINT) AS score_ppm FROM sig WHERE rule_id='{rule_id}'"

    @query(name, sql)
    def one_rule(spark, sf):
        mine = positions(spark, sf)
        rows = signals.signal_report(mine, eligibility(spark, sf), market_state(mine), day_flows(spark, sf), CUT, rules=(rule_id,))
        return rows.select("signal_id", "severity", "metric_ppm", "threshold_ppm", "score_ppm")

    return one_rule


for _name, _rule in [
    ("G1_liquidation_distance", "liquidation-distance"), ("G2_collateral_drawdown", "collateral-drawdown"),
    ("G3_leverage_utilization", "leverage-utilization"), ("G5_market_skew", "market-skew"),
    ("G6_liquidation_activity", "liquidation-activity"), ("G7_position_liquidated", "position-liquidated"),
    ("G8_risk_input_unavailable", "risk-input-unavailable"), ("G9_incomplete_history", "incomplete-history"),
]:
    rule_query(_name, _rule)


@query("G10_signal_report", q.with_book(*REPORT) + "SELECT signal_id, rule_id, category, severity, metric_ppm, threshold_ppm, CAST(score_ppm AS BIGINT) AS score_ppm, last_event_id FROM sig")
def signal_report(spark, sf):
    return report(spark, sf).select("signal_id", "rule_id", "category", "severity", "metric_ppm", "threshold_ppm", "score_ppm", "last_event_id")


@query("F16_signal_query", q.with_book(*REPORT) + "SELECT signal_id, severity FROM sig WHERE srank>=2 AND category='risk'")
def signal_query(spark, sf):
    return signals.filter_signals(report(spark, sf), "warning", "risk").select("signal_id", "severity")


@query("A11_severity_counts", q.with_book(*REPORT) + "SELECT severity, count(signal_id) AS signals FROM (SELECT unnest(['critical','warning','watch']) AS severity) LEFT JOIN sig USING (severity) GROUP BY 1")
def severity_counts(spark, sf):
    return signals.severity_counts(report(spark, sf))


@query("O2_rank_signals", q.with_book(*REPORT) + f"SELECT signal_id, row_number() OVER (ORDER BY {ORDER_SQL}) AS place FROM sig")
def rank_signals(spark, sf):
    return signals.ranked_signals(report(spark, sf)).select("signal_id", *longs("place"))


@query(
    "M15_grade",
    q.with_book(*REPORT) + "SELECT rule_id, severity, count(*) AS signals, min(metric_ppm) AS lowest, max(metric_ppm) AS highest, CAST(max(score_ppm) AS BIGINT) AS top_score FROM sig WHERE metric_ppm IS NOT NULL GROUP BY 1,2",
)
def grades(spark, sf):
    rows = report(spark, sf).where("metric_ppm is not null")
    return rows.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("signals"), F.min("metric_ppm").alias("lowest"), F.max("metric_ppm").alias("highest"),
        F.max("score_ppm").alias("top_score"),
    )


@query("O3_top_signals", q.with_book(*REPORT) + f"SELECT signal_id, severity FROM sig ORDER BY {ORDER_SQL} LIMIT 3")
def top_signals(spark, sf):
    return signals.top_signals(report(spark, sf)).select("signal_id", "severity")


@query("J5_position_x_close_time", q.with_book(q.ledger()) + f"SELECT {P}, status, last_event_id, last_event_ms AS closed_at_ms FROM st WHERE status IN ('liquidated','deleveraged')")
def close_time(spark, sf):
    """Liquidated positions joined to the event that closed them."""
    events = b.book(spark, sf)
    ended = ledger.position_state(events, CUT).where("status in ('liquidated', 'deleveraged')")
    times = events.select(F.col("event_id").alias("last_event_id"), F.col("timestamp_ms").alias("closed_at_ms"))
    return ended.join(times, "last_event_id", "left").select(*ident(), "status", "last_event_id", "closed_at_ms")


@query("J6_flow_x_open_interest", q.with_book(*REPORT[:7]) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, liquidations, CAST(ln//{CNS_UNITS} AS BIGINT) AS liquidation_notional, CAST(oi_u//{CNS_UNITS} AS BIGINT) AS open_interest, act AS activity_ppm FROM act")
def flow_x_open_interest(spark, sf):
    _, markets = book_flows(spark, sf)
    rows = signals.liquidation_activity(markets.where("window = '24h'"), states(spark, sf))
    return rows.select(
        *longs("perpetual_id", "liquidations"), cns("liquidation_notional_u").alias("liquidation_notional"),
        cns("open_interest_u").alias("open_interest"), "activity_ppm",
    )


SHOCKED_SQL = "s AS shock_percent, (dep_u+COALESCE(uns,0))*100 + (mark*65536*(100+s)-eq16*100)*lot*sg*f AS eqh"
SHOCKS_SQL = "(SELECT unnest([-20,-10,-5,5,10,20]) AS s)"
STRESS_SQL = f"""shk AS (SELECT r.*, {SHOCKED_SQL} FROM risk r JOIN elig e USING (account_id), {SHOCKS_SQL} WHERE e.eligible AND is_open AND mark IS NOT NULL)"""
EVERY_STRESS_SQL = f"""shk AS (SELECT r.*, COALESCE(e.eligible,false) AS eligible, {SHOCKED_SQL} FROM risk r LEFT JOIN elig e USING (account_id), {SHOCKS_SQL} WHERE is_open AND mark IS NOT NULL)"""


def stressed(spark, sf):
    """Positions of the wallets that can be replayed."""
    good = eligibility(spark, sf).where("eligible").select("account_id")
    return positions(spark, sf).join(good, "account_id", "left_semi")


@query("J7_position_x_shock", q.with_book(*q.FULL_RISK, ELIGIBLE_SQL, EVERY_STRESS_SQL) + f"SELECT {P}, CAST(shock_percent AS BIGINT) AS shock_percent, eqh<=maint_u*100 AS breached, CAST(eqh//{CNS_UNITS * 100} AS BIGINT) AS equity, eligible FROM shk")
def position_x_shock(spark, sf):
    """Every open priced position; the stress report counts those of ``eligible`` wallets."""
    accounts = eligibility(spark, sf).select("account_id", "eligible")
    rows = signals.stress_positions(positions(spark, sf).join(accounts, "account_id", "left"))
    return rows.select(
        *ident(), *longs("shock_percent"), "breached", trunc_div(F.col("equity_hundredths_u"), CNS_UNITS * 100).cast("long").alias("equity"),
        F.coalesce("eligible", F.lit(False)).alias("eligible"),
    )


@query("G11_stress_report", q.with_book(*q.FULL_RISK, ELIGIBLE_SQL, STRESS_SQL) + f"SELECT CAST(shock_percent AS BIGINT) AS shock_percent, count(*) AS positions_evaluated, count(*) FILTER (WHERE eqh<=maint_u*100) AS breached, CAST(COALESCE(SUM(CASE WHEN eqh<=maint_u*100 THEN dep_u END),0)//{CNS_UNITS} AS BIGINT) AS breached_collateral, count(*) FILTER (WHERE eqh<=maint_u*100 AND uns IS NULL) AS conditional_breaches FROM shk GROUP BY 1")
def stress_report(spark, sf):
    rows = signals.stress_report(stressed(spark, sf))
    return rows.select(
        *longs("shock_percent"), "positions_evaluated", "breached", cns("breached_collateral_u").alias("breached_collateral"), "conditional_breaches"
    )


@query(
    "G11_stress_excluded",
    q.with_book(*q.FULL_RISK, ELIGIBLE_SQL)
    + """SELECT account_id, CAST(NULL AS BIGINT) AS perpetual_id, 'incomplete-history' AS reason FROM elig WHERE NOT eligible
UNION ALL SELECT r.account_id, CAST(r.perpetual_id AS BIGINT), 'mark-unavailable' FROM risk r JOIN elig e USING (account_id) WHERE e.eligible AND r.is_open AND r.mark IS NULL""",
)
def stress_excluded(spark, sf):
    """Accounts and positions that the stress run leaves out."""
    return signals.stress_excluded(positions(spark, sf), eligibility(spark, sf)).select(*ident(), "reason")


CROWD_SQL = """cr AS (SELECT perpetual_id, symbol, COALESCE(SUM(CASE WHEN side=1 THEN not_u END),0) AS lo, COALESCE(SUM(CASE WHEN side<>1 THEN not_u END),0) AS sh, count(DISTINCT account_id) AS accounts FROM risk WHERE is_open AND not_u IS NOT NULL GROUP BY 1,2),
cr2 AS (SELECT *, CASE WHEN lo>=sh THEN 'long' ELSE 'short' END AS side, CAST(greatest(lo,sh)*1000000//(lo+sh) AS BIGINT) AS share_ppm FROM cr WHERE accounts>=2)"""
PLAIN = [q.ledger(), q.marks(), q.risk(funded=False)]


@query("A12_crowding", q.with_book(*PLAIN, CROWD_SQL) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, side, {u('lo', 'long_notional')}, {u('sh', 'short_notional')}, accounts, share_ppm FROM cr2")
def crowding(spark, sf):
    rows = signals.market_crowds(plain_positions(spark, sf))
    return rows.select(*longs("perpetual_id"), "side", cns("long_u").alias("long_notional"), cns("short_u").alias("short_notional"), "accounts", "share_ppm")


def _crowded(scope: str, source: str) -> str:
    parts = CROWD_SQL.replace("FROM risk", f"FROM {source}").replace("cr AS", f"cr_{scope} AS").replace("cr2 AS", f"cr2_{scope} AS").replace("FROM cr ", f"FROM cr_{scope} ")
    return parts


def _crowd_rows(scope: str) -> str:
    return f"SELECT '{scope}' AS scope, CAST(perpetual_id AS BIGINT) AS perpetual_id, side, CASE WHEN share_ppm>=900000 THEN 'warning' ELSE 'watch' END AS severity, share_ppm AS metric_ppm FROM cr2_{scope} WHERE share_ppm>=750000"


WATCHED = "account_id % 17 = 3"


@query(
    "G4_watchlist_crowding",
    q.with_book(*PLAIN, _crowded("everyone", "risk"), _crowded("watched", f"(SELECT * FROM risk WHERE {WATCHED})")) + _crowd_rows("everyone") + " UNION ALL " + _crowd_rows("watched"),
)
def watchlist_crowding(spark, sf):
    """All positions, and those of a list of accounts as its own scope."""
    rows = plain_positions(spark, sf)
    parts = [
        signals.crowding_signals(held).select(F.lit(scope).alias("scope"), *longs("perpetual_id"), "side", "severity", "metric_ppm")
        for scope, held in (("everyone", rows), ("watched", rows.where(WATCHED)))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "J9_signal_diff",
    q.with_book(*REPORT, *REPORT_PREV) + "SELECT COALESCE(c.signal_id,p.signal_id) AS signal_id, CASE WHEN c.signal_id IS NULL THEN 'resolved' WHEN p.signal_id IS NULL THEN 'new' WHEN c.srank=p.srank THEN 'unchanged' WHEN c.srank>p.srank THEN 'escalated' ELSE 'de-escalated' END AS change FROM sig c FULL JOIN sig_p p ON c.signal_id=p.signal_id",
)
def signal_diff(spark, sf):
    now, then = report(spark, sf), report(spark, sf, PREV)
    changes = signals.compare_signals(then, now).select("signal_id", "change")
    gone = signals.resolved_signals(then, None, now, CUT).select("signal_id", F.lit("resolved").alias("change"))
    return changes.unionByName(gone)


@query(
    "G12_signal_transitions",
    q.with_book(*REPORT, *REPORT_PREV) + f"SELECT c.signal_id, CASE WHEN p.signal_id IS NULL THEN 'new' WHEN c.srank=p.srank THEN 'unchanged' WHEN c.srank>p.srank THEN 'escalated' ELSE 'de-escalated' END AS change, CAST(CASE WHEN p.signal_id IS NULL THEN {CUT.block_number} ELSE {PREV.block_number} END AS BIGINT) AS first_observed_block, CAST(CASE WHEN c.srank=p.srank THEN {PREV.block_number} ELSE {CUT.block_number} END AS BIGINT) AS severity_since_block FROM sig c LEFT JOIN sig_p p ON c.signal_id=p.signal_id",
)
def signal_transitions(spark, sf):
    now, _ = signals.carry_forward(report(spark, sf, PREV), PREV.block_number, None, report(spark, sf), CUT)
    return now.select("signal_id", "change", "first_observed_block", "severity_since_block")


@query("U2_resolved_union", q.with_book(*REPORT, *REPORT_PREV) + f"SELECT p.signal_id, p.severity AS last_severity, CAST({CUT.block_number} AS BIGINT) AS resolved_block FROM sig_p p WHERE p.signal_id NOT IN (SELECT signal_id FROM sig) UNION ALL SELECT signal_id||'-old', severity, {CUT.block_number - 900} FROM sig WHERE rule_id='collateral-drawdown'")
def resolved_union(spark, sf):
    """Freshly resolved signals and earlier ones, of which only the recent are kept."""
    now, then = report(spark, sf), report(spark, sf, PREV)
    base = now.where("rule_id = 'collateral-drawdown'").select(
        F.concat("signal_id", F.lit("-old")).alias("signal_id"), "rule_id", F.col("severity").alias("last_severity"), "title",
        "first_observed_block", F.lit(CUT.block_number - 900).cast("long").alias("resolved_block"),
    )
    expired = base.withColumns({"signal_id": F.concat("signal_id", F.lit("er")), "resolved_block": F.lit(CUT.block_number - 1001).cast("long")})
    rows = signals.resolved_signals(then, base.unionByName(expired), now, CUT)
    return rows.select("signal_id", "last_severity", "resolved_block")


@query("O4_resolved_cap", q.with_book(*REPORT, *REPORT_PREV) + f"SELECT p.signal_id, CAST({CUT.block_number} AS BIGINT) AS resolved_block FROM sig_p p WHERE p.signal_id NOT IN (SELECT signal_id FROM sig) ORDER BY 1 LIMIT 50")
def resolved_cap(spark, sf):
    rows = signals.resolved_signals(report(spark, sf, PREV), None, report(spark, sf), CUT)
    return signals.listed_resolved(rows).select("signal_id", "resolved_block")


POSITION_RULES = "('position-liquidated','risk-input-unavailable','liquidation-distance','collateral-drawdown','leverage-utilization')"


@query(
    "J15_signal_x_evidence",
    q.with_book(*REPORT)
    + f"""SELECT s.signal_id, 'last' AS role, e.event_id, e.block_number, e.abi_event_name, s.rule_id FROM sig s JOIN book e ON e.event_id=s.last_event_id
UNION ALL SELECT s.signal_id, 'reset', e.event_id, e.block_number, e.abi_event_name, s.rule_id FROM sig s JOIN risk r USING (account_id, perpetual_id) JOIN book e ON e.event_id=r.reset_event_id WHERE s.rule_id IN {POSITION_RULES}""",
)
def signal_x_evidence(spark, sf):
    """Evidence in every role; the supplied marks of the book come from no event, so none is a mark's."""
    rows = signals.signal_evidence(report(spark, sf), b.book(spark, sf))
    return rows.select("signal_id", "role", "event_id", "block_number", "abi_event_name", "rule_id")


# ---- cohort -------------------------------------------------------------

COHORT = [*q.FULL_RISK, TOTALS_SQL, ELIGIBLE_SQL, """cs AS (SELECT w.account_id, w.pnl, w.fees, w.pnl_u, COALESCE(o.n,0) AS open_positions, COALESCE(o.c,0) AS closed_positions,
  CASE WHEN o.n IS NULL THEN 0 ELSE o.not_u END AS not_u, COALESCE(o.dep_u,0) AS dep_u FROM wal w JOIN elig e ON e.account_id=w.account_id AND e.eligible
  LEFT JOIN (SELECT account_id, count(*) FILTER (WHERE is_open) AS n, count(*) FILTER (WHERE status<>'open') AS c, CASE WHEN count(*) FILTER (WHERE is_open)=count(not_u) FILTER (WHERE is_open) THEN COALESCE(SUM(not_u) FILTER (WHERE is_open),0) END AS not_u, SUM(dep_u) FILTER (WHERE is_open) AS dep_u FROM risk GROUP BY 1) o ON o.account_id=w.account_id),
cs2 AS (SELECT *, CASE WHEN dep_u<>0 THEN CAST(not_u*1000000//dep_u AS BIGINT) END AS lev, CASE WHEN open_positions>0 AND dep_u<>0 THEN CAST(pnl_u*1000000//dep_u AS BIGINT) END AS ret FROM cs)"""]  # fmt: skip


def stats(spark, sf):
    rows = positions(spark, sf)
    wallets = accounting.wallets(b.book(spark, sf), rows, b.REGISTRY, CUT)
    return cohort.wallet_stats(wallets, eligibility(spark, sf))


@query("C1_wallet_stats", q.with_book(*COHORT) + f"SELECT account_id, open_positions, closed_positions, {u('not_u', 'open_notional')}, {u('dep_u', 'open_collateral')}, lev AS leverage_ppm, ret AS price_return_ppm, {big('fees', 'fees')} FROM cs2")
def wallet_stats(spark, sf):
    return stats(spark, sf).select(
        "account_id", *longs("open_positions", "closed_positions"), cns("open_notional_u").alias("open_notional"),
        cns("open_collateral_u").alias("open_collateral"), "leverage_ppm", "price_return_ppm", cns("fees_u").alias("fees"),
    )


RANK_SQL = """sr AS (SELECT account_id, 'realized_pnl' AS statistic, CAST(pnl AS HUGEINT) AS value FROM cs2 UNION ALL SELECT account_id, 'price_pnl', pnl_u FROM cs2 UNION ALL SELECT account_id, 'price_return', ret FROM cs2
 UNION ALL SELECT account_id, 'open_notional', not_u FROM cs2 UNION ALL SELECT account_id, 'leverage', lev FROM cs2 UNION ALL SELECT account_id, 'fees', fees FROM cs2),
sk AS (SELECT *, rank() OVER (PARTITION BY statistic ORDER BY value)-1 AS below, count(*) OVER (PARTITION BY statistic, value) AS same, count(*) OVER (PARTITION BY statistic) AS n FROM sr WHERE value IS NOT NULL)
SELECT sr.account_id, sr.statistic, CAST(((2*sk.below+sk.same)*10000)//(2*sk.n) AS BIGINT) AS percentile_hundredths FROM sr LEFT JOIN sk ON sk.account_id=sr.account_id AND sk.statistic=sr.statistic"""


@query("C2_wallet_percentiles", q.with_book(*COHORT) .rstrip() + "," + RANK_SQL)
def wallet_percentiles(spark, sf):
    rows = cohort.midrank_percentiles(cohort.statistic_rows(written(stats(spark, sf), "statistics")))
    return rows.select("account_id", "statistic", "percentile_hundredths")


@query(
    "W9_midrank_percentile",
    q.with_tape() + """, v AS (SELECT account_id, CAST(sum(lot_lns) AS BIGINT) AS value FROM tape WHERE kind='maker_fill' GROUP BY 1),
k AS (SELECT *, rank() OVER (ORDER BY value)-1 AS below, count(*) OVER (PARTITION BY value) AS same, count(*) OVER () AS n FROM v)
SELECT account_id, value, CAST(((2*below+same)*10000)//(2*n) AS BIGINT) AS percentile_hundredths FROM k""",
)
def midrank(spark, sf):
    """Percentile of each account's filled lots on the whole tape."""
    sums = b.tape(spark, sf).where("kind = 'maker_fill'").groupBy("account_id").agg(F.sum("lot_lns").alias("value"))
    rows = sums.select("account_id", F.lit("lots").alias("statistic"), F.col("value").cast("decimal(38,0)").alias("value"))
    return cohort.midrank_percentiles(rows).select("account_id", *longs("value"), "percentile_hundredths")


HELD_SQL = """hp AS (SELECT r.account_id, r.perpetual_id, r.side FROM risk r JOIN elig e USING (account_id) WHERE e.eligible AND r.is_open),
hz AS (SELECT account_id, count(*) AS n, string_agg(perpetual_id||CASE WHEN side=1 THEN 'l' ELSE 's' END, ',' ORDER BY perpetual_id) AS book FROM hp GROUP BY 1),
sh AS (SELECT a.account_id AS a, b.account_id AS b, count(*) AS shared, count(*) FILTER (WHERE a.side=b.side) AS same FROM hp a JOIN hp b ON a.perpetual_id=b.perpetual_id AND a.account_id<b.account_id GROUP BY 1,2),
pr AS (SELECT a.account_id AS a, b.account_id AS b, a.book AS ba, b.book AS bb, a.n AS na, b.n AS nb, COALESCE(s.shared,0) AS shared, COALESCE(s.same,0) AS same FROM hz a JOIN hz b ON a.account_id<b.account_id LEFT JOIN sh s ON s.a=a.account_id AND s.b=b.account_id)"""


def held(spark, sf, cut=CUT):
    return cohort.exposures(plain_positions(spark, sf, cut), eligibility(spark, sf, cut))


@query(
    "C3_exposure_overlap",
    q.with_book(*PLAIN, ELIGIBLE_SQL, HELD_SQL) + "SELECT shared AS shared_markets, na+nb-shared AS union_markets, same AS same_side_markets, shared-same AS opposing_markets, CAST(shared*1000000//(na+nb-shared) AS BIGINT) AS jaccard_ppm, count(*) AS wallet_pairs FROM pr GROUP BY 1,2,3,4,5",
)
def exposure_overlap(spark, sf):
    """All wallet pairs, counted by overlap shape; the check lists every pair."""
    rows = cohort.overlap_profile(held(spark, sf))
    return rows.select(*longs("shared_markets", "union_markets", "same_side_markets", "opposing_markets", "jaccard_ppm", "wallet_pairs"))


@query(
    "J8_wallet_pairs",
    q.with_book(*PLAIN, ELIGIBLE_SQL, HELD_SQL) + "SELECT least(ba,bb) AS book_a, greatest(ba,bb) AS book_b, max(shared) AS shared_markets, max(na+nb-shared) AS union_markets, count(*) AS wallet_pairs FROM pr WHERE shared>0 GROUP BY 1,2",
)
def wallet_pairs(spark, sf):
    rows = cohort.book_pairs(cohort.books(held(spark, sf)))
    return rows.select("book_a", "book_b", *longs("shared_markets", "union_markets", "wallet_pairs"))


@query(
    "J8_watchlist_overlap",
    q.with_book(*PLAIN, ELIGIBLE_SQL, HELD_SQL) + """, wl AS (SELECT * FROM hz WHERE account_id%20=0),
wp AS (SELECT w.account_id AS a, o.account_id AS b, w.n AS na, o.n AS nb, (SELECT count(*) FROM hp x JOIN hp y ON x.perpetual_id=y.perpetual_id WHERE x.account_id=w.account_id AND y.account_id=o.account_id) AS shared,
  (SELECT count(*) FROM hp x JOIN hp y ON x.perpetual_id=y.perpetual_id AND x.side=y.side WHERE x.account_id=w.account_id AND y.account_id=o.account_id) AS same FROM wl w JOIN hz o ON o.account_id<>w.account_id)
SELECT a AS account_a, b AS account_b, shared AS shared_markets, na+nb-shared AS union_markets, same AS same_side_markets, shared-same AS opposing_markets, CAST(shared*1000000//(na+nb-shared) AS BIGINT) AS jaccard_ppm FROM wp""",
)
def watchlist_overlap(spark, sf):
    """Every twentieth account as a watchlist against all wallets."""
    # The list, its blocks and the wallets read the masks: the ledger runs once.
    masks = written(cohort.exposure_masks(held(spark, sf), b.REGISTRY), "masks")
    rows = cohort.watchlist_overlap(masks, masks.where("account_id % 20 = 0"))
    return rows.select("account_a", "account_b", *longs("shared_markets", "union_markets", "same_side_markets", "opposing_markets", "jaccard_ppm"))


@query(
    "U3_market_union",
    q.with_book(*PLAIN, q.ledger(PREV, "_p"), eligible_sql(CUT, ""), eligible_sql(PREV, "_p"))
    + """, a AS (SELECT s.account_id, s.perpetual_id FROM st_p s JOIN elig_p e USING (account_id) WHERE e.eligible AND s.is_open), c AS (SELECT s.account_id, s.perpetual_id FROM st s JOIN elig e USING (account_id) WHERE e.eligible AND s.is_open),
t AS (SELECT COALESCE(a.account_id,c.account_id) AS account_id, a.perpetual_id AS x, c.perpetual_id AS y FROM a FULL JOIN c ON a.account_id=c.account_id AND a.perpetual_id=c.perpetual_id)
SELECT account_id, count(*) AS union_markets, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS shared_markets FROM t GROUP BY 1""",
)
def market_union(spark, sf):
    rows = cohort.market_sets(held(spark, sf, PREV), held(spark, sf))
    return rows.select("account_id", *longs("union_markets", "shared_markets"))


@query("C4_cohort_excluded", q.with_book(ELIGIBLE_SQL) + "SELECT account_id, 'incomplete-history' AS reason, basis FROM elig WHERE NOT eligible")
def excluded(spark, sf):
    return cohort.excluded_wallets(eligibility(spark, sf))

