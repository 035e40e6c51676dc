"""Scans, filters, checks, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideledger.catalog import binding as b
from tideledger.catalog import sqlbook as q
from tideledger.catalog.common import CNS_UNITS, cns, longs, query
from tideledger.functions.exact import percent_text, ratio_ppm, trunc_div, units_from_native
from tideledger.functions.keys import digest_json, event_key, position_key
from tideledger.operators import accounting, analytics, checks, evidence, ledger
from tideledger.operators.ledger import kind_is
from tideledger.params import AsOf
from tideledger.plans import scans

BLOCK = b.CUT.block_number
LOG_CUT = AsOf(b.CHAIN, b.BASE_BLOCK + 15 * b.DAY_BLOCKS, "0x", b.CUT.timestamp_ms, 7)
CURSOR = (b.BASE_BLOCK + 10 * b.DAY_BLOCKS, 4)
SEQ = "(block_number*2147483648+log_index)"


@query("S6_scan_ordered", q.with_tape() + f"SELECT event_id, kind, block_number, log_index FROM tape WHERE block_number<={b.TAPE_CUT.block_number}")
def scan_ordered(spark, sf):
    rows = scans.scan_ordered(b.tape(spark, sf), b.TAPE_CUT)
    return rows.select("event_id", "kind", "block_number", *longs("log_index"))


@query(
    "S7_event_by_id",
    q.with_book(f"top AS (SELECT * FROM book WHERE block_number<={BLOCK} ORDER BY block_number DESC, log_index DESC LIMIT 1)")
    + "SELECT 'kept' AS point, event_id, block_number, true AS unchanged FROM top UNION ALL SELECT 'moved', event_id, block_number, false FROM top UNION ALL SELECT 'gone', event_id||'-gone', CAST(NULL AS BIGINT), false FROM top",
)
def event_by_id(spark, sf):
    """Three remembered points: one still there, one with another time, one that is no longer there."""
    events = b.book(spark, sf)
    point = ledger.latest_event(events, b.CUT)
    points = {
        "kept": point, "moved": point.withColumn("timestamp_ms", F.col("timestamp_ms") + 1),
        "gone": point.withColumn("event_id", F.concat("event_id", F.lit("-gone"))),
    }
    parts = [scans.verify_point(events, p).select(F.lit(n).alias("point"), "event_id", "block_number", F.coalesce("unchanged", F.lit(False)).alias("unchanged")) for n, p in points.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "S8_scan_range",
    q.with_book() + f"SELECT event_id, kind, block_number, CAST(log_index AS BIGINT) AS log_index FROM book WHERE (block_number,log_index) > ({CURSOR[0]},{CURSOR[1]}) AND block_number<={BLOCK}",
)
def scan_range(spark, sf):
    return scans.scan_range(b.book(spark, sf), CURSOR, b.CUT).select("event_id", "kind", "block_number", *longs("log_index"))


@query(
    "S9_scan_account",
    q.with_book() + f"SELECT account_id, event_id, kind, block_number FROM book WHERE block_number BETWEEN {b.BASE_BLOCK} AND {BLOCK} AND account_id IN (SELECT account_id FROM book WHERE kind='account_created')",
)
def scan_account(spark, sf):
    events = b.book(spark, sf)
    wanted = events.where(kind_is("account_created")).select("account_id")
    return scans.scan_accounts(events, wanted, b.BOUNDED, b.CUT).select("account_id", "event_id", "kind", "block_number")


@query(
    "S10_scan_market_inputs",
    q.with_book(q.marks()) + f"""
SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, 'mark' AS role, mark_event_id AS event_id FROM cmark
UNION ALL SELECT CAST(perpetual_id AS BIGINT), CASE WHEN kind='market_funding' THEN 'funding' ELSE 'scale' END, event_id FROM book
  WHERE kind IN ('market_funding','funding_scale_updated') AND block_number<={BLOCK}
UNION ALL SELECT CAST(perpetual_id AS BIGINT), 'missing', NULL FROM mk WHERE listed AND perpetual_id NOT IN (SELECT perpetual_id FROM cmark)""",
)
def scan_market_inputs(spark, sf):
    wanted = b.REGISTRY.listed(spark).select("perpetual_id")
    return scans.market_inputs(b.book(spark, sf), wanted, b.CUT).select(*longs("perpetual_id"), "role", "event_id")


@query(
    "S11_coverage_probe",
    q.with_book() + f"SELECT count(*) AS events, min(block_number) AS first_block, max(block_number) AS last_block, arg_max(event_id, {SEQ}) AS latest_event_id, min(block_number)>={b.DEPLOYED} AND max(block_number)<={BLOCK} AS in_range FROM book WHERE block_number<={BLOCK}",
)
def coverage_probe(spark, sf):
    return scans.coverage_probe(b.book(spark, sf), b.FULL, b.CUT).select("events", "first_block", "last_block", "latest_event_id", "in_range")


@query(
    "F1_as_of_filter",
    q.with_book() + f"SELECT kind, count(*) AS events, max(block_number) AS last_block FROM book WHERE block_number<{LOG_CUT.block_number} OR (block_number={LOG_CUT.block_number} AND log_index<=7) GROUP BY 1",
)
def as_of_filter(spark, sf):
    return b.book(spark, sf).where(LOG_CUT.includes()).groupBy("kind").agg(
        F.count(F.lit(1)).alias("events"), F.max("block_number").alias("last_block")
    )


@query(
    "F3_validate_events",
    q.with_tape() + """, bad AS (SELECT kind, event_id, unnest(list_filter([
  CASE WHEN kind IN ('maker_fill','position_opened') AND (lot_lns IS NULL OR log_index%5=0) THEN 'missing_lot_lns' END,
  CASE WHEN log_index%7=0 THEN 'bad_residue' END,
  CASE WHEN log_index%11=0 THEN 'blank_contract' END,
  CASE WHEN kind='position_liquidated' THEN 'missing_position_type' END], lambda x: x IS NOT NULL)) AS violation FROM tape)
SELECT kind, violation, count(*) AS events FROM bad GROUP BY 1,2""",
)
def validate_events(spark, sf):
    """The tape with three injected faults."""
    log = F.col("log_index")
    broken = b.tape(spark, sf).withColumns(
        {
            "lot_lns": F.when(log % 5 != 0, F.col("lot_lns")),
            "price_residue_pnsq16": F.when(log % 7 == 0, F.lit(70_000)),
            "contract_address": F.when(log % 11 == 0, F.lit(" ")).otherwise(F.col("contract_address")),
        }
    )
    return checks.validate_events(broken).groupBy("kind", "violation").agg(F.count(F.lit(1)).alias("events"))


@query(
    "F8_require_listed_market",
    q.with_tape() + "SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, kind, count(*) AS events FROM tape WHERE perpetual_id IS NOT NULL AND perpetual_id NOT IN (SELECT perpetual_id FROM mk WHERE listed) GROUP BY 1,2",
)
def require_listed(spark, sf):
    rows = checks.unlisted_market_events(b.tape(spark, sf), b.REGISTRY)
    return rows.groupBy(F.col("perpetual_id").cast("long").alias("perpetual_id"), "kind").agg(F.count(F.lit(1)).alias("events"))


#: The tape and, of some of its rows, a copy with one fault each.
FAULTS = ["same", "place", "hash", "chain", "contract", "early", "late"]
FAULTY = f"""line AS (SELECT *, log_index//10 AS part FROM tape),
faulty AS (SELECT block_number, log_index, event_id, block_hash, 'none' AS fault FROM line
  UNION ALL SELECT block_number, log_index, event_id, block_hash, 'same' FROM line WHERE part%101=0
  UNION ALL SELECT block_number, log_index, '{b.CHAIN}:'||block_hash||':'||tx_hash||'x:'||log_index, block_hash, 'place' FROM line WHERE part%103=0
  UNION ALL SELECT block_number, log_index+5000000, '{b.CHAIN}:0xfork:'||tx_hash||':'||(log_index+5000000), '0xfork', 'hash' FROM line WHERE part%107=0
  UNION ALL SELECT block_number, log_index+6000000, '1:'||block_hash||':'||tx_hash||':'||(log_index+6000000), block_hash, 'chain' FROM line WHERE part%109=0
  UNION ALL SELECT block_number, log_index+7000000, '{b.CHAIN}:'||block_hash||':'||tx_hash||':'||(log_index+7000000), block_hash, 'contract' FROM line WHERE part%113=0
  UNION ALL SELECT {b.DEPLOYED - 1}, log_index, '{b.CHAIN}:0xb{b.DEPLOYED - 1}:'||tx_hash||'e:'||log_index, '0xb{b.DEPLOYED - 1}', 'early' FROM line WHERE part%127=0 AND log_index%10=1
  UNION ALL SELECT block_number, log_index+8000000, '{b.CHAIN}:'||block_hash||':'||tx_hash||':'||(log_index+8000000), block_hash, 'late' FROM line WHERE part%131=0)"""


def faulty_tape(spark, sf):
    rows = b.tape(spark, sf)
    part, log = F.expr("log_index div 10"), F.col("log_index")
    cases = [
        (part % 101 == 0, {}),
        (part % 103 == 0, {"tx_hash": F.concat("tx_hash", F.lit("x"))}),
        (part % 107 == 0, {"block_hash": F.lit("0xfork"), "log_index": log + 5_000_000}),
        (part % 109 == 0, {"chain_id": F.lit(1).cast("long"), "log_index": log + 6_000_000}),
        (part % 113 == 0, {"contract_address": F.lit("0xother"), "log_index": log + 7_000_000}),
        ((part % 127 == 0) & (log % 10 == 1), {"block_number": F.lit(b.DEPLOYED - 1).cast("long"), "block_hash": F.lit(f"0xb{b.DEPLOYED - 1}"), "tx_hash": F.concat("tx_hash", F.lit("e")), "timestamp_ms": F.lit(b.TAPE_T0_MS).cast("long")}),
        (part % 131 == 0, {"timestamp_ms": F.lit(b.TAPE_CUT.timestamp_ms + 1).cast("long"), "log_index": log + 8_000_000}),
    ]
    whole = rows
    for chosen, change in cases:
        copy = rows.where(chosen).withColumns({n: c.cast(rows.schema[n].dataType) for n, c in change.items()})
        whole = whole.unionByName(copy.withColumn("event_id", event_key()))
    return whole


@query(
    "F9_ledger_guards",
    q.with_tape(FAULTY) + f""", kept AS (SELECT * FROM faulty WHERE block_number<={b.TAPE_CUT.block_number})
SELECT 'repeated_position' AS violation, block_number||'/'||log_index AS subject FROM kept GROUP BY block_number, log_index HAVING count(*)>1
UNION ALL SELECT 'duplicate_event', event_id FROM kept GROUP BY event_id HAVING count(*)>1
UNION ALL SELECT 'mixed_block_hash', CAST(block_number AS VARCHAR) FROM kept GROUP BY block_number HAVING min(block_hash)<>max(block_hash)
UNION ALL SELECT CASE fault WHEN 'chain' THEN 'chain_mismatch' WHEN 'contract' THEN 'wrong_contract' WHEN 'early' THEN 'before_deployment' ELSE 'after_cutoff_time' END, event_id FROM kept WHERE fault IN ('chain','contract','early','late')""",
)
def ledger_guards(spark, sf):
    """The whole tape with faults of every kind in it."""
    return checks.ledger_guards(faulty_tape(spark, sf), b.REGISTRY, b.TAPE_CUT)


@query(
    "F10_event_query",
    q.with_book() + f"SELECT event_id, kind, block_number FROM book WHERE account_id=7 AND perpetual_id=3 AND block_number BETWEEN {b.DEPLOYED} AND {BLOCK} ORDER BY block_number, log_index LIMIT 100 OFFSET 2",
)
def event_query(spark, sf):
    found = scans.event_query(b.book(spark, sf), b.FULL, account_id=7, perpetual_id=3, to_block=BLOCK, offset=2)
    return found.select("event_id", "kind", "block_number")


@query(
    "F12_mark_integrity",
    q.with_book() + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, 'future_or_negative' AS violation, count(*) AS marks FROM book WHERE kind='mark_updated' AND (timestamp_ms>{b.PREVIOUS.timestamp_ms} OR block_number>{b.PREVIOUS.block_number}) GROUP BY 1",
)
def mark_integrity(spark, sf):
    every = b.book(spark, sf).where(kind_is("mark_updated")).select(
        "perpetual_id", F.col("mark_price_pns").alias("mark_pns"), F.lit(None).cast("decimal(38,0)").alias("oracle_pns"),
        "block_number", "timestamp_ms", "log_index", "block_hash",
    )
    bad = checks.exploded(every, ["perpetual_id"], checks.mark_rules(b.PREVIOUS))
    return bad.groupBy(F.col("perpetual_id").cast("long").alias("perpetual_id"), "violation").agg(F.count(F.lit(1)).alias("marks"))


@query(
    "F13_mark_eligible",
    q.with_book(q.marks()) + f"SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, CAST({b.CUT.timestamp_ms}-ts AS BIGINT) AS age_ms, CASE WHEN {b.CUT.timestamp_ms}-ts<60000 THEN CAST(mark_pns AS BIGINT) END AS mark_pns FROM smark",
)
def mark_eligible(spark, sf):
    rows = b.supplied_marks(b.book(spark, sf), b.CUT)
    return rows.select(
        *longs("perpetual_id"), (F.lit(b.CUT.timestamp_ms) - F.col("timestamp_ms")).alias("age_ms"),
        F.when(checks.mark_is_fresh(b.CUT), F.col("mark_pns").cast("long")).alias("mark_pns"),
    )


@query(
    "F14_trading_activity",
    q.with_book() + f"SELECT kind, kind IN {q.TRADING} AS active, count(DISTINCT account_id) AS accounts, count(*) AS events FROM book GROUP BY 1,2",
)
def trading_activity(spark, sf):
    active = kind_is(*analytics.TRADING_KINDS)
    per_account = b.book(spark, sf).groupBy("kind", "account_id").agg(F.count(F.lit(1)).alias("n"))
    return per_account.groupBy("kind", active.alias("active")).agg(F.count("account_id").alias("accounts"), F.sum("n").alias("events"))


@query(
    "F15_event_view",
    q.with_book() + f"SELECT event_id, abi_event_name, kind, account_id, CAST(perpetual_id AS BIGINT) AS perpetual_id, CAST(funding_payment_pns AS BIGINT) AS funding_payment, CAST(funding_event_block AS BIGINT) AS funding_event_block FROM book WHERE block_number<={BLOCK}",
)
def event_view(spark, sf):
    return scans.event_view(b.book(spark, sf).where(b.CUT.includes())).select(
        "event_id", "abi_event_name", "kind", "account_id", *longs("perpetual_id"),
        F.col("funding_payment_pns").cast("long").alias("funding_payment"), "funding_event_block",
    )


@query(
    "F17_historical_scope",
    q.with_book() + f"SELECT count(*) AS events, min(block_number) AS first_block, max(block_number) AS last_block, count(*) FILTER (WHERE kind='account_created')>0 AS anchored, 0::BIGINT AS outside FROM book WHERE block_number BETWEEN {b.PREVIOUS.block_number + 1} AND {BLOCK}",
)
def historical_scope(spark, sf):
    window = b.book(spark, sf).where(F.col("block_number").between(b.PREVIOUS.block_number + 1, BLOCK))
    return scans.scope_facts(window, b.PREVIOUS.block_number + 1, BLOCK, kind_is("account_created"))


WINDOW = (b.PREVIOUS.block_number + 1, BLOCK)
PINNED_FAULTS = "CASE WHEN eid % 997 = 0 THEN 'chain' WHEN eid % 991 = 0 THEN 'contract' WHEN eid % 983 = 0 THEN 'early' END"


def pinned_rows(spark, sf):
    """The whole book with a wrong chain, a wrong contract or a time before the window on some rows."""
    eid = F.regexp_extract("tx_hash", r"^0xt(\d+)$", 1).try_cast("long")
    rows = b.book(spark, sf).withColumn("eid", eid)
    fault = F.when(F.expr("eid % 997 = 0"), "chain").when(F.expr("eid % 991 = 0"), "contract").when(F.expr("eid % 983 = 0"), "early")
    rows = rows.withColumn("fault", F.coalesce(fault, F.lit("")))
    return rows.withColumns(
        {
            "chain_id": F.when(F.col("fault") == "chain", F.lit(1).cast("long")).otherwise(F.col("chain_id")),
            "contract_address": F.when(F.col("fault") == "contract", F.lit("0x0")).otherwise(F.col("contract_address")),
            "timestamp_ms": F.when(F.col("fault") == "early", F.lit(5).cast("long")).otherwise(F.col("timestamp_ms")),
        }
    ).drop("eid", "fault")


@query(
    "F17_pinned_checks",
    q.with_book("pin AS (SELECT *, CASE WHEN tx_hash LIKE '0xt%' THEN CAST(substr(tx_hash,4) AS BIGINT) END AS eid FROM book)", f"flt AS (SELECT *, {PINNED_FAULTS} AS fault FROM pin)")
    + f"""SELECT 'outside_blocks' AS violation, count(*) AS events FROM flt WHERE block_number < {WINDOW[0]} OR block_number > {WINDOW[1]} HAVING count(*)>0
UNION ALL SELECT 'outside_times', count(*) FROM flt WHERE fault='early' OR timestamp_ms < {b.PREVIOUS.timestamp_ms + 1} OR timestamp_ms > {b.CUT.timestamp_ms} HAVING count(*)>0
UNION ALL SELECT 'chain_differs', count(*) FROM flt WHERE fault='chain' HAVING count(*)>0
UNION ALL SELECT 'contract_differs', count(*) FROM flt WHERE fault='contract' HAVING count(*)>0
UNION ALL SELECT 'count_differs', count(*) FROM flt
UNION ALL SELECT 'anchor_absent', count(*) FROM flt""",
)
def pinned_checks(spark, sf):
    """Every row of the book against a pinned window that begins late, ends early and has another count and anchor."""
    first = scans.Header(WINDOW[0], "0xnone", b.PREVIOUS.timestamp_ms + 1)
    last = scans.Header(WINDOW[1], "0xnone", b.CUT.timestamp_ms)
    pin = scans.PinnedWindow(b.CHAIN, b.EXCHANGE, first, last, 7, "0xmissing")
    return scans.pinned_violations(pinned_rows(spark, sf), pin)


@query(
    "F18_recent_window",
    q.with_book() + f"SELECT kind, count(*) AS events, min(block_number) AS first_block FROM book WHERE block_number>=greatest({BLOCK}-50000+1,{b.DEPLOYED}) AND block_number<={BLOCK} GROUP BY 1",
)
def recent_window(spark, sf):
    start = scans.recent_start(b.DEPLOYED, BLOCK, 50_000)
    rows = b.book(spark, sf).where((F.col("block_number") >= start) & b.CUT.includes())
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.min("block_number").alias("first_block"))


@query(
    "O1_replay_order",
    q.with_book() + f"SELECT event_id, account_id, row_number() OVER (PARTITION BY account_id, perpetual_id ORDER BY block_number, log_index, tx_hash) AS place FROM book WHERE kind IN {q.POSITION_KINDS} AND block_number<={BLOCK}",
)
def replay_order(spark, sf):
    """Place of each event in its position, the same after any shuffle of the input."""
    found = ledger.position_events(b.book(spark, sf), b.CUT)
    placed = ledger.running(found, ledger.POSITION, ["block_number", "log_index", "tx_hash"], sums={"place": F.lit(1).cast("long")})
    return placed.select("event_id", "account_id", "place")


@query(
    "O5_latest_event",
    q.with_book() + f"SELECT event_id, kind, block_number, timestamp_ms FROM book WHERE block_number<={b.PREVIOUS.block_number} ORDER BY block_number DESC, log_index DESC LIMIT 1",
)
def latest_event(spark, sf):
    return ledger.latest_event(b.book(spark, sf), b.PREVIOUS).select("event_id", "kind", "block_number", "timestamp_ms")


@query(
    "O6_paged_events",
    q.with_book() + f"SELECT event_id, block_number FROM book WHERE (block_number,log_index) > ({CURSOR[0]},{CURSOR[1]}) AND block_number<={BLOCK} ORDER BY block_number, log_index LIMIT 250",
)
def paged_events(spark, sf):
    return scans.page_after(b.book(spark, sf), CURSOR, b.CUT, 250).select("event_id", "block_number")


@query(
    "U1_union_dedupe",
    q.with_book() + f"SELECT kind, count(DISTINCT event_id) AS events FROM book WHERE block_number<={BLOCK} AND (account_id IS NOT NULL OR kind IN ('mark_updated','market_funding','funding_scale_updated')) GROUP BY 1",
)
def union_dedupe(spark, sf):
    """Account events joined with market inputs and once more with the account events."""
    events = b.book(spark, sf).where(b.CUT.includes())
    mine = events.where("account_id is not null")
    inputs = events.where(kind_is("mark_updated", "market_funding", "funding_scale_updated"))
    merged = scans.union_dedupe([mine, inputs, mine.where(kind_is("account_created"))])
    return merged.groupBy("kind").agg(F.count(F.lit(1)).alias("events"))


@query(
    "U4_distinct_scope",
    q.with_tape() + "SELECT count(perpetual_id) AS ids, count(DISTINCT perpetual_id) AS distinct_ids, count(perpetual_id)=count(DISTINCT perpetual_id) AND count(perpetual_id) BETWEEN 1 AND 20 AS valid FROM tape",
)
def distinct_scope(spark, sf):
    return checks.distinct_scope(b.tape(spark, sf), "perpetual_id")


@query(
    "M1_from_native",
    q.with_book() + "SELECT event_id, CAST(lot_lns // CAST(10**size_decimals AS BIGINT) AS BIGINT) AS whole, CAST((lot_lns % CAST(10**size_decimals AS BIGINT)) * CAST(10**(14-size_decimals) AS BIGINT) AS BIGINT) AS fraction_e14 FROM book JOIN mk USING (perpetual_id) WHERE kind='maker_fill'",
)
def from_native(spark, sf):
    rows = b.REGISTRY.attach(b.book(spark, sf).where(kind_is("maker_fill")))
    units = units_from_native(F.col("lot_lns"), F.col("size_decimals"))
    coin = F.lit(65536 * 10**14).cast("decimal(38,0)")
    return rows.select(
        "event_id", trunc_div(units, coin).cast("long").alias("whole"),
        trunc_div(units % coin, 65536).cast("long").alias("fraction_e14"),
    )


@query(
    "M2_margin_fraction",
    q.with_book() + "SELECT CAST(perpetual_id AS BIGINT) AS perpetual_id, CAST(maint_margin_frac_hdths AS BIGINT)*1000000//100 AS inverse_ppm, CAST(100*1000000//maint_margin_frac_hdths AS BIGINT) AS rate_ppm, count(*) AS events FROM book JOIN mk USING (perpetual_id) GROUP BY 1,2,3",
)
def margin_fraction(spark, sf):
    rows = b.book(spark, sf).groupBy("perpetual_id").agg(F.count(F.lit(1)).alias("events")).join(b.REGISTRY.listed(spark), "perpetual_id")
    maint = F.col("maint_margin_frac_hdths")
    return rows.select(
        *longs("perpetual_id"), ratio_ppm(maint, F.lit(100)).alias("inverse_ppm"), ratio_ppm(F.lit(100), maint).alias("rate_ppm"), "events"
    )


NOTIONAL_SQL = f"CAST(price_pns AS HUGEINT)*lot_lns*65536*CAST(10**(14-price_decimals-size_decimals) AS HUGEINT)//{CNS_UNITS}"


@query("M3_notional", q.with_tape() + f"SELECT event_id, CAST({NOTIONAL_SQL} AS BIGINT) AS notional_cns FROM tape JOIN mk USING (perpetual_id) WHERE kind='maker_fill'")
def notional(spark, sf):
    rows = b.TAPE_REGISTRY.attach(b.tape(spark, sf).where(kind_is("maker_fill")))
    return rows.select("event_id", cns(accounting.notional(F.col("price_pns"), F.col("lot_lns"), accounting.amount_factor())).alias("notional_cns"))


@query("J1_events_x_market", q.with_tape() + f"SELECT event_id, symbol, CAST({NOTIONAL_SQL} AS BIGINT) AS notional_cns, fee_cns FROM tape JOIN mk USING (perpetual_id) WHERE kind='maker_fill' AND block_number<={b.TAPE_CUT.block_number}")
def events_x_market(spark, sf):
    fills = b.TAPE_REGISTRY.attach(ledger.fill_log(b.tape(spark, sf), b.TAPE_CUT))
    value = accounting.notional(F.col("price_pns"), F.col("lot_lns"), accounting.amount_factor())
    return fills.select("event_id", "symbol", cns(value).alias("notional_cns"), *longs("fee_cns"))


@query(
    "M4_ratio6",
    q.with_book() + "SELECT event_id, CASE WHEN funding_cns<>0 THEN CAST(CAST(delta_pnl_cns AS HUGEINT)*1000000//funding_cns AS BIGINT) END AS ratio FROM book WHERE delta_pnl_cns IS NOT NULL",
)
def ratio6(spark, sf):
    rows = b.book(spark, sf).where("delta_pnl_cns is not null")
    return rows.select("event_id", ratio_ppm(F.col("delta_pnl_cns"), F.col("funding_cns")).alias("ratio"))


@query(
    "M11_percent2",
    q.with_book() + """, v AS (SELECT event_id, CAST(CAST(delta_pnl_cns AS HUGEINT)*1000000//nullif(price_pns,0) AS BIGINT) AS p FROM book WHERE delta_pnl_cns IS NOT NULL),
w AS (SELECT event_id, p, abs(p)//100 AS h FROM v)
SELECT event_id, CASE WHEN p<0 AND h>0 THEN '-' ELSE '' END || (h//100) || CASE WHEN h%100=0 THEN '' WHEN h%10=0 THEN '.'||((h%100)//10) ELSE '.'||lpad(CAST(h%100 AS VARCHAR),2,'0') END AS percent FROM w""",
)
def percent2(spark, sf):
    rows = b.book(spark, sf).where("delta_pnl_cns is not null")
    return rows.select("event_id", percent_text(ratio_ppm(F.col("delta_pnl_cns"), F.col("price_pns"))).alias("percent"))


@query(
    "M12_event_key",
    q.with_book() + "SELECT event_id AS event_key, '143:'||account_id||':'||perpetual_id AS position_key FROM book WHERE account_id IS NOT NULL AND perpetual_id IS NOT NULL",
)
def keys(spark, sf):
    rows = b.book(spark, sf).where("account_id is not null and perpetual_id is not null")
    return rows.select(event_key().alias("event_key"), position_key().alias("position_key"))


@query(
    "M13_digest",
    q.with_book() + "SELECT event_id, 'sha256:'||sha256('[\"'||event_id||'\",\"'||kind||'\"]') AS digest FROM book",
)
def digest(spark, sf):
    return b.book(spark, sf).select("event_id", digest_json(F.array("event_id", "kind")).alias("digest"))


@query(
    "M18_block_at",
    q.with_tape() + f"SELECT event_id, {b.BASE_BLOCK} + (timestamp_ms-{b.TAPE_T0_MS})//400 AS block_at, (timestamp_ms//1000)*1000 AS ms FROM tape",
)
def block_at(spark, sf):
    return b.tape(spark, sf).select(
        "event_id",
        F.expr(f"{b.BASE_BLOCK} + (timestamp_ms - {b.TAPE_T0_MS}) div 400").alias("block_at"),
        F.expr("(timestamp_ms div 1000) * 1000").alias("ms"),
    )


@query(
    "A14_event_type_histogram",
    q.with_tape() + f"SELECT abi_event_name, count(*) AS events FROM tape WHERE block_number<={b.TAPE_CUT.block_number} AND timestamp_ms>={b.TAPE_CUT.timestamp_ms - 2592000000} GROUP BY 1",
)
def histogram(spark, sf):
    return analytics.event_histogram(b.tape(spark, sf), b.TAPE_CUT, b.TAPE_CUT.timestamp_ms - 2_592_000_000)


@query(
    "W11_adjacent_duplicate",
    q.with_tape(FAULTY) + "SELECT block_number, CAST(log_index AS BIGINT) AS log_index, count(*)-1 AS repeats FROM faulty GROUP BY 1,2 HAVING count(*)>1",
)
def adjacent_duplicate(spark, sf):
    rows = checks.adjacent_duplicates(faulty_tape(spark, sf))
    return rows.groupBy("block_number", F.col("log_index").cast("long").alias("log_index")).agg(F.count(F.lit(1)).alias("repeats"))


def _tree_sql(levels: int) -> str:
    text = f"l0 AS (SELECT {SEQ}>>10 AS node, count(*) AS n, 'sha256:'||sha256(string_agg(event_id, ',' ORDER BY {SEQ}, event_id)) AS h FROM book WHERE block_number<={BLOCK} GROUP BY 1)"
    for i in range(levels):
        text += f", l{i + 1} AS (SELECT node>>10 AS node, sum(n) AS n, 'sha256:'||sha256(string_agg(h, ',' ORDER BY node)) AS h FROM l{i} GROUP BY 1)"
    return text


@query(
    "E1_range_manifest",
    q.with_book(_tree_sql(5)) + f"SELECT CAST(n AS BIGINT) AS event_count, h AS ordered_ids_tree_hash, (SELECT arg_min(event_id,{SEQ}) FROM book) AS first_event_id, (SELECT arg_max(event_id,{SEQ}) FROM book WHERE block_number<={BLOCK}) AS last_event_id FROM l5",
)
def range_manifest(spark, sf):
    return evidence.range_manifest(b.book(spark, sf), b.CUT)


@query(
    "Q1_ledger_gate",
    q.with_book() + f"SELECT 'eligible' AS status, count(*) AS event_count, max(block_number) AS last_event_block, 0::BIGINT AS coverage_lag_blocks, {BLOCK}-max(block_number) AS event_silence_blocks FROM book WHERE block_number<={BLOCK}",
)
def gate(spark, sf):
    return checks.ledger_gate(b.book(spark, sf), b.CUT, b.FULL, 0)


@query(
    "Q4_analytics_gate",
    q.with_book() + f"SELECT violation, count(*) AS events FROM (SELECT 'before_coverage' AS violation FROM book WHERE block_number<={BLOCK} AND block_number<{b.BASE_BLOCK + 1000}) GROUP BY 1",
)
def analytics_gate(spark, sf):
    from tideledger.params import Coverage

    basis = Coverage(b.CHAIN, b.BASE_BLOCK + 1000, BLOCK)
    return checks.analytics_gate(b.book(spark, sf), b.CUT, basis).groupBy("violation").agg(F.count(F.lit(1)).alias("events"))


Q3_SQL = q.with_tape() + f""", obs AS (SELECT account_id, min(block_number) AS start_block, max(block_number)-account_id%7*100000 AS processed_block,
  CASE WHEN account_id%11<>0 THEN max(block_number)+account_id%5 END AS chain_head_block,
  CASE WHEN account_id%3<>0 THEN max(block_number)-account_id%7*100000-account_id%4*500 END AS last_event_block,
  CASE WHEN account_id%13=0 THEN account_id%2-1 END AS quarantine_from_block FROM tape GROUP BY account_id)
SELECT account_id, CASE
  WHEN processed_block<start_block-1 THEN 'unknown'
  WHEN quarantine_from_block<0 THEN 'unknown' WHEN quarantine_from_block IS NOT NULL THEN 'quarantined'
  WHEN chain_head_block IS NULL THEN 'unknown' WHEN last_event_block<start_block OR last_event_block>processed_block THEN 'unknown'
  WHEN chain_head_block-processed_block>100002 THEN 'lagging' WHEN last_event_block IS NULL THEN 'caught_up_quiet'
  WHEN processed_block-last_event_block>=1000 THEN 'caught_up_quiet' ELSE 'caught_up_active' END AS state FROM obs"""


@query("Q3_coverage_state", Q3_SQL)
def coverage_state(spark, sf):
    """Coverage observations derived from each account's block range."""
    a = F.col("account_id")
    spans = b.tape(spark, sf).groupBy("account_id").agg(F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))
    processed = F.col("hi") - a % 7 * 100_000
    observed = spans.select(
        "account_id",
        F.col("lo").alias("start_block"),
        processed.alias("processed_block"),
        F.when(a % 11 != 0, F.col("hi") + a % 5).alias("chain_head_block"),
        F.when(a % 3 != 0, processed - a % 4 * 500).alias("last_event_block"),
        F.when(a % 13 == 0, a % 2 - 1).alias("quarantine_from_block"),
        F.lit(None).cast("long").alias("quarantine_to_block"),
        F.when(a % 13 == 0, "manual").alias("quarantine_reason"),
        F.lit(100_002).alias("max_lag_blocks"),
        F.lit(1_000).alias("quiet_after_blocks"),
    )
    return evidence.coverage_state(observed).select("account_id", "state")


