"""The same bindings and ledger steps as DuckDB text, for side-by-side checks."""

from __future__ import annotations

from tideledger.catalog import binding as b

UNIT = 65536 * 10**14
CNS = 65536 * 10**8  # units per millionth of a coin
CUT, PREV, TAPE = b.CUT, b.PREVIOUS, b.TAPE_CUT


def values(rows, names) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


def abi_case() -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{a}'" for k, a in b.ABI_OF_KIND.items())
    return f"CASE kind {arms} END"


MK = f"mk AS {values(b.MARKETS, b.MARKET_NAMES)}"
_STEPS = values([tuple(r.values()) for r in b.program_rows()], list(b.program_rows()[0]))
SPANS = "('position_increased','position_decreased','position_deleveraged','position_inverted')"
RESETS = "('position_opened','position_increased','position_inverted')"
SETTLES = "('position_decreased','position_liquidated','position_deleveraged','position_inverted','position_closed')"
MOVES = "('position_liquidation_credit','collateral_decreased')"

BOOK = f"""
{MK},
base AS (
  SELECT event_id AS eid, user_id, event_type, CAST(ROUND(value*100) AS BIGINT) AS cents, rel,
         {b.T0_US // 1000} + rel // 1000 AS timestamp_ms, {b.BASE_BLOCK} + rel // 400000 AS block_number,
         CAST((rel % 400000)*8 AS INTEGER) AS slot0, event_id // 50 AS account_id, event_id // 10 AS g
  FROM (SELECT *, epoch_us(ts) - {b.T0_US} AS rel FROM events)),
stepped AS (
  SELECT base.*, s.kind, s.lot_before, s.lot_after, s.dep_before, s.dep_after, s.flips,
         CAST(1 + g % 5 AS INTEGER) AS perpetual_id, 1 + g % 50 AS unit, 2 + (g*7) % 12 AS lev,
         10000 + cents % 1000 AS price
  FROM base JOIN {_STEPS} s ON s.program = g % 4 AND s.step = eid % 10),
sized AS (
  SELECT st.*, unit*lot_before AS lot0, unit*lot_after AS lot1,
         unit * ((10000 * CAST(10**(6-mk.price_decimals-mk.size_decimals) AS BIGINT)) // lev) * dep_before AS dep0,
         unit * ((10000 * CAST(10**(6-mk.price_decimals-mk.size_decimals) AS BIGINT)) // lev) * dep_after AS dep1
  FROM stepped st JOIN mk USING (perpetual_id)),
pos AS (
  SELECT block_number, slot0+1 AS log_index, '0xt'||eid AS tx_hash, timestamp_ms, kind, account_id, perpetual_id,
    CASE WHEN kind NOT IN ('collateral_increased','position_liquidation_credit') THEN CAST(1+(g+flips)%2 AS INTEGER) END AS position_type,
    CASE WHEN kind IN ('position_opened','position_increased','position_inverted','position_closed','position_unwound','position_deleveraged')
           OR (kind='collateral_decreased' AND cents%2=0) THEN price END AS price_pns,
    CASE WHEN kind='position_opened' THEN lot1 WHEN kind='position_unwound' THEN lot0 END AS lot_lns,
    CASE WHEN kind IN {SPANS} THEN lot0 END AS start_lot_lns,
    CASE WHEN kind IN {SPANS} OR kind='position_liquidated' THEN lot1 END AS end_lot_lns,
    CASE WHEN kind='position_liquidated' THEN lot0-lot1 END AS liq_lot_lns,
    CASE WHEN kind='position_liquidated' THEN price END AS liq_price_pns,
    CASE WHEN kind IN ('position_opened','position_liquidated','collateral_increased') THEN dep1
         WHEN kind='position_unwound' THEN dep0 END AS deposit_cns,
    CASE WHEN kind IN {SPANS} OR kind IN {MOVES} THEN dep0 END AS start_deposit_cns,
    CASE WHEN kind IN {SPANS} OR kind IN {MOVES} THEN dep1 END AS end_deposit_cns,
    CASE WHEN kind='collateral_increased' THEN dep1-dep0 END AS amount_cns,
    CASE WHEN kind IN {SETTLES} THEN (cents%2001-1000)*1000 END AS delta_pnl_cns,
    CASE WHEN kind IN {SETTLES} OR (kind='position_increased' AND cents%3=0) THEN (cents%11-5)*100 END AS funding_cns,
    CASE WHEN kind IN {RESETS} THEN unit*10 END AS ins_fee_cns,
    CASE WHEN kind IN {RESETS} THEN unit*35 END AS prot_fee_cns,
    CASE WHEN kind='position_opened' OR (kind='position_increased' AND cents%2=0) THEN lev*100 END AS leverage_hdths,
    CASE WHEN kind IN ('position_opened','position_increased') AND g%3=0 THEN (cents*37)%65536 END AS price_residue_pnsq16
  FROM sized),
pubrows AS (
  SELECT 1 + eid%5 AS perpetual_id, rel // 3600000000 AS hour, rel, eid, timestamp_ms AS ms, block_number AS block, slot0, cents%7-3 AS pay,
         row_number() OVER (PARTITION BY 1 + eid%5, rel // 3600000000 ORDER BY rel, eid) > 1 AS again
  FROM base WHERE event_type='signup'),
pubhours AS (
  SELECT perpetual_id, hour, arg_max(pay, {{'rel': rel, 'eid': eid}}) AS final FROM pubrows GROUP BY 1,2),
pubbase AS (
  SELECT *, COALESCE(SUM(final) OVER (PARTITION BY perpetual_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before
  FROM pubhours),
pubs AS (
  SELECT perpetual_id, hour, before, r AS p, again FROM (SELECT perpetual_id, hour, again, {{'rel': rel, 'eid': eid, 'ms': ms, 'block': block, 'slot0': slot0, 'pay': pay}} AS r FROM pubrows) JOIN pubbase USING (perpetual_id, hour)),
raw AS (
  SELECT block_number, slot0 AS log_index, '0xt'||eid AS tx_hash, timestamp_ms, 'account_created' AS kind, account_id
    FROM base WHERE eid%50=0 AND account_id%10<>9
  UNION ALL BY NAME SELECT * FROM pos
  UNION ALL BY NAME SELECT block_number, slot0+2 AS log_index, '0xt'||eid AS tx_hash, timestamp_ms, 'maker_fill' AS kind,
    user_id+1000000 AS account_id, perpetual_id, price AS price_pns, greatest(lot0,lot1) AS lot_lns, unit AS fee_cns FROM sized
  UNION ALL BY NAME SELECT block_number, slot0+3 AS log_index, '0xt'||eid AS tx_hash, timestamp_ms, 'mark_updated' AS kind,
    CAST(1+eid%5 AS INTEGER) AS perpetual_id, 9500 + cents%1500 AS mark_price_pns FROM base WHERE event_type='view'
  UNION ALL BY NAME SELECT p.block AS block_number, p.slot0+4 AS log_index, '0xt'||p.eid AS tx_hash, p.ms AS timestamp_ms,
    'market_funding' AS kind, CAST(perpetual_id AS INTEGER) AS perpetual_id, p.pay AS funding_payment_pns,
    CAST(before+p.pay AS BIGINT) AS funding_sum_pns, {b.BASE_BLOCK}+(hour+1)*9000 AS funding_event_block, again AS funding_allow_overwrite FROM pubs
  UNION ALL BY NAME SELECT block_number, slot0+5 AS log_index, '0xt'||eid AS tx_hash, timestamp_ms,
    CASE WHEN event_type='purchase' THEN 'collateral_deposit' ELSE 'collateral_withdrawal' END AS kind, account_id,
    cents*CASE WHEN event_type='purchase' THEN 10000 ELSE 1000 END AS amount_cns, cents*777 AS balance_cns
    FROM base WHERE event_type IN ('purchase','error')
  UNION ALL BY NAME SELECT blk AS block_number, lg AS log_index, '0xs'||m AS tx_hash, {b.T0_US // 1000}+(blk-{b.BASE_BLOCK})*400 AS timestamp_ms,
    'funding_scale_updated' AS kind, CAST(m AS INTEGER) AS perpetual_id, e AS funding_scaling_exp
    FROM (VALUES ({b.BASE_BLOCK - 50},1,1,0),({b.BASE_BLOCK - 50},2,2,0),({b.BASE_BLOCK - 50},3,3,0),({b.BASE_BLOCK - 50},5,5,0),
                 ({b.BASE_BLOCK + 15 * b.DAY_BLOCKS},7,2,1)) AS s(blk,lg,m,e)),
book AS MATERIALIZED (
  SELECT *, {abi_case()} AS abi_event_name, '0xb'||block_number AS block_hash,
    '{b.CHAIN}:0xb'||block_number||':'||tx_hash||':'||log_index AS event_id FROM raw)"""

TAPE_SQL = f"""
{MK},
lines AS (
  SELECT *, (epoch_us(l_shipdate)//1000 - {b.TAPE_T0_MS}) // {b.DAY_MS} AS day, (l_orderkey*7+l_linenumber) % 216000 AS tick,
    CAST(ROUND(l_extendedprice*100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty, CAST(ROUND(l_tax*100) AS BIGINT) AS tax,
    CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 'position_liquidated'
         WHEN l_returnflag='A' AND l_linestatus='O' THEN 'position_opened'
         WHEN l_returnflag='N' AND l_linestatus='O' THEN 'collateral_deposit'
         WHEN l_returnflag='A' AND l_linestatus='F' THEN 'collateral_withdrawal' ELSE 'maker_fill' END AS kind
  FROM lineitem),
tape AS MATERIALIZED (
  SELECT kind, {abi_case()} AS abi_event_name, {b.BASE_BLOCK} + day*{b.DAY_BLOCKS} + tick AS block_number,
    {b.TAPE_T0_MS} + day*{b.DAY_MS} + tick*400 AS timestamp_ms, l_partkey*10+l_linenumber AS log_index,
    '0xl_'||l_orderkey||'_'||l_linenumber||'_'||l_suppkey AS tx_hash, l_partkey AS account_id,
    CASE WHEN kind NOT IN ('collateral_deposit','collateral_withdrawal') THEN CAST(1+l_suppkey%10 AS INTEGER) END AS perpetual_id,
    CASE WHEN kind IN ('maker_fill','position_opened') THEN cents//qty END AS price_pns,
    CASE WHEN kind IN ('maker_fill','position_opened') THEN qty END AS lot_lns,
    CASE WHEN kind='maker_fill' THEN qty*tax END AS fee_cns,
    CASE WHEN kind='position_opened' THEN qty*2 END AS ins_fee_cns, CASE WHEN kind='position_opened' THEN qty*5 END AS prot_fee_cns,
    CASE WHEN kind='position_liquidated' THEN cents//qty END AS liq_price_pns, CASE WHEN kind='position_liquidated' THEN qty END AS liq_lot_lns,
    CASE WHEN kind IN ('collateral_deposit','collateral_withdrawal') THEN cents END AS amount_cns,
    '0xb'||block_number AS block_hash, '{b.CHAIN}:0xb'||block_number||':'||tx_hash||':'||log_index AS event_id
  FROM lines)"""

POSITION_KINDS = (
    "('position_opened','position_increased','position_decreased','position_closed','position_liquidated',"
    "'position_liquidation_credit','position_deleveraged','position_inverted','position_unwound','collateral_increased','collateral_decreased')"
)
TRADING = POSITION_KINDS[:-1] + ",'maker_fill')"


def ledger(cut=CUT, tag="") -> str:
    """hist/state CTEs at a cutoff (needs BOOK)."""
    block = cut.block_number
    w = "PARTITION BY account_id, perpetual_id ORDER BY block_number, log_index"
    upto = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def last(x):
        return f"last_value({x} IGNORE NULLS) {upto}"

    partial = "('position_decreased','position_liquidated','position_deleveraged')"
    return f"""
ev{tag} AS (
  SELECT *,
    CASE WHEN kind='position_opened' THEN lot_lns WHEN kind IN ('position_closed','position_unwound') THEN 0
         WHEN kind IN ('position_increased','position_decreased','position_liquidated','position_deleveraged','position_inverted') THEN end_lot_lns END AS s_lot,
    CASE WHEN kind IN ('position_closed','position_unwound') OR (kind IN {partial} AND end_lot_lns=0) THEN 0
         WHEN kind IN ('position_opened','position_liquidated','collateral_increased') THEN deposit_cns ELSE end_deposit_cns END AS s_dep,
    CASE WHEN kind IN ('position_opened','position_inverted') THEN position_type END AS s_side,
    CASE WHEN kind IN {RESETS} OR kind='collateral_decreased' THEN price_pns END AS s_entry,
    CASE WHEN kind IN ('position_opened','position_increased') THEN COALESCE(price_residue_pnsq16,0)
         WHEN kind='position_inverted' OR (kind='collateral_decreased' AND price_pns IS NOT NULL) THEN 0 END AS s_res,
    CASE WHEN kind='position_opened' THEN COALESCE(leverage_hdths,0) WHEN kind IN ('position_increased','position_inverted') THEN leverage_hdths END AS s_lev,
    CASE WHEN kind IN {RESETS} THEN 'open' WHEN kind='position_closed' THEN 'closed' WHEN kind='position_unwound' THEN 'unwound'
         WHEN kind='position_decreased' THEN CASE WHEN end_lot_lns=0 THEN 'closed' ELSE 'open' END
         WHEN kind='position_liquidated' THEN CASE WHEN end_lot_lns=0 THEN 'liquidated' ELSE 'open' END
         WHEN kind='position_deleveraged' THEN CASE WHEN end_lot_lns=0 THEN 'deleveraged' ELSE 'open' END END AS s_status,
    CASE WHEN kind IN {SETTLES} OR kind='position_unwound' THEN COALESCE(delta_pnl_cns,0) ELSE 0 END AS a_pnl,
    CASE WHEN kind IN {SETTLES} OR kind IN ('position_unwound','position_increased') THEN COALESCE(funding_cns,0) ELSE 0 END AS a_fund,
    CASE WHEN kind IN {RESETS} THEN COALESCE(ins_fee_cns,0)+COALESCE(prot_fee_cns,0) ELSE 0 END AS a_fee,
    CASE WHEN kind IN {RESETS} THEN 1 ELSE 0 END AS a_reset,
    CASE WHEN kind NOT IN ('collateral_increased','collateral_decreased') THEN event_id END AS s_last,
    CASE WHEN kind NOT IN ('collateral_increased','collateral_decreased') THEN timestamp_ms END AS s_last_ms
  FROM book WHERE kind IN {POSITION_KINDS} AND block_number <= {block}),
hist{tag} AS MATERIALIZED (
  SELECT account_id, perpetual_id, block_number, log_index, timestamp_ms, event_id, kind, position_type, start_lot_lns, start_deposit_cns, end_lot_lns,
    {last('s_lot')} AS lot, {last('s_dep')} AS dep, {last('s_side')} AS side, {last('s_entry')} AS entry, {last('s_res')} AS res,
    {last('s_lev')} AS lev, {last('s_status')} AS status, {last("CASE WHEN kind='position_opened' THEN block_number END")} AS opened_block,
    {last("CASE WHEN s_status<>'open' THEN block_number END")} AS ended_block,
    {last('s_last')} AS last_event_id, {last('s_last_ms')} AS last_event_ms,
    CAST(SUM(a_pnl) {upto} AS BIGINT) AS pnl, CAST(SUM(a_fund) {upto} AS BIGINT) AS fund, CAST(SUM(a_fee) {upto} AS BIGINT) AS fees,
    CAST(SUM(a_reset) {upto} AS BIGINT) AS span, lead(block_number) OVER ({w}) AS next_block,
    CASE WHEN kind IN ('position_decreased','position_liquidated','position_deleveraged') THEN funding_cns END AS settled
  FROM ev{tag}),
st{tag} AS MATERIALIZED (SELECT *, COALESCE(status='open' AND lot>0,false) AS is_open FROM hist{tag} WHERE next_block IS NULL)"""


def marks(cut=CUT, tag="") -> str:
    return f"""
cmark{tag} AS (
  SELECT perpetual_id, arg_max(mark_price_pns, block_number*2147483648+log_index) AS mark_pns,
    arg_max(event_id, block_number*2147483648+log_index) AS mark_event_id, arg_max(timestamp_ms, block_number*2147483648+log_index) AS mark_ms,
    arg_max(block_number, block_number*2147483648+log_index) AS mark_block
  FROM book WHERE kind='mark_updated' AND block_number<={cut.block_number} GROUP BY 1),
smark{tag} AS (
  SELECT perpetual_id, mark_pns, {cut.timestamp_ms}-(perpetual_id-1)*20000 AS ts, {cut.block_number}-(perpetual_id-1)*50 AS blk FROM cmark{tag})"""


def funding(cut=CUT, tag="", scope="(1,2,3,4)") -> str:
    block = cut.block_number
    return f"""
pubs_x{tag} AS (
  SELECT f.*, (SELECT arg_max(s.funding_scaling_exp, s.block_number*2147483648+s.log_index) FROM book s
     WHERE s.kind='funding_scale_updated' AND s.perpetual_id=f.perpetual_id
       AND (s.block_number, s.log_index) < (f.block_number, f.log_index)) AS scale_exp
  FROM book f WHERE f.kind='market_funding' AND f.block_number<={block}),
sched{tag} AS MATERIALIZED (
  SELECT p.perpetual_id, p.effective_block, p.r.event_id AS event_id, p.r.pay AS pay, p.r.sx AS sx, p.r.sm AS sm, p.n-1 AS replacements,
    CASE WHEN p.r.pay=0 THEN 0 WHEN p.r.sx IS NULL THEN NULL
      ELSE CAST(p.r.pay AS HUGEINT)*65536*CAST(10**(14-p.r.sx-mk.price_decimals-mk.size_decimals) AS HUGEINT) END AS per_lot
  FROM (SELECT perpetual_id, funding_event_block AS effective_block, count(*) AS n,
      arg_max({{'event_id': event_id, 'pay': funding_payment_pns, 'sx': scale_exp, 'sm': funding_sum_pns}}, block_number*2147483648+log_index) AS r
    FROM pubs_x{tag} GROUP BY 1,2) p JOIN mk USING (perpetual_id)),
pay_pairs{tag} AS (
  SELECT h.account_id, h.perpetual_id, h.span, h.event_id, s.effective_block, s.event_id AS payment_event_id,
    s.per_lot * h.lot * CASE WHEN h.side=1 THEN -1 ELSE 1 END AS amount, CASE WHEN s.pay<>0 AND s.sx IS NULL THEN 1 ELSE 0 END AS unk
  FROM hist{tag} h JOIN sched{tag} s ON s.perpetual_id=h.perpetual_id AND s.effective_block>h.block_number
    AND s.effective_block<=COALESCE(h.next_block,{block}) AND s.effective_block<={block}
  WHERE h.perpetual_id IN {scope} AND h.status='open' AND h.lot>0),
unset{tag} AS MATERIALIZED (
  SELECT st.account_id, st.perpetual_id,
    CASE WHEN NOT st.is_open THEN 0 WHEN COALESCE(pp.unk,0)>0 THEN NULL WHEN st.perpetual_id NOT IN {scope} THEN NULL
      ELSE COALESCE(pp.amount,0) - CAST(COALESCE(se.settled,0) AS HUGEINT)*65536*100000000 END AS unsettled,
    rs.reset_event_id, rs.reset_block
  FROM st{tag} st
  LEFT JOIN (SELECT account_id, perpetual_id, span, SUM(amount) AS amount, SUM(unk) AS unk FROM pay_pairs{tag} GROUP BY 1,2,3) pp
    ON pp.account_id=st.account_id AND pp.perpetual_id=st.perpetual_id AND pp.span=st.span
  LEFT JOIN (SELECT account_id, perpetual_id, span, SUM(settled) AS settled FROM hist{tag} GROUP BY 1,2,3) se
    ON se.account_id=st.account_id AND se.perpetual_id=st.perpetual_id AND se.span=st.span
  LEFT JOIN (SELECT account_id, perpetual_id, span, arg_max(event_id, block_number) AS reset_event_id, max(block_number) AS reset_block
      FROM hist{tag} WHERE kind IN {RESETS} GROUP BY 1,2,3) rs
    ON rs.account_id=st.account_id AND rs.perpetual_id=st.perpetual_id AND rs.span=st.span)"""


def risk(cut=CUT, tag="", funded=True) -> str:
    """Priced positions; needs ledger, marks and (if funded) funding."""
    fund = f"u.unsettled" if funded else "CASE WHEN st.is_open THEN NULL ELSE CAST(0 AS HUGEINT) END"
    join = f"LEFT JOIN unset{tag} u ON u.account_id=st.account_id AND u.perpetual_id=st.perpetual_id" if funded else ""
    reset = "u.reset_event_id" if funded else "CAST(NULL AS VARCHAR)"
    return f"""
p0{tag} AS (
  SELECT st.*, mk.symbol, mk.price_decimals AS pd, mk.size_decimals AS sd, mk.init_margin_frac_hdths AS im, mk.maint_margin_frac_hdths AS mm,
    {fund} AS uns, {reset} AS reset_event_id,
    CASE WHEN st.is_open AND {cut.timestamp_ms}-m.ts < 60000 THEN CAST(m.mark_pns AS HUGEINT) END AS mark,
    CAST(CASE WHEN st.res>0 AND st.side=1 THEN st.entry-1 ELSE st.entry END AS HUGEINT)*65536+st.res AS eq16,
    CAST(10**(14-mk.price_decimals-mk.size_decimals) AS HUGEINT) AS f, CASE WHEN st.side=1 THEN 1 ELSE -1 END AS sg,
    CAST(st.dep AS HUGEINT)*65536*100000000 AS dep_u
  FROM st{tag} st JOIN mk USING (perpetual_id) LEFT JOIN smark{tag} m ON m.perpetual_id=st.perpetual_id {join}),
p1{tag} AS (
  SELECT *, CASE WHEN is_open THEN eq16*lot*f END AS en_u, CASE WHEN is_open THEN mark*lot*65536*f END AS not_u,
    CASE WHEN is_open THEN (mark*65536-eq16)*lot*sg*f ELSE 0 END AS pnl_u, mark*65536*CAST(10**(14-pd) AS HUGEINT) AS mark_u FROM p0{tag}),
risk{tag} AS MATERIALIZED (
  SELECT *, (en_u*100)//mm AS maint_u, CASE WHEN is_open THEN dep_u+pnl_u END AS zeq_u,
    CASE WHEN is_open THEN pnl_u+uns ELSE 0 END AS tot_u, CASE WHEN is_open THEN dep_u+pnl_u+uns END AS eq_u,
    CASE WHEN is_open AND uns IS NOT NULL THEN greatest(CAST(0 AS HUGEINT), eq16*CAST(10**(14-pd) AS HUGEINT) + sg*(((en_u*100-(dep_u+uns)*mm)*CAST(10**sd AS HUGEINT))//(mm*lot))) END AS liq_u,
    CASE WHEN is_open THEN greatest(CAST(0 AS HUGEINT), eq16*CAST(10**(14-pd) AS HUGEINT) + sg*(((en_u*100-dep_u*mm)*CAST(10**sd AS HUGEINT))//(mm*lot))) END AS zliq_u,
    CASE WHEN NOT is_open THEN 'closed' WHEN uns IS NULL THEN 'funding-unverified' WHEN mark IS NULL THEN 'marks-unavailable' ELSE 'canonical-funding-covered' END AS risk_status
  FROM p1{tag})"""


def with_book(*parts: str) -> str:
    return "WITH " + ",".join([BOOK, *parts]) + "\n"


def with_tape(*parts: str) -> str:
    return "WITH " + ",".join([TAPE_SQL, *parts]) + "\n"


FULL_RISK = [ledger(), marks(), funding(), risk()]
