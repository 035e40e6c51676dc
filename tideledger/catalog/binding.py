"""Bind the shared test tables to the event model.

``book``   every row of ``events`` becomes one step of a position program plus
           a maker fill, and by type also a mark, a funding publication or a
           collateral flow; five markets, accounts of five positions each.
``tape``   every row of ``lineitem`` becomes a fill, an opening, a liquidation
           or a collateral flow in ten markets over seven years.

Both keep all rows of their table and need no window over an account or market
(funding publications are at most two per market and hour).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideledger.functions.exact import DEC
from tideledger.params import AsOf, Coverage, FundingScope, Registry, local_frame
from tideledger.schema import ABI_EVENTS, EVENT

CHAIN = 143
EXCHANGE = "0x" + "ab" * 20
DEPLOYED = 54_773_010
BASE_BLOCK = 54_774_000
T0_US = 1_704_067_200_000_000  # 2024-01-01
TAPE_T0_MS = 788_918_400_000  # 1995-01-01
DAY_BLOCKS, DAY_MS = 216_000, 86_400_000

# id, symbol, price digits, size digits, initial and maintenance fraction, listed
MARKETS = [
    (1, "AAA", 2, 3, 1000, 2000, True),
    (2, "BBB", 1, 4, 1500, 2500, True),
    (3, "CCC", 2, 2, 1200, 2000, True),
    (4, "DDD", 3, 1, 1000, 1800, True),
    (5, "EEE", 2, 4, 300, 1000, True),
    (6, "FFF", 0, 2, 1000, 2000, True),
    (7, "GGG", 2, 0, 1200, 2000, True),
    (8, "HHH", 1, 1, 1500, 2500, True),
    (9, "III", 3, 3, 500, 1000, True),
    (10, "JJJ", 2, 2, 1000, 2000, False),
]
MARKET_NAMES = [
    "perpetual_id", "symbol", "price_decimals", "size_decimals", "init_margin_frac_hdths",
    "maint_margin_frac_hdths", "listed",
]
REGISTRY = Registry(CHAIN, EXCHANGE, DEPLOYED, 6, tuple(dict(zip(MARKET_NAMES, m)) for m in MARKETS), (10,))
#: The tape trades on all ten markets, so its flows need all of them listed.
TAPE_REGISTRY = Registry(CHAIN, EXCHANGE, DEPLOYED, 6, tuple(dict(zip(MARKET_NAMES, m), listed=True) for m in MARKETS))


def _cut(day: int) -> AsOf:
    block = BASE_BLOCK + day * DAY_BLOCKS - 1
    return AsOf(CHAIN, block, f"0xb{block}", T0_US // 1000 + day * DAY_MS - 1)


CUT, PREVIOUS = _cut(29), _cut(20)
TAPE_DAYS = 2373  # through 2001-06-30
TAPE_CUT = AsOf(CHAIN, BASE_BLOCK + TAPE_DAYS * DAY_BLOCKS - 1, "0xtape", TAPE_T0_MS + TAPE_DAYS * DAY_MS - 1)
FULL = Coverage(CHAIN, DEPLOYED, CUT.block_number)
BOUNDED = Coverage(CHAIN, BASE_BLOCK, CUT.block_number)
SCOPE = FundingScope(DEPLOYED, CUT.block_number, (1, 2, 3, 4))
TAPE_FULL = Coverage(CHAIN, DEPLOYED, TAPE_CUT.block_number)

# Ten-step position programs: (kind, size multiple after, deposit multiple after).
PROGRAMS = [
    [("position_opened", 10, 10), ("position_increased", 15, 15), ("position_decreased", 8, 8),
     ("position_inverted", 6, 6), ("collateral_increased", 6, 9), ("collateral_decreased", 6, 7),
     ("position_deleveraged", 4, 4), ("position_closed", 0, 0), ("position_opened", 12, 12),
     ("position_increased", 20, 20)],
    [("position_opened", 10, 10), ("collateral_increased", 10, 14), ("position_decreased", 5, 7),
     ("position_liquidated", 3, 4), ("position_liquidation_credit", 3, 5), ("position_increased", 9, 9),
     ("position_liquidated", 0, 0), ("position_opened", 7, 7), ("position_decreased", 6, 6),
     ("collateral_decreased", 6, 5)],
    [("position_opened", 20, 20), ("position_increased", 30, 30), ("position_inverted", 10, 10),
     ("position_decreased", 0, 0), ("position_opened", 10, 10), ("position_deleveraged", 0, 0),
     ("position_opened", 5, 5), ("position_increased", 10, 10), ("position_unwound", 0, 0),
     ("position_opened", 8, 8)],
    [("position_opened", 10, 10), ("position_decreased", 8, 8), ("position_increased", 12, 12),
     ("collateral_decreased", 12, 11), ("position_inverted", 5, 5), ("position_increased", 6, 6),
     ("position_deleveraged", 3, 3), ("position_liquidation_credit", 3, 4), ("position_decreased", 2, 2),
     ("position_liquidated", 0, 0)],
]


def program_rows() -> list[dict]:
    rows = []
    for program, steps in enumerate(PROGRAMS):
        lot = deposit = flips = 0
        for step, (kind, lot_after, deposit_after) in enumerate(steps):
            flips += kind == "position_inverted"
            rows.append(
                dict(program=program, step=step, kind=kind, lot_before=lot, lot_after=lot_after,
                     dep_before=deposit, dep_after=deposit_after, flips=flips)
            )
            lot, deposit = lot_after, deposit_after
    return rows


ABI_OF_KIND: dict[str, str] = {}
for _name, _rule in ABI_EVENTS.items():
    ABI_OF_KIND.setdefault(_rule[0], _name)


_PLANS: dict[tuple, DataFrame] = {}


def planned(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Reuse a lazily built plan inside one application; no data is kept."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _PLANS:
        _PLANS[full] = build()
    return _PLANS[full]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kinds(*names: str) -> Column:
    return F.col("kind").isin(*names)


def micros(column: str) -> str:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))"


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = F.expr(f"{micros('ts')} - {T0_US}")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", rel.alias("rel"))
    return rows.select(
        F.col("event_id").alias("eid"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        "rel",
        F.expr(f"{T0_US // 1000} + rel div 1000").alias("timestamp_ms"),
        F.expr(f"{BASE_BLOCK} + rel div 400000").alias("block_number"),
        F.expr("cast((rel % 400000) * 8 as int)").alias("slot0"),
        F.expr("event_id div 50").alias("account_id"),
        F.expr("event_id div 10").alias("g"),
    )


def _placed(rows: DataFrame, slot: int) -> DataFrame:
    return rows.withColumns(
        {"log_index": F.col("slot0") + slot, "tx_hash": F.concat(F.lit("0xt"), F.col("eid").cast("string"))}
    )


def _position_events(spark: SparkSession, base: DataFrame) -> DataFrame:
    types = dict(kind=pa.string())
    steps = local_frame(
        spark, program_rows(), pa.schema([(n, types.get(n, pa.int64())) for n in program_rows()[0]])
    )
    digits = F.create_map(*[F.lit(x) for m in MARKETS for x in (m[0], 10 ** (6 - m[2] - m[3]))])
    rows = base.withColumns(
        {
            "program": F.expr("g % 4"),
            "step": F.expr("eid % 10"),
            "perpetual_id": F.expr("cast(1 + g % 5 as int)"),
            "unit": F.expr("1 + g % 50"),
            "lev": F.expr("2 + (g * 7) % 12"),
            "price": F.expr("10000 + cents % 1000"),
        }
    )
    # Forty constant program steps.
    rows = rows.join(F.broadcast(steps), ["program", "step"])
    rows = rows.withColumns(
        {
            "dep_unit": F.expr("unit") * F.floor(F.lit(10_000) * F.element_at(digits, F.col("perpetual_id")) / F.col("lev")),
            "lot0": F.expr("unit * lot_before"),
            "lot1": F.expr("unit * lot_after"),
        }
    ).withColumns({"dep0": F.expr("dep_unit * dep_before"), "dep1": F.expr("dep_unit * dep_after")})
    resets = ["position_opened", "position_increased", "position_inverted"]
    spans = ["position_increased", "position_decreased", "position_deleveraged", "position_inverted"]
    settles = ["position_decreased", "position_liquidated", "position_deleveraged", "position_inverted", "position_closed"]
    priced = _kinds(*resets, "position_closed", "position_unwound", "position_deleveraged") | (
        _kinds("collateral_decreased") & F.expr("cents % 2 = 0")
    )
    settled = F.expr("(cents % 11 - 5) * 100")
    return _placed(rows, 1).withColumns(
        {
            "position_type": F.when(
                ~_kinds("collateral_increased", "position_liquidation_credit"), F.expr("cast(1 + (g + flips) % 2 as int)")
            ),
            "price_pns": F.when(priced, F.col("price")),
            "lot_lns": F.when(_kinds("position_opened"), F.col("lot1")).when(_kinds("position_unwound"), F.col("lot0")),
            "start_lot_lns": F.when(_kinds(*spans), F.col("lot0")),
            "end_lot_lns": F.when(_kinds(*spans, "position_liquidated"), F.col("lot1")),
            "liq_lot_lns": F.when(_kinds("position_liquidated"), F.expr("lot0 - lot1")),
            "liq_price_pns": F.when(_kinds("position_liquidated"), F.col("price")),
            "deposit_cns": F.when(
                _kinds("position_opened", "position_liquidated", "collateral_increased"), F.col("dep1")
            ).when(_kinds("position_unwound"), F.col("dep0")),
            "start_deposit_cns": F.when(
                _kinds(*spans, "position_liquidation_credit", "collateral_decreased"), F.col("dep0")
            ),
            "end_deposit_cns": F.when(
                _kinds(*spans, "position_liquidation_credit", "collateral_decreased"), F.col("dep1")
            ),
            "amount_cns": F.when(_kinds("collateral_increased"), F.expr("dep1 - dep0")),
            "delta_pnl_cns": F.when(_kinds(*settles), F.expr("(cents % 2001 - 1000) * 1000")),
            "funding_cns": F.when(_kinds(*settles), settled).when(
                _kinds("position_increased") & F.expr("cents % 3 = 0"), settled
            ),
            "ins_fee_cns": F.when(_kinds(*resets), F.expr("unit * 10")),
            "prot_fee_cns": F.when(_kinds(*resets), F.expr("unit * 35")),
            "leverage_hdths": F.when(_kinds("position_opened"), F.expr("cast(lev * 100 as int)")).when(
                _kinds("position_increased") & F.expr("cents % 2 = 0"), F.expr("cast(lev * 100 as int)")
            ),
            "price_residue_pnsq16": F.when(
                _kinds("position_opened", "position_increased") & F.expr("g % 3 = 0"),
                F.expr("cast((cents * 37) % 65536 as int)"),
            ),
        }
    )


def funding_publications(base: DataFrame) -> DataFrame:
    """Every signup publishes a payment: the first of a market-hour for the hour's end, each
    later one overwrites it on the same base sum."""
    rows = base.where("event_type = 'signup'").withColumns(
        {
            "perpetual_id": F.expr("cast(1 + eid % 5 as int)"),
            "hour": F.expr("rel div 3600000000"),
            "pay": F.expr("cents % 7 - 3"),
        }
    )
    in_hour = Window.partitionBy("perpetual_id", "hour").orderBy("rel", "eid")
    hours = rows.groupBy("perpetual_id", "hour").agg(F.max_by("pay", F.struct("rel", "eid")).alias("final"))
    earlier = Window.partitionBy("perpetual_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("perpetual_id", "hour", F.coalesce(F.sum("final").over(earlier), F.lit(0)).alias("before"))
    placed = rows.withColumn("again", F.row_number().over(in_hour) > 1).join(hours, ["perpetual_id", "hour"])
    return placed.select(
        "perpetual_id", "rel", "eid", "timestamp_ms", "block_number", "slot0",
        F.lit("market_funding").alias("kind"),
        F.col("pay").alias("funding_payment_pns"),
        F.col("pay").alias("funding_rate_pct100k"),
        (F.col("before") + F.col("pay")).alias("funding_sum_pns"),
        F.expr(f"{BASE_BLOCK} + (hour + 1) * 9000").alias("funding_event_block"),
        F.col("again").alias("funding_allow_overwrite"),
    )


def _scales(spark: SparkSession) -> DataFrame:
    rows = [(BASE_BLOCK - 50, m, m, 0) for m in (1, 2, 3, 5)] + [(BASE_BLOCK + 15 * DAY_BLOCKS, 7, 2, 1)]
    data = [
        dict(block_number=b, log_index=log, perpetual_id=m, funding_scaling_exp=e, timestamp_ms=T0_US // 1000 + (b - BASE_BLOCK) * 400)
        for b, log, m, e in rows
    ]
    types = [("block_number", pa.int64()), ("log_index", pa.int32()), ("perpetual_id", pa.int32()),
             ("funding_scaling_exp", pa.int32()), ("timestamp_ms", pa.int64())]
    frame = local_frame(spark, data, pa.schema(types))
    return frame.withColumns({"kind": F.lit("funding_scale_updated"), "tx_hash": F.concat(F.lit("0xs"), F.col("perpetual_id").cast("string"))})


def as_events(rows: DataFrame) -> DataFrame:
    """Complete rows to the canonical schema plus ``event_id``."""
    have = set(rows.columns)
    abi = " ".join(f"when '{kind}' then '{name}'" for kind, name in ABI_OF_KIND.items())
    given = {
        "chain_id": str(CHAIN),
        "block_hash": "concat('0xb', cast(block_number as string))",
        "contract_address": f"'{EXCHANGE}'",
        "abi_event_name": f"case kind {abi} end",
        "owner": f"if(kind = 'account_created', '0x{'cd' * 20}', null)",
    }
    columns = []
    for field in EVENT.fields:
        value = field.name if field.name in have else given.get(field.name, "null")
        columns.append(f"cast({value} as {field.dataType.simpleString()}) as {field.name}")
    key = "concat_ws(':', cast(chain_id as string), block_hash, tx_hash, cast(log_index as string)) as event_id"
    return rows.selectExpr(*columns).selectExpr("*", key)


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, ("book", sf_dir), lambda: _book(spark, sf_dir))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, ("tape", sf_dir), lambda: _tape(spark, sf_dir))


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = base_rows(spark, sf_dir)
    positions = _position_events(spark, base)
    created = _placed(base.where("eid % 50 = 0 and account_id % 10 <> 9"), 0).withColumn("kind", F.lit("account_created"))
    fills = _placed(positions.drop("log_index", "tx_hash"), 2).select(
        "block_number", "log_index", "tx_hash", "timestamp_ms", F.lit("maker_fill").alias("kind"),
        (F.col("user_id") + 1_000_000).alias("account_id"), "perpetual_id", F.col("price").alias("price_pns"),
        F.greatest("lot0", "lot1").alias("lot_lns"), F.col("unit").alias("fee_cns"),
    )
    marks = _placed(base.where("event_type = 'view'"), 3).select(
        "block_number", "log_index", "tx_hash", "timestamp_ms", F.lit("mark_updated").alias("kind"),
        F.expr("cast(1 + eid % 5 as int)").alias("perpetual_id"), F.expr("9500 + cents % 1500").alias("mark_price_pns"),
    )
    flows = _placed(base.where("event_type in ('purchase', 'error')"), 5).select(
        "block_number", "log_index", "tx_hash", "timestamp_ms", "account_id",
        F.expr("if(event_type = 'purchase', 'collateral_deposit', 'collateral_withdrawal')").alias("kind"),
        F.expr("cents * if(event_type = 'purchase', 10000, 1000)").alias("amount_cns"),
        F.expr("cents * 777").alias("balance_cns"),
    )
    parts = [created, positions, fills, marks, _placed(funding_publications(base), 4), flows, _scales(spark)]
    rows = [as_events(p) for p in parts]
    whole = rows[0]
    for part in rows[1:]:
        whole = whole.unionByName(part)
    return whole


def _tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape_rows(table(spark, sf_dir, "lineitem"))


def tape_rows(lines: DataFrame) -> DataFrame:
    """The tape from batch or streaming ``lineitem`` rows (projections only)."""
    day = F.expr(f"({micros('l_shipdate')} div 1000 - {TAPE_T0_MS}) div {DAY_MS}")
    rows = lines.withColumns(
        {
            "day": day,
            "tick": F.expr("(l_orderkey * 7 + l_linenumber) % 216000"),
            "cents": F.round(F.col("l_extendedprice") * 100).cast("long"),
            "qty": F.col("l_quantity").cast("long"),
            "tax": F.round(F.col("l_tax") * 100).cast("long"),
            "kind": F.expr(
                "case when l_returnflag = 'R' and l_linestatus = 'F' then 'position_liquidated'"
                " when l_returnflag = 'A' and l_linestatus = 'O' then 'position_opened'"
                " when l_returnflag = 'N' and l_linestatus = 'O' then 'collateral_deposit'"
                " when l_returnflag = 'A' and l_linestatus = 'F' then 'collateral_withdrawal' else 'maker_fill' end"
            ),
        }
    ).withColumn("price", F.expr("cents div qty"))
    flow, fill = _kinds("collateral_deposit", "collateral_withdrawal"), _kinds("maker_fill")
    opened, liquidated = _kinds("position_opened"), _kinds("position_liquidated")
    return as_events(
        rows.select(
            "kind",
            F.expr(f"{BASE_BLOCK} + day * {DAY_BLOCKS} + tick").alias("block_number"),
            F.expr(f"{TAPE_T0_MS} + day * {DAY_MS} + tick * 400").alias("timestamp_ms"),
            F.expr("l_partkey * 10 + l_linenumber").alias("log_index"),
            F.concat_ws("_", F.lit("0xl"), "l_orderkey", "l_linenumber", "l_suppkey").alias("tx_hash"),
            F.col("l_partkey").alias("account_id"),
            F.when(~flow, F.expr("1 + l_suppkey % 10")).alias("perpetual_id"),
            F.when(opened, F.expr("1 + l_linenumber % 2")).alias("position_type"),
            F.when(fill | opened, F.col("price")).alias("price_pns"),
            F.when(fill | opened, F.col("qty")).alias("lot_lns"),
            F.when(fill, F.expr("qty * tax")).alias("fee_cns"),
            F.when(opened, F.expr("qty * 2")).alias("ins_fee_cns"),
            F.when(opened, F.expr("qty * 5")).alias("prot_fee_cns"),
            F.when(liquidated, F.col("price")).alias("liq_price_pns"),
            F.when(liquidated, F.col("qty")).alias("liq_lot_lns"),
            F.when(liquidated, F.lit(0)).alias("end_lot_lns"),
            F.when(liquidated, F.lit(0)).alias("delta_pnl_cns"),
            F.when(liquidated, F.lit(0)).alias("funding_cns"),
            F.when(opened, F.col("cents")).when(liquidated, F.lit(0)).alias("deposit_cns"),
            F.when(flow, F.col("cents")).alias("amount_cns"),
            F.when(flow, F.col("cents")).alias("balance_cns"),
        )
    )


def supplied_marks(events: DataFrame, cut: AsOf) -> DataFrame:
    """Market state at a cutoff: the last price of each market, 0 to 80 seconds old."""
    seq = F.shiftleft("block_number", 31) + F.col("log_index")
    last = events.where((F.col("kind") == "mark_updated") & cut.includes()).groupBy("perpetual_id").agg(
        F.max_by("mark_price_pns", seq).alias("mark_pns")
    )
    older = F.col("perpetual_id") - 1
    return last.select(
        "perpetual_id",
        F.col("mark_pns").cast(DEC).alias("mark_pns"),
        F.lit(None).cast(DEC).alias("oracle_pns"),
        (F.lit(cut.block_number) - older * 50).cast("long").alias("block_number"),
        (F.lit(cut.timestamp_ms) - older * 20_000).cast("long").alias("timestamp_ms"),
        F.lit(None).cast("int").alias("log_index"),
        F.lit(None).cast("string").alias("block_hash"),
    )
