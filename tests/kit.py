"""Small hand-made inputs for the tests."""

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideledger.params import AsOf, Registry
from tideledger.schema import AMOUNT_COLUMNS, EVENT, MARK

CHAIN = 143
DEPLOYED = 54773010
EXCHANGE = "0x34B6552d57a35a1D042CcAe1951BD1C370112a6F"
UNIT = 65536 * 10**14


def market(pid, symbol, pd, sd, init, maint, listed=True):
    return dict(
        perpetual_id=pid, symbol=symbol, price_decimals=pd, size_decimals=sd,
        init_margin_frac_hdths=init, maint_margin_frac_hdths=maint, listed=listed,
    )


MARKETS = (
    market(1, "BTC", 1, 5, 1500, 2500),
    market(10, "MON", 6, 0, 1000, 2000),
    market(20, "ETH", 2, 3, 1200, 2000),
    market(30, "SOL-legacy", 3, 3, 1200, 2000, False),
    market(31, "SOL", 3, 3, 1200, 2000),
)


def registry(**over):
    base = dict(
        chain_id=CHAIN, exchange_address=EXCHANGE, deployed_at_block=DEPLOYED, collateral_decimals=6,
        markets=MARKETS, excluded=(30,),
    )
    return Registry(**{**base, **over})


def event(kind, block, log=0, ts=None, **fields):
    row = dict(
        chain_id=CHAIN, block_number=block, log_index=log, block_hash=f"0xb{block}", tx_hash=f"0xt{block}_{log}",
        timestamp_ms=ts if ts is not None else 1_770_000_000_000 + (block - DEPLOYED) * 400,
        contract_address=EXCHANGE, abi_event_name=kind, kind=kind,
    )
    row.update(fields)
    return row


def frame(spark, rows, schema=EVENT):
    def cell(field, value):
        if value is not None and isinstance(field.dataType, T.DecimalType):
            return Decimal(value)
        return value

    data = [{f.name: cell(f, r.get(f.name)) for f in schema.fields} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(schema)))


def marks_frame(spark, rows):
    return frame(spark, rows, MARK)


def as_of(block, log=None, ts=None, block_hash=None):
    return AsOf(
        CHAIN, block, block_hash or f"0xb{block}",
        ts if ts is not None else 1_770_000_000_000 + (block - DEPLOYED) * 400 + 399, log,
    )


def coins(units):
    return None if units is None else Decimal(int(units)) / Decimal(UNIT)


def open_increase_reduce_close():
    def pos(kind, block, **f):
        return event(kind, block, 0, account_id=42, perpetual_id=1, position_type=1, **f)

    def fill(block, price, lot, fee):
        return event("maker_fill", block, 1, account_id=7, perpetual_id=1, price_pns=price, lot_lns=lot, fee_cns=fee)

    return [
        event("account_created", 54773020, account_id=42, owner="0x" + "1" * 40),
        event("collateral_deposit", 54773021, account_id=42, amount_cns=20_000_000_000, balance_cns=20_000_000_000),
        pos("position_opened", 54773030, leverage_hdths=700, deposit_cns=10_000_000_000, price_pns=700000,
            lot_lns=100000, ins_fee_cns=0, prot_fee_cns=69000),
        fill(54773030, 700000, 100000, 9000),
        pos("position_increased", 54773040, leverage_hdths=700, price_pns=706667, start_lot_lns=100000,
            end_lot_lns=150000, start_deposit_cns=10_000_000_000, end_deposit_cns=13_600_000_000,
            ins_fee_cns=0, prot_fee_cns=34500),
        fill(54773040, 720000, 50000, 4500),
        pos("position_decreased", 54773060, start_lot_lns=150000, end_lot_lns=60000,
            start_deposit_cns=13_600_000_000, end_deposit_cns=5_440_000_000, delta_pnl_cns=299_970_000,
            funding_cns=1_500_000),
        fill(54773060, 710000, 90000, 8100),
        pos("position_closed", 54773080, price_pns=712000, delta_pnl_cns=319_980_000, funding_cns=500_000),
        fill(54773080, 712000, 60000, 5400),
    ]


def open_position():
    return [
        event("account_created", 54773020, account_id=42, owner="0x" + "1" * 40),
        event("position_opened", 54773030, 0, account_id=42, perpetual_id=1, position_type=1, leverage_hdths=700,
              deposit_cns=10_000_000_000, price_pns=700000, lot_lns=100000, ins_fee_cns=0, prot_fee_cns=69000),
        event("maker_fill", 54773030, 1, account_id=7, perpetual_id=1, price_pns=700000, lot_lns=100000, fee_cns=9000),
    ]


def liquidation():
    return [
        event("account_created", 54773020, account_id=99, owner="0x" + "2" * 40),
        event("position_opened", 54773030, 0, account_id=99, perpetual_id=1, position_type=1, leverage_hdths=1000,
              deposit_cns=7_000_000_000, price_pns=700000, lot_lns=100000, ins_fee_cns=10000, prot_fee_cns=59000),
        event("maker_fill", 54773030, 1, account_id=7, perpetual_id=1, price_pns=700000, lot_lns=100000, fee_cns=9000),
        event("position_liquidated", 54773070, 0, account_id=99, perpetual_id=1, position_type=1,
              liq_price_pns=625000, liq_lot_lns=100000, end_lot_lns=0, deposit_cns=0,
              delta_pnl_cns=-7_500_000_000, funding_cns=-2_000_000),
    ]
