"""The position ledger as ordered column expressions.

Every lifecycle event carries its own after-state, so the fold over events is
"last known value so far" and "sum so far" per position.  ``position_history``
adds them row by row; ``position_state`` gets the final state from one
aggregation with map-side partials and no sort of whole positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.functions.exact import dec
from tideledger.operators.checks import exploded, with_event_id
from tideledger.operators.running import RANGE_WIDTH, running
from tideledger.params import AsOf
from tideledger.schema import LONG, POSITION_KINDS, RESET_KINDS, SETTLE_KINDS

POSITION = ["account_id", "perpetual_id"]
ORDER = ["block_number", "log_index"]
STATUS_OF_END = {
    "position_decreased": "closed",
    "position_liquidated": "liquidated",
    "position_deleveraged": "deleveraged",
}


def sequence(block="block_number", log="log_index") -> Column:
    """Block and log packed into one long: a primitive key for max_by/min_by."""
    return F.shiftleft(F.col(block), 31) + F.col(log)


def kind_is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def position_events(events: DataFrame, as_of: AsOf) -> DataFrame:
    return with_event_id(events.where(kind_is(*POSITION_KINDS) & as_of.includes()))


def set_values() -> dict[str, Column]:
    """What an event sets; null means the earlier value stays."""
    end_lot, zero = F.col("end_lot_lns"), dec(0)
    end_kinds = ["position_increased", "position_inverted", *STATUS_OF_END]
    closing = kind_is("position_closed", "position_unwound")
    left_open = kind_is(*STATUS_OF_END) & (end_lot > 0)
    status = (
        F.when(kind_is(*RESET_KINDS) | left_open, F.lit("open"))
        .when(kind_is("position_closed"), F.lit("closed"))
        .when(kind_is("position_unwound"), F.lit("unwound"))
    )
    for kind, name in STATUS_OF_END.items():
        status = status.when(kind_is(kind), F.lit(name))
    new_price = kind_is(*RESET_KINDS) | (kind_is("collateral_decreased") & F.col("price_pns").isNotNull())
    residue = F.when(
        kind_is("position_opened", "position_increased"), F.coalesce(F.col("price_residue_pnsq16"), F.lit(0))
    ).otherwise(F.lit(0))
    return {
        "lot_lns": F.when(kind_is("position_opened"), F.col("lot_lns"))
        .when(closing, zero)
        .when(kind_is(*end_kinds), end_lot),
        "deposit_cns": F.when(closing | (kind_is(*STATUS_OF_END) & (end_lot == 0)), zero)
        .when(kind_is("position_opened", "position_liquidated", "collateral_increased"), F.col("deposit_cns"))
        .otherwise(F.col("end_deposit_cns")),
        "side": F.when(kind_is("position_opened", "position_inverted"), F.col("position_type")),
        "entry_pns": F.when(new_price, F.col("price_pns")),
        "entry_residue": F.when(new_price, residue),
        "leverage_hdths": F.when(kind_is("position_opened"), F.coalesce(F.col("leverage_hdths"), F.lit(0))).when(
            kind_is("position_increased", "position_inverted"), F.col("leverage_hdths")
        ),
        "status": status,
        "opened_block": F.when(kind_is("position_opened"), F.col("block_number")),
        "ended_block": F.when(status != "open", F.col("block_number")),
        "last_event_id": F.when(~kind_is("collateral_increased", "collateral_decreased"), F.col("event_id")),
        "last_event_ms": F.when(~kind_is("collateral_increased", "collateral_decreased"), F.col("timestamp_ms")),
    }


def added_values() -> dict[str, Column]:
    """What an event adds to the lifetime totals of its position."""
    settling = kind_is(*SETTLE_KINDS, "position_inverted", "position_closed", "position_unwound")
    fees = F.coalesce(F.col("ins_fee_cns"), dec(0)) + F.coalesce(F.col("prot_fee_cns"), dec(0))
    return {
        "realized_pnl_cns": F.when(settling, F.col("delta_pnl_cns")),
        "realized_funding_cns": F.when(settling | kind_is("position_increased"), F.col("funding_cns")),
        "fees_cns": F.when(kind_is(*RESET_KINDS), fees),
    }


def _finish(df: DataFrame) -> DataFrame:
    is_open = (F.col("status") == "open") & (F.col("lot_lns") > 0)
    return df.withColumns(
        {
            "is_open": F.coalesce(is_open, F.lit(False)),
            "closed_block": F.when(F.col("status") != "open", F.col("ended_block")),
        }
    ).drop("ended_block")


HISTORY_EVENT = ["chain_id", *POSITION, *ORDER, "timestamp_ms", "event_id", "kind"]


def position_history(
    events: DataFrame,
    as_of: AsOf,
    *,
    extra: list[str] | None = None,
    range_width: int = RANGE_WIDTH,
) -> DataFrame:
    """State of a position after each of its events, with the state before it.

    ``extra`` names columns already joined to the events (for example funding
    totals at the event block); their value at the next event is added.
    """
    extra = extra or []
    found = position_events(events, as_of)
    sets, adds = set_values(), added_values()
    tracked = found.select(
        *HISTORY_EVENT,
        *extra,
        *[e.alias(f"set_{n}") for n, e in sets.items()],
        *[e.alias(f"add_{n}") for n, e in adds.items()],
        F.when(kind_is(*RESET_KINDS), F.lit(1)).alias("add_span"),
        *[F.col(c).alias(f"evt_{c}") for c in ("position_type", "start_lot_lns", "start_deposit_cns", "end_lot_lns")],
        F.when(kind_is(*SETTLE_KINDS), F.col("funding_cns")).alias("settled_cns"),
    )
    full = running(
        tracked,
        POSITION,
        [*ORDER, "event_id"],
        lasts={n: F.col(f"set_{n}") for n in sets},
        sums={n: F.col(f"add_{n}") for n in adds} | {"span": F.col("add_span")},
        before={f"prev_{n}": F.col(f"set_{n}") for n in ("lot_lns", "deposit_cns", "side", "status")},
        leads={"next_block": F.col("block_number")} | {f"next_{c}": F.col(c) for c in extra},
        range_width=range_width,
    )
    full = full.drop(*[f"set_{n}" for n in sets], *[f"add_{n}" for n in adds], "add_span")
    return _finish(full)


def transition_rules() -> dict[str, Column]:
    """Broken transitions of a history row against the state before it."""
    was_open = F.coalesce((F.col("prev_status") == "open") & (F.col("prev_lot_lns") > 0), F.lit(False))
    needs_open = F.col("kind") != "position_opened"
    starts = kind_is(
        "position_increased", "position_decreased", "position_deleveraged", "position_inverted"
    )
    deposit_starts = starts | kind_is("position_liquidation_credit", "collateral_decreased")
    side = F.col("evt_position_type")
    # Reductions and collateral moves that leave the position open must leave it sound.
    checked = F.col("status").eqNullSafe("open") & ~kind_is("collateral_increased", "collateral_decreased")
    return {
        "already_open": (F.col("kind") == "position_opened") & was_open,
        "no_open_position": needs_open & ~was_open,
        "start_lot_differs": starts & was_open & (F.col("evt_start_lot_lns") != F.col("prev_lot_lns")),
        "start_deposit_differs": deposit_starts & was_open & (F.col("evt_start_deposit_cns") != F.col("prev_deposit_cns")),
        "increase_not_larger": kind_is("position_increased") & (F.col("evt_end_lot_lns") <= F.col("prev_lot_lns")),
        "decrease_not_smaller": kind_is("position_decreased") & (F.col("evt_end_lot_lns") >= F.col("prev_lot_lns")),
        "inversion_keeps_side": kind_is("position_inverted") & (side == F.col("prev_side")),
        "side_differs": needs_open & ~kind_is("position_inverted") & was_open & (side != 0) & (side != F.col("prev_side")),
        "open_size_not_positive": checked & (F.col("lot_lns") <= 0),
        "open_deposit_negative": checked & (F.col("deposit_cns") < 0),
        "open_entry_not_positive": checked & (F.col("entry_pns") <= 0),
    }


def transition_violations(history: DataFrame) -> DataFrame:
    return exploded(history, [*POSITION, "event_id", "kind"], transition_rules())


def history_state(history: DataFrame) -> DataFrame:
    """Final state per position: the history row that has no next event."""
    return history.where(F.col("next_block").isNull())


def position_state(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Final state per position by aggregation alone (no window)."""
    found = position_events(events, as_of).withColumn("_seq", sequence())
    final = [
        F.max_by(value, F.when(value.isNotNull(), F.col("_seq"))).alias(name) for name, value in set_values().items()
    ]
    totals = [F.coalesce(F.sum(value), dec(0)).alias(name) for name, value in added_values().items()]
    return _finish(found.groupBy(*POSITION).agg(*final, *totals, F.max("block_number").alias("last_block")))


def validity_intervals(history: DataFrame, as_of: AsOf) -> DataFrame:
    """Blocks [valid_from, valid_to) during which each state was in force."""
    return history.select(
        *POSITION,
        "event_id",
        F.col("block_number").alias("valid_from"),
        F.coalesce("next_block", F.lit(as_of.block_number + 1)).alias("valid_to"),
        "lot_lns",
        "side",
        "is_open",
    )


def account_state(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Balance, owner and last event per account, by aggregation alone."""
    found = with_event_id(events.where(F.col("account_id").isNotNull() & as_of.includes()))
    found = found.withColumn("_seq", sequence())
    created = F.col("kind") == "account_created"
    # Creation resets the balance to zero unless the event carries one itself.
    balance = F.coalesce(F.col("balance_cns"), F.when(created, dec(0)))
    return found.groupBy("account_id").agg(
        F.max_by("owner", F.when(created, F.col("_seq"))).alias("owner"),
        F.coalesce(F.max_by(balance, F.when(balance.isNotNull(), F.col("_seq"))), dec(0)).alias("balance_cns"),
        F.max_by("event_id", "_seq").alias("last_event_id"),
        F.max("block_number").alias("last_block"),
        F.count(F.lit(1)).alias("event_count"),
    )


def fill_log(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Maker and taker fills inside the cutoff."""
    return with_event_id(events.where(kind_is("maker_fill", "taker_fill") & as_of.includes())).select(
        "event_id",
        "perpetual_id",
        "account_id",
        F.when(F.col("kind") == "maker_fill", "maker").otherwise("taker").alias("liquidity"),
        "price_pns",
        "lot_lns",
        "fee_cns",
        "block_number",
        "timestamp_ms",
    )


def latest_marks(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Last mark of each market with the event it came from."""
    found = with_event_id(events.where(kind_is("mark_updated") & as_of.includes()))
    newest = F.max_by(
        F.struct(
            F.col("mark_price_pns").alias("mark_pns"), "block_number", "timestamp_ms", "log_index", "block_hash",
            F.col("event_id").alias("mark_event_id"),
        ),
        sequence(),
    )
    return found.groupBy("perpetual_id").agg(newest.alias("m")).select("perpetual_id", "m.*")


def latest_event(events: DataFrame, as_of: AsOf) -> DataFrame:
    """The newest event of the whole scope, one row."""
    found = with_event_id(events.where(as_of.includes()))
    newest = F.max_by(
        F.struct("event_id", "block_number", "log_index", "timestamp_ms", "kind"), sequence()
    )
    return found.agg(newest.alias("e")).where("e is not null").select("e.*")


def signed_lot(lot="lot_lns", side="side") -> Column:
    """Lot with the sign of the holder's gain when the price rises."""
    return F.when(F.col(side) == LONG, F.col(lot)).otherwise(-F.col(lot))
