"""Protocol flows per time window and point-in-time protocol state.

The windows are nested (each starts earlier than the one before and all end
at the cutoff), so an event is placed once, in the tightest window that holds
it, and window totals are sums over at most four small rows per market.  The
events are read once: partial sums per (market, account, window) also give the
exact distinct account counts, without expanding rows per window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from tideledger.functions.exact import Q16, UNIT_DIGITS, dec, known_sum, known_sum_where, pow10, ratio_ppm, units_from_native
from tideledger.operators.accounting import price_positions, require_marks
from tideledger.operators.checks import with_event_id
from tideledger.operators.ledger import kind_is, position_state, sequence
from tideledger.params import AsOf, Coverage, Registry
from tideledger.schema import LONG, RESET_KINDS, TRADING_KINDS

# Report windows and their length in milliseconds.
WINDOWS = {"24h": 86_400_000, "7d": 604_800_000, "30d": 2_592_000_000, "coverage": None}
FLOW_KINDS = ["collateral_deposit", "collateral_withdrawal"]
COUNTS = ["trades", "liquidations"]
VOLUMES = ["volume_native", "liquidation_native"]
FEES = ["fill_fees_cns", "protocol_fees_cns", "insurance_fees_cns", "deposits_cns", "withdrawals_cns"]


@dataclass(frozen=True)
class Window:
    id: str
    start_ms: int | None
    complete: bool
    basis: str

    @property
    def status(self) -> str:
        return "complete" if self.complete else "incomplete"


def report_windows(as_of: AsOf, basis: Coverage, registry: Registry) -> list[Window]:
    """The windows of a cutoff, each with proof of completeness or the reason against it."""
    from_deployment = basis.start_block <= registry.deployed_at_block
    found = []
    for name, length in WINDOWS.items():
        start = None if length is None else as_of.timestamp_ms - length
        if start is None:
            complete, why = True, "covered-range"
        elif from_deployment:
            complete, why = True, "deployment-history"
        elif basis.start_timestamp_ms is None:
            complete, why = False, "coverage-start-unobserved"
        elif basis.start_timestamp_ms <= start:
            complete, why = True, "observed-coverage-start"
        else:
            complete, why = False, "coverage-after-window-start"
        found.append(Window(name, start, complete, why))
    return found


def window_rank(windows: list[Window], timestamp="timestamp_ms") -> Column:
    """Index of the tightest window that holds the timestamp."""
    rank = F.lit(len(windows) - 1)
    for i in reversed(range(len(windows))):
        if windows[i].start_ms is not None:
            rank = F.when(F.col(timestamp) >= windows[i].start_ms, F.lit(i)).otherwise(rank)
    return rank


def measures() -> dict[str, Column]:
    """Per-event contributions in native integers; scales are applied after grouping."""
    zero = dec(0)

    def pick(condition: Column, value: Column) -> Column:
        return F.when(condition, F.coalesce(value, zero))

    fill, liquidated, resets = kind_is("maker_fill"), kind_is("position_liquidated"), kind_is(*RESET_KINDS)
    protocol = F.coalesce(F.col("ins_fee_cns"), zero) + F.coalesce(F.col("prot_fee_cns"), zero)
    return {
        "volume_native": pick(fill, F.col("price_pns") * F.col("lot_lns")),
        "liquidation_native": pick(liquidated, F.col("liq_price_pns") * F.col("liq_lot_lns")),
        "fill_fees_cns": pick(fill, F.col("fee_cns")),
        "protocol_fees_cns": F.when(resets, protocol),
        "insurance_fees_cns": pick(resets, F.col("ins_fee_cns")),
        "deposits_cns": pick(kind_is("collateral_deposit"), F.col("amount_cns")),
        "withdrawals_cns": pick(kind_is("collateral_withdrawal"), F.col("amount_cns")),
        "trades": F.when(fill, F.lit(1)),
        "liquidations": F.when(liquidated, F.lit(1)),
    }


def negative_flows(events: DataFrame, as_of: AsOf) -> DataFrame:
    return with_event_id(events).where(kind_is(*FLOW_KINDS) & as_of.includes() & (F.col("amount_cns") < 0))


def account_flows(events: DataFrame, as_of: AsOf, rank: Column) -> DataFrame:
    """Partial sums per (market, account, window rank): the only pass over the events."""
    kept = events.where(kind_is(*TRADING_KINDS, *FLOW_KINDS) & as_of.includes())
    trading = kind_is(*TRADING_KINDS)
    return (
        kept.groupBy("perpetual_id", "account_id", rank.alias("rank"))
        .agg(
            *[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in measures().items()],
            F.max(F.when(trading & F.col("account_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))).alias("active"),
            F.max(F.when(trading, F.lit(1)).otherwise(F.lit(0))).alias("traded"),
        )
    )


def rank_flows(partial: DataFrame) -> DataFrame:
    """Sums per (market, window rank) with accounts counted at their first rank.

    An account has at most one row per market and rank here, so the windows
    over an account are bounded by the registry.  ``accounts`` counts an account
    once per market, ``everyone`` once in all.
    """
    active = F.col("active") == 1
    place = F.struct("rank", F.coalesce("perpetual_id", F.lit(-1)).alias("m"))
    by_market = SparkWindow.partitionBy("account_id", "perpetual_id")
    by_account = SparkWindow.partitionBy("account_id")
    flagged = partial.withColumns(
        {
            "first_in_market": active & (F.col("rank") == F.min(F.when(active, F.col("rank"))).over(by_market)),
            "first_of_all": active & (place == F.min(F.when(active, place)).over(by_account)),
        }
    )
    return flagged.groupBy("perpetual_id", "rank").agg(
        *[F.sum(c).alias(c) for c in [*VOLUMES, *FEES, *COUNTS]],
        F.count(F.when(F.col("first_in_market"), F.lit(1))).alias("accounts"),
        F.count(F.when(F.col("first_of_all"), F.lit(1))).alias("everyone"),
        F.max("traded").alias("traded"),
    )


def scaled(sums: DataFrame, registry: Registry) -> DataFrame:
    """Apply market scales to grouped native sums."""
    cns = F.lit(registry.collateral_decimals)
    factor = dec(Q16) * pow10(F.lit(UNIT_DIGITS) - F.col("price_decimals") - F.col("size_decimals"))
    return sums.withColumns(
        {
            "taker_volume_u": F.coalesce(F.col("volume_native") * factor, dec(0)),
            "liquidation_notional_u": F.coalesce(F.col("liquidation_native") * factor, dec(0)),
            **{c.replace("_cns", "_u"): units_from_native(F.col(c), cns) for c in FEES},
        }
    ).drop(*VOLUMES, *FEES)


FLOW_COLUMNS = [
    "taker_volume_u", "trades", "fill_fees_u", "protocol_fees_u", "insurance_fees_u", "liquidations",
    "liquidation_notional_u",
]


def window_flows(events: DataFrame, registry: Registry, as_of: AsOf, windows: list[Window]) -> tuple[DataFrame, DataFrame]:
    """(totals per window, flows per window and market).

    Totals of an incomplete window are null and it has no market rows.
    """
    spark = events.sparkSession
    last = len(windows) - 1
    per_rank = rank_flows(account_flows(events, as_of, window_rank(windows)))
    listed = registry.listed(spark)
    cns = F.lit(registry.collateral_decimals)
    steps = F.explode(F.sequence(F.col("rank"), F.lit(last))).alias("window")
    market_rows = (
        scaled(registry.attach(per_rank.where("traded = 1")), registry)
        .select("perpetual_id", "symbol", "accounts", *FLOW_COLUMNS, steps)
        .groupBy("window", "perpetual_id", "symbol")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FLOW_COLUMNS], F.sum("accounts").alias("active_accounts"))
    )
    money = ["deposits_u", "withdrawals_u"]
    known = per_rank.join(listed, "perpetual_id", "left")
    priced = scaled(known.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("price_decimals", "size_decimals")}), registry)
    in_registry = F.col("symbol").isNotNull()
    small = (
        priced.select(
            F.col("everyone").alias("accounts"), *[F.when(in_registry, F.col(c)).alias(c) for c in FLOW_COLUMNS], *money, steps
        )
        .groupBy("window")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*FLOW_COLUMNS, *money]],
            F.coalesce(F.sum("accounts"), F.lit(0)).alias("active_accounts"),
        )
    )
    names = F.element_at(F.array(*[F.lit(w.id) for w in windows]), F.col("window") + 1)
    complete = F.element_at(F.array(*[F.lit(w.complete) for w in windows]), F.col("window") + 1)
    frame = spark.range(len(windows)).select(F.col("id").cast("int").alias("window"))
    amounts = [*FLOW_COLUMNS, *money]
    filled = frame.join(F.broadcast(small), "window", "left").select(
        names.alias("window"),
        F.when(complete, "complete").otherwise("incomplete").alias("status"),
        *[F.when(complete, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in [*amounts, "active_accounts"]],
    )
    totals = filled.withColumn("net_flow_u", F.col("deposits_u") - F.col("withdrawals_u"))
    markets = market_rows.where(complete).withColumn("window", names)
    return totals, markets


def window_events(events: DataFrame, as_of: AsOf, windows: list[Window]) -> DataFrame:
    """Event count, first and last event of each window."""
    kept = with_event_id(events.where(as_of.includes()))
    point = F.struct("event_id", sequence().alias("seq"))
    ranked = kept.groupBy(window_rank(windows).alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(point, sequence()).alias("lo"), F.max_by(point, sequence()).alias("hi")
    )
    grown = ranked.select("n", "lo", "hi", F.explode(F.sequence(F.col("rank"), F.lit(len(windows) - 1))).alias("w"))
    names = F.element_at(F.array(*[F.lit(w.id) for w in windows]), F.col("w") + 1)
    return grown.groupBy("w").agg(
        F.sum("n").alias("event_count"),
        F.min_by("lo.event_id", "lo.seq").alias("first_event_id"),
        F.max_by("hi.event_id", "hi.seq").alias("last_event_id"),
    ).select(names.alias("window"), "event_count", "first_event_id", "last_event_id")


def state_positions(events: DataFrame, marks: DataFrame, registry: Registry, as_of: AsOf) -> DataFrame:
    return price_positions(position_state(events, as_of), marks, registry, as_of).where("is_open")


def market_state(positions: DataFrame) -> DataFrame:
    """Open interest, collateral and skew per market from priced open positions."""
    open_rows = positions.where("is_open")
    grouped = open_rows.groupBy("perpetual_id", "symbol").agg(
        F.count(F.lit(1)).alias("open_positions"),
        F.bool_and(F.col("notional_u").isNotNull()).alias("priced"),
        known_sum_where(F.col("side") == LONG, F.col("notional_u")).alias("long_u"),
        known_sum_where(F.col("side") != LONG, F.col("notional_u")).alias("short_u"),
        F.sum("deposit_u").alias("collateral_u"),
        F.max("mark_pns").alias("mark_pns"),
        F.max("mark_event_id").alias("mark_event_id"),
    )
    known = F.col("priced")
    rows = grouped.withColumns(
        {"long_u": F.when(known, F.col("long_u")), "short_u": F.when(known, F.col("short_u"))}
    )
    return rows.withColumns(
        {
            "open_interest_u": F.col("long_u") + F.col("short_u"),
            "skew_ppm": skew("long_u", "short_u"),
            "status": F.when(known, "complete").otherwise("mark-unavailable"),
        }
    ).drop("priced")


def skew(long_side: str, short_side: str) -> Column:
    return ratio_ppm(F.col(long_side) - F.col(short_side), F.col(long_side) + F.col(short_side))


def protocol_state(markets: DataFrame, basis: Coverage, registry: Registry) -> DataFrame:
    """One row of protocol totals; unavailable unless history starts at deployment."""
    totals = markets.agg(
        F.coalesce(F.sum("open_positions"), F.lit(0)).alias("open_positions"),
        known_sum(F.col("long_u")).alias("long_u"),
        known_sum(F.col("short_u")).alias("short_u"),
        F.coalesce(F.sum("collateral_u"), dec(0)).alias("collateral_u"),
        F.coalesce(F.bool_and(F.col("status") == "complete"), F.lit(True)).alias("complete"),
    )
    proven = F.lit(basis.start_block <= registry.deployed_at_block)
    amounts = ["open_positions", "long_u", "short_u", "collateral_u"]
    rows = totals.select(
        F.when(~proven, "unavailable").when(F.col("complete"), "complete").otherwise("partial").alias("status"),
        F.when(proven, "deployment-history").otherwise("bounded-coverage").alias("basis"),
        *[F.when(proven, F.col(c)).alias(c) for c in amounts],
    )
    return rows.withColumns(
        {"open_interest_u": F.col("long_u") + F.col("short_u"), "skew_ppm": skew("long_u", "short_u")}
    )


def market_coverage(flows: DataFrame, states: DataFrame) -> DataFrame:
    """Flow rows and state rows of one window merged per market; a missing side is 0 or null."""
    right = states.select("perpetual_id", F.col("symbol").alias("s_symbol"), "open_interest_u", "skew_ppm", "open_positions")
    joined = flows.join(right, "perpetual_id", "full_outer")
    zero = [*FLOW_COLUMNS, "active_accounts", "open_positions"]
    return joined.select(
        "perpetual_id",
        F.coalesce("symbol", "s_symbol").alias("symbol"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero],
        "open_interest_u",
        "skew_ppm",
    )


def protocol_metrics(
    events: DataFrame,
    positions: DataFrame,
    registry: Registry,
    as_of: AsOf,
    window_start_ms: int | None = None,
    *,
    strict: bool = True,
) -> DataFrame:
    """Per-market volume, open interest, value locked and active accounts.

    Here an account is active when any event names it with a market, or when
    it holds an open position; the window flows above count trading only.
    """
    if strict:
        require_marks(positions)
    kept = events.where(as_of.includes() & F.col("perpetual_id").isNotNull())
    if window_start_ms is not None:
        kept = kept.where(F.col("timestamp_ms") >= window_start_ms)
    wanted = [*VOLUMES, "fill_fees_cns", "protocol_fees_cns", "insurance_fees_cns", *COUNTS]
    parts = kept.groupBy("perpetual_id", "account_id").agg(
        *[F.coalesce(F.sum(measures()[c]), F.lit(0)).alias(c) for c in wanted]
    )
    held = positions.where("is_open").select(
        "perpetual_id", "account_id", F.col("notional_u").alias("open_interest_u"), F.col("deposit_u").alias("tvl_u")
    )
    both = parts.unionByName(held, allowMissingColumns=True)
    per_account = both.groupBy("perpetual_id", "account_id").agg(
        *[F.sum(c).alias(c) for c in [*wanted, "open_interest_u", "tvl_u"]]
    )
    grouped = per_account.groupBy("perpetual_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*wanted, "open_interest_u", "tvl_u"]],
        F.count("account_id").alias("active_accounts"),
    )
    priced = registry.attach(grouped.where("perpetual_id is not null"))
    full = priced.withColumns({"deposits_cns": dec(0), "withdrawals_cns": dec(0)})
    return (
        scaled(full, registry)
        .withColumn("zero_volume_warning", F.col("taker_volume_u") == 0)
        .select(
            "perpetual_id", "symbol", "taker_volume_u", "open_interest_u", "tvl_u", "protocol_fees_u",
            "insurance_fees_u", "fill_fees_u", "liquidations", "liquidation_notional_u", "active_accounts",
            "zero_volume_warning",
        )
    )


def event_histogram(events: DataFrame, as_of: AsOf, start_ms: int | None = None) -> DataFrame:
    kept = events.where(as_of.includes())
    if start_ms is not None:
        kept = kept.where(F.col("timestamp_ms") >= start_ms)
    return kept.groupBy("abi_event_name").agg(F.count(F.lit(1)).alias("events"))
