"""Point-in-time accounting: position risk, wallets and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.functions.exact import (
    Q16,
    UNIT_DIGITS,
    dec,
    known_sum,
    known_sum_where,
    pow10,
    trunc_div,
    units_from_native,
)
from tideledger.operators.checks import mark_is_fresh, mark_violations, require_clean, with_event_id
from tideledger.operators.funding import funded_history, funded_state
from tideledger.operators.ledger import POSITION, account_state, latest_marks, position_state
from tideledger.params import AsOf, Coverage, FundingScope, Registry
from tideledger.schema import LONG, MARKET_PROFILE, REPLAY_PROFILES


def entry_q16(entry="entry_pns", residue="entry_residue", side="side") -> Column:
    """Effective entry in 1/65536 price ticks; a long's stored price is rounded up."""
    base = F.when(
        (F.col(residue) > 0) & (F.col(side) == LONG), F.col(entry) - dec(1)
    ).otherwise(F.col(entry))
    return base * dec(Q16) + F.col(residue)


def amount_factor() -> Column:
    """Units per (price tick / 65536) times lot, from the joined market scales."""
    return pow10(F.lit(UNIT_DIGITS) - F.col("price_decimals") - F.col("size_decimals"))


def side_sign(side="side") -> Column:
    return F.when(F.col(side) == LONG, dec(1)).otherwise(dec(-1))


def price_pnl(mark: Column, entry: Column, lot: Column, factor: Column) -> Column:
    return (mark * dec(Q16) - entry) * lot * side_sign() * factor


def notional(price: Column, lot: Column, factor: Column) -> Column:
    """Price ticks times lots in units; a product beyond 38 digits raises."""
    return dec(price) * dec(lot) * dec(Q16) * factor


def maintenance_margin(entry_notional: Column, maint_hdths: Column) -> Column:
    return trunc_div(entry_notional * dec(100), maint_hdths)


def liquidation_price(entry_notional: Column, funding_u: Column) -> Column:
    """Price in units at which equity meets maintenance, never below zero.

    Null funding stays null: ``greatest`` would otherwise turn it into 0.
    """
    maint, lot = dec(F.col("maint_margin_frac_hdths")), F.col("lot_lns")
    entry_u = entry_q16() * pow10(F.lit(UNIT_DIGITS) - F.col("price_decimals"))
    numerator = (entry_notional * dec(100) - (F.col("deposit_u") + funding_u) * maint) * pow10(F.col("size_decimals"))
    gap = trunc_div(numerator, maint * lot)
    price = entry_u + side_sign() * gap
    return F.when(price.isNotNull(), F.greatest(price, dec(0)))


def effective_marks(events: DataFrame, supplied: DataFrame | None, as_of: AsOf) -> DataFrame:
    """One mark per market: canonical marks win over supplied ones of the same market."""
    canonical = latest_marks(events, as_of).withColumn("oracle_pns", F.lit(None).cast("decimal(38,0)"))
    if supplied is None:
        return canonical
    extra = supplied.join(canonical, "perpetual_id", "left_anti").withColumn(
        "mark_event_id", F.lit(None).cast("string")
    )
    return canonical.unionByName(extra)


def mark_conflicts(events: DataFrame, supplied: DataFrame, as_of: AsOf) -> DataFrame:
    """Supplied marks of markets whose canonical mark is another one."""
    fields = ("mark_pns", "block_number", "timestamp_ms")
    mine = latest_marks(events, as_of).select("perpetual_id", *[F.col(c).alias(f"c_{c}") for c in fields])
    differs = ~F.col("mark_pns").eqNullSafe(F.col("c_mark_pns"))
    for c in fields[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"c_{c}"))
    return supplied.join(mine, "perpetual_id").where(differs)


def attach_source_event(marks: DataFrame, canonical: DataFrame) -> DataFrame:
    """Event id behind a supplied mark, only if it equals the canonical mark."""
    mine = canonical.select(
        "perpetual_id", *[F.col(c).alias(f"c_{c}") for c in ("mark_pns", "block_number", "timestamp_ms", "mark_event_id")]
    )
    same = (
        (F.col("mark_pns") == F.col("c_mark_pns"))
        & (F.col("block_number") == F.col("c_block_number"))
        & (F.col("timestamp_ms") == F.col("c_timestamp_ms"))
    )
    # Marks hold one row per registry market, so this side is bounded.
    joined = marks.drop("mark_event_id").join(F.broadcast(mine), "perpetual_id", "left")
    return joined.withColumn("mark_event_id", F.when(same, F.col("c_mark_event_id"))).select(
        *[c for c in marks.columns if c != "mark_event_id"], "mark_event_id"
    )


def with_marks(positions: DataFrame, marks: DataFrame, as_of: AsOf) -> DataFrame:
    """Left join of positions with the fresh mark of their market."""
    columns = {c: F.col(c) for c in marks.columns}
    side = marks.select(
        "perpetual_id",
        F.col("mark_pns").alias("seen_mark_pns"),
        (F.lit(as_of.timestamp_ms) - F.col("timestamp_ms")).alias("mark_age_ms"),
        mark_is_fresh(as_of).alias("mark_fresh"),
        (F.col("mark_event_id") if "mark_event_id" in columns else F.lit(None).cast("string")).alias("seen_event_id"),
    )
    # At most one mark per registry market: bounded by MAX_REGISTRY_MARKETS.
    joined = positions.join(F.broadcast(side), "perpetual_id", "left")
    usable = F.coalesce(F.col("mark_fresh"), F.lit(False)) & F.col("is_open")
    return joined.withColumns(
        {
            "mark_pns": F.when(usable, F.col("seen_mark_pns")),
            "mark_event_id": F.when(usable, F.col("seen_event_id")),
        }
    )


def price_positions(state: DataFrame, marks: DataFrame, registry: Registry, as_of: AsOf) -> DataFrame:
    """Risk columns of every position; ``state`` may carry ``unsettled_u``."""
    if "unsettled_u" not in state.columns:
        state = state.withColumns(
            {
                "unsettled_u": F.when(F.col("is_open"), F.lit(None)).otherwise(dec(0)).cast("decimal(38,0)"),
                "funding_reason": F.lit("no-funding-scope"),
            }
        )
    listed = registry.listed(state.sparkSession)
    # Only marks of registry markets, so the broadcast mark side is bounded.
    known_marks = marks.join(listed.select("perpetual_id"), "perpetual_id", "left_semi")
    joined = registry.attach(with_marks(state, known_marks, as_of))
    is_open = F.col("is_open")
    cns = F.lit(registry.collateral_decimals)
    basic = joined.withColumns(
        {
            "deposit_u": units_from_native(F.col("deposit_cns"), cns),
            "realized_pnl_u": units_from_native(F.col("realized_pnl_cns"), cns),
            "realized_funding_u": units_from_native(F.col("realized_funding_cns"), cns),
            "fees_u": units_from_native(F.col("fees_cns"), cns),
            "entry_notional_u": F.when(is_open, entry_q16() * F.col("lot_lns") * amount_factor()),
            "notional_u": F.when(is_open, notional(F.col("mark_pns"), F.col("lot_lns"), amount_factor())),
            "price_pnl_u": F.when(
                is_open, price_pnl(F.col("mark_pns"), entry_q16(), F.col("lot_lns"), amount_factor())
            ).otherwise(dec(0)),
            "mark_u": units_from_native(F.col("mark_pns"), F.col("price_decimals")),
        }
    )
    funding = F.when(is_open, F.col("unsettled_u"))
    risk = basic.withColumns(
        {
            "maintenance_u": maintenance_margin(F.col("entry_notional_u"), F.col("maint_margin_frac_hdths")),
            "liquidation_u": F.when(is_open, liquidation_price(F.col("entry_notional_u"), funding)),
            "zero_funding_liquidation_u": F.when(is_open, liquidation_price(F.col("entry_notional_u"), dec(0))),
            "zero_funding_equity_u": F.when(is_open, F.col("deposit_u") + F.col("price_pnl_u")),
            "total_pnl_u": F.when(is_open, F.col("price_pnl_u") + F.col("unsettled_u")).otherwise(dec(0)),
        }
    )
    risk = risk.withColumns(
        {
            "equity_u": F.col("zero_funding_equity_u") + funding,
            "zero_funding_buffer_u": F.col("zero_funding_equity_u") - F.col("maintenance_u"),
        }
    )
    return risk.withColumns(
        {
            "buffer_u": F.col("equity_u") - F.col("maintenance_u"),
            "risk_status": risk_status(),
            "side_name": F.when(F.col("side") == LONG, "long").otherwise("short"),
            "warnings": position_warnings(as_of),
        }
    )


def risk_status() -> Column:
    return (
        F.when(~F.col("is_open"), "closed")
        .when(F.col("unsettled_u").isNull(), "funding-unverified")
        .when(F.col("mark_pns").isNull(), "marks-unavailable")
        .otherwise("canonical-funding-covered")
    )


def position_warnings(as_of: AsOf) -> Column:
    market = F.col("perpetual_id").cast("string")
    is_open = F.col("is_open")
    missing = F.concat(F.lit("market "), market, F.lit(f" has no price up to block {as_of.block_number}"))
    stale = F.concat(
        F.lit("the price of market "), market, F.lit(f" is too old at block {as_of.block_number}, by milliseconds: "),
        F.col("mark_age_ms").cast("string"),
    )
    return F.array_compact(
        F.array(
            F.when(is_open & F.col("unsettled_u").isNull(), F.concat(F.lit("funding since the last settlement unknown: "), F.col("funding_reason"))),
            F.when(is_open & F.col("seen_mark_pns").isNull(), missing),
            F.when(is_open & F.col("seen_mark_pns").isNotNull() & F.col("mark_pns").isNull(), stale),
        )
    )


def require_marks(positions: DataFrame) -> None:
    """Strict use: every open position needs a fresh mark."""
    require_clean(
        positions.where(F.col("is_open") & F.col("mark_pns").isNull()).select(*POSITION),
        "missing or stale as-of mark",
    )


def position_risk(
    events: DataFrame,
    registry: Registry,
    as_of: AsOf,
    scope: FundingScope | None = None,
    supplied_marks: DataFrame | None = None,
    *,
    strict: bool = False,
) -> DataFrame:
    """Full risk row for every position at the cutoff."""
    marks = effective_marks(events, supplied_marks, as_of)
    if strict:
        require_clean(mark_violations(marks, as_of), "inconsistent as-of mark")
    if scope is None:
        state = position_state(events, as_of)
    else:
        state = funded_state(funded_history(events, registry, as_of, scope), registry, scope)
    return price_positions(state, marks, registry, as_of)


def wallet_totals(positions: DataFrame) -> DataFrame:
    """Totals per account; an unknown input makes its total unknown."""
    return positions.groupBy("account_id").agg(
        F.sum("realized_pnl_u").alias("realized_pnl_u"),
        F.sum("realized_funding_u").alias("realized_funding_u"),
        F.sum("fees_u").alias("fees_u"),
        known_sum(F.col("price_pnl_u")).alias("price_pnl_u"),
        known_sum(F.col("unsettled_u")).alias("unsettled_u"),
        known_sum(F.col("total_pnl_u")).alias("total_pnl_u"),
        F.count(F.when(F.col("is_open"), F.lit(1))).alias("open_positions"),
        F.count(F.when(F.col("status") != "open", F.lit(1))).alias("closed_positions"),
        known_sum_where(F.col("is_open"), F.col("notional_u")).alias("open_notional_u"),
        F.coalesce(F.sum(F.when(F.col("is_open"), F.col("deposit_u"))), dec(0)).alias("open_collateral_u"),
        F.count(F.lit(1)).alias("positions"),
        F.sum(F.size("warnings")).alias("warning_count"),
        F.bool_and(~F.col("is_open") | F.col("mark_pns").isNotNull()).alias("all_marked"),
        F.bool_and(~F.col("is_open") | F.col("unsettled_u").isNotNull()).alias("all_funded"),
    )


def wallets(events: DataFrame, positions: DataFrame, registry: Registry, as_of: AsOf) -> DataFrame:
    """Every account with its balance and totals, also those without positions."""
    cns = F.lit(registry.collateral_decimals)
    accounts = account_state(events, as_of).select(
        "account_id", "owner", units_from_native(F.col("balance_cns"), cns).alias("free_balance_u"), "last_event_id"
    )
    joined = accounts.join(wallet_totals(positions), "account_id", "left")
    zero = [
        "realized_pnl_u", "realized_funding_u", "fees_u", "price_pnl_u", "unsettled_u", "total_pnl_u", "open_notional_u",
        "open_collateral_u",
    ]
    counts = ["open_positions", "closed_positions", "positions", "warning_count"]
    absent = F.col("positions").isNull()
    return joined.withColumns(
        {c: F.when(absent, dec(0)).otherwise(F.col(c)) for c in zero}
        | {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
        | {c: F.coalesce(F.col(c), F.lit(True)) for c in ("all_marked", "all_funded")}
    )


POSITION_VIEW = [
    "perpetual_id", "symbol", "side_name", "status", "lot_lns", "mark_pns", "mark_event_id", "deposit_u",
    "price_pnl_u", "unsettled_u", "total_pnl_u", "notional_u", "maintenance_u", "equity_u", "liquidation_u",
    "buffer_u", "risk_status", "last_event_id", "warnings",
]


def wallet_documents(wallet_rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Nested form: positions of an account ordered by market.

    An account has at most one position per registry market, so the list is
    bounded by the registry size.
    """
    lists = positions.groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct(*POSITION_VIEW))).alias("position_list")
    )
    return wallet_rows.join(lists, "account_id", "left")


def one_wallet(wallet_rows: DataFrame, account_id: int) -> DataFrame:
    found = wallet_rows.where(F.col("account_id") == account_id)
    if not found.take(1):
        raise DataQualityError(f"account {account_id} is not present in the ledger")
    return found


def replay_eligibility(
    events: DataFrame, as_of: AsOf, coverage: Coverage, registry: Registry, *, indexed: bool = False
) -> DataFrame:
    """Can an account be replayed: one exchange, one right profile, and history from deployment or birth.

    Events of an index (``indexed``) must all name their provenance; events of a bundle may all
    lack it, but an account of which only some events name one cannot be replayed either.
    """
    found = with_event_id(events.where(F.col("account_id").isNotNull() & as_of.includes()))
    seq = F.shiftleft(F.col("block_number"), 31) + F.col("log_index")
    profile = F.col("provenance.ingestion_profile") if "provenance" in events.columns else F.lit(None).cast("string")
    facts = found.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("block_number").alias("first_block"),
        F.max("block_number").alias("last_block"),
        F.min_by("kind", seq).alias("first_kind"),
        F.max_by("event_id", seq).alias("last_event_id"),
        F.min(profile).alias("lowest_profile"),
        F.max(profile).alias("highest_profile"),
        F.max(profile.isNull()).alias("unprofiled"),
        F.max(~F.lower("contract_address").eqNullSafe(registry.exchange_address.lower())).alias("foreign"),
    )
    return judged_accounts(facts, coverage, registry, indexed=indexed)


def judged_accounts(facts: DataFrame, coverage: Coverage, registry: Registry, *, indexed: bool = False) -> DataFrame:
    """Eligibility from the facts of each account; ``foreign`` may be left out where the source checks the contract."""
    mixed = F.col("lowest_profile") != F.col("highest_profile")
    unproven = F.col("unprofiled") & (F.lit(indexed) | F.col("lowest_profile").isNotNull())
    from_start = coverage.start_block <= registry.deployed_at_block
    basis = (
        F.when(F.col("foreign") if "foreign" in facts.columns else F.lit(False), "contract-mismatch")
        .when(unproven, "missing-provenance")
        .when(mixed, "mixed-profiles")
        .when(F.col("lowest_profile").isNotNull() & ~F.col("lowest_profile").isin(REPLAY_PROFILES), "ingestion-profile")
        .when(F.lit(from_start), "deployment-history")
        .when(F.col("first_kind") == "account_created", "account-birth")
        .otherwise("incomplete-history")
    )
    return facts.withColumn("basis", basis).withColumn(
        "eligible", F.col("basis").isin("deployment-history", "account-birth")
    )


def wallet_quality(wallet_rows: DataFrame, eligibility: DataFrame) -> DataFrame:
    joined = wallet_rows.join(eligibility.select("account_id", "eligible", "basis"), "account_id", "left")
    quality = (
        F.when(~F.coalesce(F.col("eligible"), F.lit(False)), "incomplete-history")
        .when(~F.col("all_marked"), "marks-unavailable")
        .when(~F.col("all_funded"), "funding-checkpoint-unverified")
        .otherwise("canonical-funding-covered")
    )
    return joined.withColumn("quality", quality)


def has_market_inputs() -> Column:
    """Every event of the account comes from the profile that also delivers market inputs."""
    whole = (F.col("lowest_profile") == MARKET_PROFILE) & (F.col("highest_profile") == MARKET_PROFILE)
    return F.coalesce(whole & ~F.col("unprofiled"), F.lit(False))


def watched_wallets(wallet_rows: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Wallets of a watchlist with their input profile; an account that cannot be replayed has no figures."""
    facts = eligibility.select("account_id", "eligible", "basis", has_market_inputs().alias("market_inputs"))
    joined = wallet_rows.join(facts, "account_id", "left")
    good = F.coalesce(F.col("eligible"), F.lit(False))
    figures = ["owner", *[c for c in wallet_rows.columns if c.endswith("_u")]]
    quality = (
        F.when(~good, "incomplete-history")
        .when(~F.col("market_inputs") | ~F.col("all_marked"), "marks-unavailable")
        .when(~F.col("all_funded"), "funding-checkpoint-unverified")
        .otherwise("canonical-funding-covered")
    )
    profile = F.when(good, F.when(F.col("market_inputs"), "canonical-v3").otherwise("unavailable-legacy-profile"))
    return joined.withColumns({c: F.when(good, F.col(c)) for c in figures} | {"quality": quality, "market_input_profile": profile}).drop("market_inputs")
