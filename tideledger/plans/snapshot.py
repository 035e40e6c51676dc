"""Composed outputs: protocol view, pinned history, full and watchlist snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.operators import accounting, analytics, checks, cohort, evidence, funding, ledger, signals
from tideledger.operators.accounting import amount_factor, notional
from tideledger.operators.checks import require_clean, with_event_id
from tideledger.operators.ledger import kind_is
from tideledger.params import AsOf, Coverage, FundingScope, Registry
from tideledger.plans import scans
from tideledger.plans.kept import written


def protocol_view(totals: DataFrame, states: DataFrame) -> DataFrame:
    """Coverage-window totals next to market and position counts; both sides are one row."""
    held = states.agg(F.count(F.lit(1)).alias("markets"), F.coalesce(F.sum("open_positions"), F.lit(0)).alias("open_positions"))
    return totals.where("window = 'coverage'").crossJoin(F.broadcast(held))


def historical(
    window: DataFrame, events: DataFrame, positions: DataFrame, eligible: DataFrame, registry: Registry, as_of: AsOf
) -> DataFrame:
    """Pinned window in long form: fills of everyone, positions of replayable accounts."""
    fills = registry.attach(window.where(kind_is("maker_fill") & as_of.includes()))
    flows = fills.groupBy("perpetual_id", "price_decimals", "size_decimals").agg(
        F.sum(F.col("price_pns") * F.col("lot_lns")).alias("v"), F.count(F.lit(1)).alias("n")
    )
    one = F.lit(1).cast("decimal(38,0)")
    flows = flows.select(F.lit("flow").alias("part"), "perpetual_id", notional(F.col("v"), one, amount_factor()).alias("amount_u"), "n")
    mine = positions.where("is_open").join(eligible.where("eligible").select("account_id"), "account_id", "left_semi")
    held = mine.groupBy("perpetual_id").agg(F.sum("deposit_u").alias("amount_u"), F.count(F.lit(1)).alias("n"))
    return flows.unionByName(held.select(F.lit("position").alias("part"), "perpetual_id", "amount_u", "n"))


def pinned_history(
    window: DataFrame, pin: scans.PinnedWindow, events: DataFrame, registry: Registry, proofs: DataFrame, coverage: Coverage,
    scope: FundingScope | None = None,
) -> dict[str, DataFrame]:
    """Tables of a pinned window, whose preconditions hold before it is read and still hold after.

    Preconditions: boundary headers, count and anchor of the window, and a proof of every market
    that it names (`proofs`: perpetual_id and its registered fields).  `events` are the history
    behind the window, from which positions are replayed.
    """
    as_of = AsOf(pin.chain_id, pin.last.block_number, pin.last.block_hash, pin.last.timestamp_ms)
    scans.require_pinned(window, pin)
    require_clean(evidence.unproven_markets(window, proofs, as_of), "market without a proof")
    require_clean(evidence.proof_mismatches(registry.frame(window.sparkSession), proofs), "market proof differs")
    positions = accounting.position_risk(events, registry, as_of, scope)
    eligible = accounting.replay_eligibility(events, as_of, coverage, registry)
    seen = visible_events(window, eligible.where("eligible"), as_of)
    tables = {
        "history": historical(window, events, positions, eligible, registry, as_of),
        "events": scans.event_view(seen),
        "manifest": evidence.range_manifest(window, as_of),
    }
    scans.require_pinned(window, pin)
    return tables


def visible_events(events: DataFrame, accounts: DataFrame, as_of: AsOf) -> DataFrame:
    """Events of a watchlist plus market inputs and liquidations, without repeats."""
    kept = with_event_id(events.where(as_of.includes()))
    mine = kept.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
    shared = kept.where(kind_is("mark_updated", "market_funding", "funding_scale_updated", "position_liquidated"))
    return scans.union_dedupe([mine.select(*kept.columns), shared])


def require_sound(events: DataFrame, registry: Registry, as_of: AsOf, scope: FundingScope | None = None, supplied_marks: DataFrame | None = None, held: DataFrame | None = None) -> None:
    """Everything that must hold before a figure is given; the first violation raises.

    ``held`` are the events whose positions are replayed, where others are only looked at.

    Each check is one short-circuiting job of which a single row reaches the driver.
    """
    require_clean(checks.validate_events(events), "invalid event")
    require_clean(checks.ledger_guards(events, registry, as_of), "ledger guard")
    require_clean(checks.unlisted_market_events(events.where(as_of.includes()), registry), "unlisted market")
    require_clean(analytics.negative_flows(events, as_of), "negative flow")
    require_clean(ledger.transition_violations(ledger.position_history(events if held is None else held, as_of)), "broken transition")
    if scope is not None:
        require_clean(funding.timeline_violations(events, as_of), "funding timeline")
        require_clean(funding.scope_violations(events, as_of, scope), "funding before the scope")
    if supplied_marks is not None:
        require_clean(accounting.mark_conflicts(events, supplied_marks, as_of), "supplied mark differs from the canonical one")
    require_clean(checks.mark_violations(accounting.effective_marks(events, supplied_marks, as_of), as_of), "inconsistent mark")


def build_snapshot(
    events: DataFrame,
    registry: Registry,
    as_of: AsOf,
    coverage: Coverage,
    scope: FundingScope | None = None,
    supplied_marks: DataFrame | None = None,
    *,
    scope_name: str = "protocol",
) -> dict[str, DataFrame]:
    """Every table of one cutoff, keyed by name.

    Input checks run first and raise; each table is then lazy and can be
    written under the same ``snapshot_id``.
    """
    events = with_event_id(events)
    require_sound(events, registry, as_of, scope, supplied_marks)
    checks.require_gate(events, as_of, coverage)
    marks = accounting.effective_marks(events, supplied_marks, as_of)
    positions = accounting.position_risk(events, registry, as_of, scope, supplied_marks)
    eligible = accounting.replay_eligibility(events, as_of, coverage, registry)
    windows = analytics.report_windows(as_of, coverage, registry)
    totals, markets = analytics.window_flows(events, registry, as_of, windows)
    proven = coverage.start_block <= registry.deployed_at_block
    states = analytics.market_state(analytics.state_positions(events, marks, registry, as_of)) if proven else None
    day = markets.where("window = '24h'") if windows[0].complete else None
    wallets = accounting.wallets(events, positions, registry, as_of)
    stats = cohort.wallet_stats(wallets, eligible)
    report = signals.signal_report(positions, eligible, states, day, as_of)
    require_clean(signals.repeated_signals(report), "repeated signal")
    good = positions.join(eligible.where("eligible").select("account_id"), "account_id", "left_semi")
    tables = {
        "wallets": accounting.wallet_quality(wallets, eligible),
        "positions": positions,
        "flow_totals": totals,
        "flow_markets": markets,
        "events": scans.event_view(events.where(as_of.includes())),
        "manifest": evidence.range_manifest(events, as_of),
        "signals": report,
        "severity_counts": signals.severity_counts(report),
        "stress": signals.stress_report(good),
        "stress_excluded": signals.stress_excluded(positions, eligible),
        "wallet_stats": stats,
        "percentiles": cohort.midrank_percentiles(cohort.statistic_rows(stats)),
        "overlap": cohort.overlap_profile(cohort.exposures(positions, eligible)),
        "excluded": cohort.excluded_wallets(eligible),
        "checkpoint": evidence.checkpoint_hashes({"marks": marks, "registry": registry.frame(events.sparkSession), "positions": positions.select(*ledger.POSITION, "status", "lot_lns", "deposit_cns")}),
    }
    if states is not None:
        tables["state_markets"] = states
        tables["state_totals"] = analytics.protocol_state(states, coverage, registry)
    key = f"{scope_name}:{as_of.chain_id}:{as_of.block_number}:{'' if as_of.log_index is None else as_of.log_index}"
    return {name: t.withColumn("snapshot_id", F.lit(key)) for name, t in tables.items()}


def watch_inputs(events: DataFrame, held: DataFrame, as_of: AsOf) -> DataFrame:
    """Inputs of the held markets: all their funding events, and of their marks the latest alone."""
    kept = events.where(as_of.includes()).join(held, "perpetual_id", "left_semi").select(*events.columns)
    funded = kept.where(kind_is("market_funding", "funding_scale_updated"))
    newest = kept.where(kind_is("mark_updated")).groupBy("perpetual_id").agg(F.max_by(F.struct(*events.columns), ledger.sequence()).alias("newest"))
    return funded.unionByName(newest.select("newest.*"))


def watched(
    events: DataFrame, accounts: DataFrame, registry: Registry, as_of: AsOf, coverage: Coverage, scope: FundingScope | None = None
) -> dict[str, DataFrame]:
    """Facts of any number of accounts (column account_id) from their own events and the inputs
    of the markets that they hold.

    Accounts that cannot be replayed have a wallet without figures and no positions.  Market
    inputs, and so prices and funding, count for accounts of the profile that delivers them.
    """
    kept = with_event_id(events.where(as_of.includes()))
    mine = kept.join(accounts.select("account_id").distinct(), "account_id", "left_semi").select(*kept.columns)
    eligible = written(accounting.replay_eligibility(mine, as_of, coverage, registry), "watched")
    good = eligible.where("eligible")

    def of(chosen: DataFrame) -> DataFrame:
        return mine.join(chosen.select("account_id"), "account_id", "left_semi").select(*kept.columns)

    covered, legacy = of(good.where(accounting.has_market_inputs())), of(good.where(~accounting.has_market_inputs()))
    held = ledger.position_state(covered, as_of).where("is_open").select("perpetual_id").distinct()
    inputs = watch_inputs(kept, held, as_of)
    priced = accounting.position_risk(covered.unionByName(inputs), registry, as_of, scope)
    positions = priced.unionByName(accounting.position_risk(legacy, registry, as_of), allowMissingColumns=True)  # columns of the funding scope
    wallets = accounting.wallets(mine, positions, registry, as_of)
    return {
        "mine": mine, "inputs": inputs, "eligible": eligible, "positions": positions,
        "wallets": accounting.watched_wallets(wallets, eligible),
    }


def watchlist_snapshot(
    events: DataFrame, accounts: list[int], registry: Registry, as_of: AsOf, coverage: Coverage, scope: FundingScope | None = None
) -> dict[str, DataFrame]:
    """One job for all accounts of a watchlist at a shared cutoff, after the same checks as a
    full snapshot; its events and hash have no limit (pairs need 20 accounts at most)."""
    if not accounts or len(set(accounts)) != len(accounts):
        raise DataQualityError("a watchlist holds distinct accounts, one at least")
    listed = events.sparkSession.createDataFrame([(a,) for a in accounts], "account_id long")
    facts = watched(events, listed, registry, as_of, coverage, scope)
    seen = scans.union_dedupe([facts["mine"], facts["inputs"]])
    require_sound(seen, registry, as_of, scope, held=facts["mine"])
    positions, eligible = facts["positions"], facts["eligible"]
    return {
        "wallets": facts["wallets"],
        "positions": positions,
        "events": scans.event_view(seen),
        "signals": signals.signal_report(positions, eligible, None, None, as_of),
        "overlap": cohort.exposure_overlap(cohort.exposures(positions, eligible), listed),
        "manifest": evidence.ids_hash_tree(seen, as_of),
    }


def demo_walk(tables: dict[str, DataFrame], account_id: int) -> None:
    """Print the protocol, one wallet with its positions, and its latest event."""
    tables["flow_totals"].orderBy("window").show(truncate=False)
    tables["wallets"].where(F.col("account_id") == account_id).show(truncate=False)
    tables["positions"].where(F.col("account_id") == account_id).select(*accounting.POSITION_VIEW).show(truncate=False)
    mine = tables["events"].where(F.col("account_id") == account_id)
    mine.orderBy(F.desc("block_number"), F.desc("log_index")).limit(1).show(truncate=False)
