"""Effective-dated funding.

A payment hits every position that was open before its effective block.
Instead of joining each payment with each position it hits, payments are
turned into running totals per market and a calendar of short block buckets.
Each position event looks up the running total at its own block with an
equality join on (market, bucket); the funding of an interval is then
``signed lot * (total at its end - total at its start)``.  Work grows with
events, not with events times payments, and one busy market spreads over its
buckets.

Windows over one market run on funding publications and payments only.  Their
number is bounded by the market's history divided by the funding interval (one
pending payment at a time), whatever the number of accounts and trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.exact import Q16, UNIT_DIGITS, dec, pow10, units_from_native
from tideledger.operators.checks import exploded, with_event_id
from tideledger.operators.ledger import ORDER, POSITION, kind_is, position_history, sequence, signed_lot
from tideledger.operators.running import RANGE_WIDTH
from tideledger.params import AsOf, FundingScope, Registry
from tideledger.schema import FUNDING_KINDS, SETTLE_KINDS

BUCKET_BLOCKS = 9_000  # one hour of 400 ms blocks, about one payment per market


def funding_inputs(events: DataFrame, as_of: AsOf) -> DataFrame:
    return with_event_id(events.where(kind_is(*FUNDING_KINDS) & as_of.includes()))


def publications(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Funding publications with the scale in force when they were published."""
    is_scale = kind_is("funding_scale_updated")
    upto = Window.partitionBy("perpetual_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    scaled = funding_inputs(events, as_of).withColumns(
        {
            "scale_exp": F.last(F.when(is_scale, F.col("funding_scaling_exp")), True).over(upto),
            "scale_event_id": F.last(F.when(is_scale, F.col("event_id")), True).over(upto),
            "scale_changes": F.count(F.when(is_scale, F.lit(1))).over(upto),
        }
    )
    return scaled.where(kind_is("market_funding"))


def timeline_rows(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Publications with the survivor they follow: same target, or the target before.

    A valid timeline never returns to an older target, so the previous
    publication of the market is the one to compare with.
    """
    pubs = publications(events, as_of).select(
        "perpetual_id", *ORDER, "event_id", "timestamp_ms", "block_hash", "chain_id",
        F.col("funding_event_block").alias("target"),
        F.col("funding_payment_pns").alias("payment"),
        F.col("funding_sum_pns").alias("total"),
        F.coalesce("funding_allow_overwrite", F.lit(False)).alias("allow"),
        "scale_changes",
    )
    in_order = Window.partitionBy("perpetual_id").orderBy(*ORDER)
    return pubs.withColumns(
        {f"prev_{c}": F.lag(c).over(in_order) for c in ("target", "payment", "total", "scale_changes")}
    )


def timeline_violations(events: DataFrame, as_of: AsOf) -> DataFrame:
    base = F.col("total") - F.col("payment")
    prev_base = F.col("prev_total") - F.col("prev_payment")
    again = F.col("target") == F.col("prev_target")
    moved = F.col("target") != F.col("prev_target")
    at_cutoff = F.col("block_number") == as_of.block_number
    return exploded(
        timeline_rows(events, as_of),
        ["perpetual_id", "event_id"],
        {
            "incomplete": F.col("target").isNull() | F.col("payment").isNull() | F.col("total").isNull(),
            "cutoff_differs": (F.col("chain_id") != as_of.chain_id)
            | (F.col("timestamp_ms") > as_of.timestamp_ms)
            | (at_cutoff & (F.col("block_hash") != as_of.block_hash)),
            "bad_overwrite": again & (~F.col("allow") | (base != prev_base)),
            "target_regresses": (F.col("target") < F.col("prev_target"))
            | (moved & (F.col("block_number") < F.col("prev_target"))),
            "sum_discontinuous": moved
            & (F.col("scale_changes") == F.col("prev_scale_changes"))
            & (F.col("prev_total") != base),
        },
    )


def survivors(events: DataFrame, as_of: AsOf) -> DataFrame:
    """The last publication of every (market, target)."""
    kept = F.max_by(
        F.struct(
            "event_id", "block_number", F.col("funding_payment_pns").alias("payment_pns"),
            F.col("funding_sum_pns").alias("sum_pns"), "scale_exp", "scale_event_id",
        ),
        sequence(),
    )
    return (
        publications(events, as_of)
        .groupBy("perpetual_id", F.col("funding_event_block").alias("effective_block"))
        .agg(kept.alias("p"), (F.count(F.lit(1)) - 1).alias("replacements"))
        .select("perpetual_id", "effective_block", "p.*", "replacements")
    )


def funding_timeline(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Per market: observations, replacements, active and pending schedule, scale."""
    inputs = funding_inputs(events, as_of)
    observed = inputs.groupBy("perpetual_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.max_by("funding_scaling_exp", F.when(kind_is("funding_scale_updated"), sequence())).alias("scale_exp"),
        F.max_by("event_id", F.when(kind_is("funding_scale_updated"), sequence())).alias("scale_event_id"),
    )
    active = F.col("effective_block") <= as_of.block_number
    plan = (
        survivors(events, as_of)
        .groupBy("perpetual_id")
        .agg(
            F.sum("replacements").alias("replacements"),
            F.max_by(
                F.struct("effective_block", "event_id", "payment_pns", "sum_pns"),
                F.when(active, F.col("effective_block")),
            ).alias("active"),
            F.count(F.when(~active, F.lit(1))).alias("pending"),
            F.min(F.when(~active, F.col("effective_block"))).alias("next_effective_block"),
        )
    )
    return observed.join(plan, "perpetual_id", "left").select(
        "perpetual_id",
        F.when(F.col("pending").isNull(), "unavailable").otherwise("observed-checkpoint-unverified").alias("status"),
        "observations",
        F.coalesce("replacements", F.lit(0)).alias("replacements"),
        F.col("active.effective_block").alias("active_effective_block"),
        F.col("active.event_id").alias("active_event_id"),
        F.col("active.payment_pns").alias("active_payment_pns"),
        F.col("active.sum_pns").alias("active_sum_pns"),
        F.coalesce("pending", F.lit(0)).alias("pending"),
        "next_effective_block",
        "scale_exp",
        "scale_event_id",
    )


def funding_schedule(events: DataFrame, registry: Registry, as_of: AsOf, scope: FundingScope) -> DataFrame:
    """Surviving payments in units per lot with running totals per market."""
    priced = priced_payments(survivors(events, as_of), registry, scope)
    upto = Window.partitionBy("perpetual_id").orderBy("effective_block").rowsBetween(Window.unboundedPreceding, 0)
    return priced.withColumns(
        {
            "total_u": F.coalesce(F.sum("per_lot_u").over(upto), dec(0)),
            "unknown_units": F.count(F.when(F.col("unit_unknown"), F.lit(1))).over(upto),
            "ordinal": F.count(F.lit(1)).over(upto),
        }
    )


def priced_payments(payments: DataFrame, registry: Registry, scope: FundingScope) -> DataFrame:
    """Surviving payments of the scope's markets in units per lot."""
    markets = registry.listed(payments.sparkSession).where(F.col("perpetual_id").isin(list(scope.market_ids)))
    rows = payments.join(markets, "perpetual_id")
    digits = F.col("scale_exp") + F.col("price_decimals") + F.col("size_decimals")
    unknown = (F.col("payment_pns") != 0) & F.col("scale_exp").isNull()
    per_lot = F.when(F.col("payment_pns") == 0, dec(0)).when(
        F.col("scale_exp").isNotNull(), F.col("payment_pns") * dec(Q16) * pow10(F.lit(UNIT_DIGITS) - digits)
    )
    return rows.select(
        "perpetual_id", "effective_block", "event_id", F.col("block_number").alias("published_block"),
        "payment_pns", "scale_exp", "scale_event_id", per_lot.alias("per_lot_u"), unknown.alias("unit_unknown"),
    )


def baselines(schedule: DataFrame) -> DataFrame:
    """Lowest effective block of each market and the event that published it."""
    return schedule.groupBy("perpetual_id").agg(*_baseline())


def _baseline() -> list[Column]:
    return [
        F.min("effective_block").alias("baseline_block"),
        F.min_by("event_id", "effective_block").alias("baseline_event_id"),
    ]


TOTALS = {"fund_total_u": "total_u", "fund_unknown": "unknown_units", "fund_ordinal": "ordinal"}


def funding_calendar(schedule: DataFrame, as_of: AsOf) -> DataFrame:
    """(market, bucket) -> totals before the bucket and the payments inside it.

    Rows are bounded by markets times hours of history, not by events.
    """
    due = schedule.where(F.col("effective_block") <= as_of.block_number)
    item = F.struct(F.col("effective_block"), *[F.col(c).alias(n) for n, c in TOTALS.items()])
    bucket = F.floor(F.col("effective_block") / BUCKET_BLOCKS).cast("long")
    filled = due.groupBy("perpetual_id", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    last_bucket = as_of.block_number // BUCKET_BLOCKS
    in_order = Window.partitionBy("perpetual_id").orderBy("bucket")
    spread = filled.select(
        "perpetual_id",
        F.col("bucket").alias("filled_bucket"),
        "items",
        F.lag(F.element_at("items", -1)).over(in_order).alias("before_items"),
        # Empty buckets up to the next filled one repeat the last total.
        F.sequence(F.col("bucket"), F.coalesce(F.lead("bucket").over(in_order) - 1, F.lit(last_bucket))).alias("buckets"),
    ).withColumn("bucket", F.explode("buckets"))
    own = F.col("bucket") == F.col("filled_bucket")
    return spread.select(
        "perpetual_id",
        "bucket",
        F.when(own, F.col("before_items")).otherwise(F.element_at("items", -1)).alias("base"),
        F.when(own, F.col("items")).alias("items"),
    )


def with_totals(rows: DataFrame, calendar: DataFrame, block: str = "block_number") -> DataFrame:
    """Add the funding totals in force at a row's block (payments with E <= block)."""
    keyed = rows.withColumn("bucket", F.floor(F.col(block) / BUCKET_BLOCKS).cast("long"))
    joined = keyed.join(calendar, ["perpetual_id", "bucket"], "left")
    inside = F.filter("items", lambda item: item["effective_block"] <= F.col(block))
    found = F.coalesce(F.when(F.size(inside) > 0, F.element_at(inside, -1)), F.col("base"))
    return joined.withColumns(
        {n: F.coalesce(found.getField(n), F.lit(0)) for n in TOTALS}
    ).drop("bucket", "base", "items")


def cutoff_totals(schedule: DataFrame, as_of: AsOf) -> DataFrame:
    """Totals of each market at the cutoff; at most one row per market."""
    return schedule.groupBy("perpetual_id").agg(*_cutoff(as_of))


def _cutoff(as_of: AsOf) -> list[Column]:
    due = F.when(F.col("effective_block") <= as_of.block_number, F.col("effective_block"))
    return [F.max_by(c, due).alias(f"cut_{n}") for n, c in TOTALS.items()]


def funded_history(
    events: DataFrame, registry: Registry, as_of: AsOf, scope: FundingScope, *, range_width: int = RANGE_WIDTH
) -> DataFrame:
    """Position history with the funding that accrued in each interval."""
    scope.validate(registry, as_of)
    schedule = funding_schedule(events, registry, as_of, scope)
    position_rows = with_totals(
        with_event_id(events.where(F.col("account_id").isNotNull() & F.col("perpetual_id").isNotNull())),
        funding_calendar(schedule, as_of),
    )
    history = position_history(position_rows, as_of, extra=list(TOTALS), range_width=range_width)
    # One row per listed market of the registry, whose size is checked.
    ends = schedule.groupBy("perpetual_id").agg(*_cutoff(as_of), *_baseline())
    history = history.join(F.broadcast(ends), "perpetual_id", "left")
    ends = {n: F.coalesce(F.col(f"next_{n}"), F.col(f"cut_{n}"), F.lit(0)) for n in TOTALS}
    gone = {n: ends[n] - F.col(n) for n in TOTALS}
    live = F.col("is_open")
    return history.withColumns(
        {
            "accrued_u": F.when(live, -signed_lot() * gone["fund_total_u"]).otherwise(dec(0)),
            "accrued_unknown": F.when(live, gone["fund_unknown"]).otherwise(F.lit(0)),
            "first_ordinal": F.when(live, F.col("fund_ordinal")),
            "last_ordinal": F.when(live, ends["fund_ordinal"]),
        }
    ).drop(*[f"cut_{n}" for n in TOTALS])


def unsettled_funding(history: DataFrame, registry: Registry, scope: FundingScope) -> DataFrame:
    """Unsettled funding per position since its last proven reset."""
    return span_view(_last_spans(history, []), registry, scope)


def funded_state(history: DataFrame, registry: Registry, scope: FundingScope) -> DataFrame:
    """Final state of each position with its unsettled funding, from one pass over the history."""
    state = [c for c in history.columns if c not in (*POSITION, "baseline_block", "baseline_event_id")]
    view = span_view(_last_spans(history, state), registry, scope, [f"s.final.{c}" for c in state])
    return view.drop("baseline_block", "baseline_event_id")


def _last_spans(history: DataFrame, state: list[str]) -> DataFrame:
    """Sums of each position's last span, and its last row (``state``) as the struct ``final``."""
    reset_row = F.when(kind_is("position_opened", "position_increased", "position_inverted"), sequence())
    final = [F.max_by(F.struct(*state), F.struct(*ORDER, "event_id")).alias("final")] if state else []
    spans = history.groupBy(*POSITION, "span").agg(
        F.sum("accrued_u").alias("accrued_u"),
        F.sum("accrued_unknown").alias("unknown_payments"),
        F.coalesce(F.sum("settled_cns"), dec(0)).alias("settled_cns"),
        F.max_by(F.struct("event_id", "block_number"), reset_row).alias("reset"),
        F.max("baseline_block").alias("baseline_block"),
        F.max("baseline_event_id").alias("baseline_event_id"),
        F.max_by("is_open", sequence()).alias("is_open"),
        *final,
    )
    facts = [c for c in spans.columns if c not in (*POSITION, "span")]
    return spans.groupBy(*POSITION).agg(F.max_by(F.struct(*facts), "span").alias("s"))


def span_view(last: DataFrame, registry: Registry, scope: FundingScope, keep: list[str] | None = None) -> DataFrame:
    """Unsettled funding from what is known of each position's last span (struct `s`)."""
    from_deployment = scope.start_block <= registry.deployed_at_block
    in_scope = F.col("perpetual_id").isin(list(scope.market_ids))
    reset_block = F.col("s.reset.block_number")
    proven = reset_block.isNotNull() & (
        (F.lit(from_deployment) & in_scope) | F.coalesce(reset_block >= F.col("s.baseline_block"), F.lit(False))
    )
    settled = units_from_native(F.col("s.settled_cns"), F.lit(registry.collateral_decimals))
    value = (
        F.when(~F.col("s.is_open"), dec(0))
        .when(proven & (F.col("s.unknown_payments") == 0), F.col("s.accrued_u") - settled)
    )
    reason = (
        F.when(value.isNotNull(), F.lit(None).cast("string"))
        .when(proven, "scale-at-publication-unknown")
        .when(F.col("s.baseline_block").isNull(), "no-effective-baseline")
        .otherwise("reset-before-baseline")
    )
    return last.select(
        *POSITION,
        *(keep or []),
        value.alias("unsettled_u"),
        reason.alias("funding_reason"),
        F.col("s.reset.event_id").alias("reset_event_id"),
        reset_block.alias("reset_block"),
        F.col("s.baseline_block").alias("baseline_block"),
        F.col("s.baseline_event_id").alias("baseline_event_id"),
    )


def interval_payments(history: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each (position interval, payment) pair, for evidence and inspection.

    The pair list is expanded from the exact ordinal range of an interval and
    joined on (market, ordinal), so no non-matching pair is ever produced.
    """
    spread = history.where(F.col("last_ordinal") > F.col("first_ordinal")).select(
        *POSITION,
        "span",
        "event_id",
        "block_number",
        "lot_lns",
        "side",
        F.explode(F.sequence(F.col("first_ordinal") + 1, F.col("last_ordinal"))).alias("ordinal"),
    )
    payments = schedule.select(
        "perpetual_id",
        "ordinal",
        "effective_block",
        "per_lot_u",
        F.col("event_id").alias("payment_event_id"),
        "scale_event_id",
    )
    return spread.join(payments, ["perpetual_id", "ordinal"]).withColumn("amount_u", -signed_lot() * F.col("per_lot_u"))


def checkpoint_evidence(
    history: DataFrame, schedule: DataFrame, unsettled: DataFrame, as_of: AsOf, scope: FundingScope
) -> DataFrame:
    """Ids behind the funding amount of each open position, in payment order."""
    state = history.groupBy(*POSITION).agg(F.max("span").alias("span"), F.max_by("is_open", sequence()).alias("open"))
    current = state.where("open").drop("open")
    paid = (
        interval_payments(history, schedule)
        .join(current, [*POSITION, "span"], "left_semi")
        .groupBy(*POSITION)
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "payment_event_id", "scale_event_id"))).alias("p"))
        .select(
            *POSITION,
            F.array_distinct(
                F.flatten(F.transform("p", lambda x: F.array_compact(F.array(x["payment_event_id"], x["scale_event_id"]))))
            ).alias("payment_event_ids"),
        )
    )
    settled = (
        history.where(kind_is(*SETTLE_KINDS))
        .join(current, [*POSITION, "span"], "left_semi")
        .groupBy(*POSITION)
        .agg(F.array_sort(F.collect_list(F.struct(sequence().alias("s"), "event_id"))).alias("s"))
        .select(*POSITION, F.col("s.event_id").alias("settlement_event_ids"))
    )
    empty = F.array().cast("array<string>")
    return (
        unsettled.join(current.drop("span"), POSITION, "left_semi")
        .join(paid, POSITION, "left")
        .join(settled, POSITION, "left")
        .withColumns(
            {
                "payment_event_ids": F.coalesce("payment_event_ids", empty),
                "settlement_event_ids": F.coalesce("settlement_event_ids", empty),
                "coverage_start_block": F.lit(scope.start_block).cast("long"),
                "through_block": F.lit(as_of.block_number).cast("long"),
            }
        )
    )


def scope_violations(events: DataFrame, as_of: AsOf, scope: FundingScope) -> DataFrame:
    """Funding inputs of the scope that precede its declared start."""
    return funding_inputs(events, as_of).where(
        F.col("perpetual_id").isin(list(scope.market_ids)) & (F.col("block_number") < scope.start_block)
    )


def reset_spans(history: DataFrame) -> DataFrame:
    """Number of resets so far for each position event."""
    return history.select(*POSITION, "event_id", "kind", "span")


def scale_at_publication(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Each publication with the scale frozen at its publication."""
    return publications(events, as_of).select(
        "perpetual_id", "event_id", "funding_event_block", "funding_payment_pns", "scale_exp", "scale_event_id"
    )


