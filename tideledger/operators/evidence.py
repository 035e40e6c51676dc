"""Evidence: range manifests, reconciliation scorecards, coverage states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.functions.exact import Q16, UNIT_DIGITS, dec, pow10, trunc_div
from tideledger.functions.keys import digest_json, digest_text
from tideledger.operators.checks import exploded, guarded, with_event_id
from tideledger.operators.ledger import sequence
from tideledger.params import AsOf

EXACT_IDS = 100_000  # the largest id list hashed as one JSON array
TREE_BITS = 10


def ids_hash_exact(events: DataFrame, as_of: AsOf, limit: int | None = EXACT_IDS) -> DataFrame:
    """SHA-256 of the JSON array of ordered ids, which one task builds; `ids_hash_tree` has no such array.

    With a limit the list is only built after the count has been checked.
    """
    kept = with_event_id(events.where(as_of.includes()))
    if limit is not None and kept.limit(limit + 1).count() > limit:
        raise DataQualityError(f"a single-array hash covers at most {limit} ids; use ids_hash_tree")
    ordered = F.array_sort(F.collect_list(F.struct("block_number", "log_index", "tx_hash", "event_id")))
    return kept.agg(digest_json(F.transform(ordered, lambda x: x["event_id"])).alias("ordered_ids_hash"))


def ids_hash_tree(events: DataFrame, as_of: AsOf, levels: int = 5) -> DataFrame:
    """Order-sensitive hash of any number of ids.

    A leaf holds the ids of 1024 consecutive places (block and log), a node 1024 leaves, and so
    on, so no group grows with the data or with the logs of a block.
    """
    kept = with_event_id(events.where(as_of.includes())).select(sequence().alias("place"), "event_id")
    rows = kept.groupBy(F.shiftright("place", TREE_BITS).alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("place", "event_id"))).alias("x"), F.count(F.lit(1)).alias("n")
    )
    level = rows.select("node", "n", digest_text(F.array_join(F.transform("x", lambda i: i["event_id"]), ",")).alias("h"))
    for _ in range(levels):
        level = (
            level.groupBy(F.shiftright("node", TREE_BITS).alias("up"))
            .agg(F.array_sort(F.collect_list(F.struct("node", "h"))).alias("x"), F.sum("n").alias("n"))
            .select(F.col("up").alias("node"), "n", digest_text(F.array_join(F.transform("x", lambda i: i["h"]), ",")).alias("h"))
        )
    return level.select(F.col("n").alias("event_count"), F.col("h").alias("ordered_ids_tree_hash"))


def range_manifest(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Count, first and last id and the order-sensitive hash of a range."""
    kept = with_event_id(events.where(as_of.includes()))
    ends = kept.agg(
        F.min_by("event_id", sequence()).alias("first_event_id"), F.max_by("event_id", sequence()).alias("last_event_id")
    )
    # Both sides are single rows.
    return ids_hash_tree(events, as_of).crossJoin(F.broadcast(ends))


PROFILE = ["schema_version", "handler_version", "classifier_version", "ingestion_profile", "abi_fingerprint"]


def provenance_profile(events: DataFrame, as_of: AsOf) -> DataFrame:
    """Distinct version tuples and their event counts."""
    kept = events.where(as_of.includes() & F.col("provenance").isNotNull())
    return kept.groupBy(*[F.col(f"provenance.{c}").alias(c) for c in PROFILE]).agg(F.count(F.lit(1)).alias("events"))


def _verdict(actual: Column, expected: Column) -> Column:
    return (
        F.when(actual.isNull() | expected.isNull(), "unverified")
        .when(actual == expected, "matched")
        .otherwise("mismatch")
    )


def compare_long(joined: DataFrame, keys: list[str], pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long-form checks: one row per key and field."""
    checks = [
        F.struct(
            F.lit(field).alias("field"),
            actual.cast("string").alias("canonical"),
            expected.cast("string").alias("reference"),
            _verdict(actual, expected).alias("status"),
        )
        for field, (actual, expected) in pairs.items()
    ]
    return joined.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.*")


def cutoff_rules(as_of: AsOf) -> dict[str, Column]:
    """A reference is taken at the very point of the snapshot: nothing of it may differ."""
    return {
        "other_chain": ~F.col("chain_id").eqNullSafe(as_of.chain_id),
        "other_block": ~F.col("as_of_block").eqNullSafe(as_of.block_number),
        "other_block_hash": ~F.col("as_of_block_hash").eqNullSafe(as_of.block_hash),
        "other_log": ~F.col("as_of_log_index").eqNullSafe(F.lit(as_of.log_index).cast("int")),
        "other_time": ~F.col("as_of_timestamp_ms").eqNullSafe(as_of.timestamp_ms),
    }


def reference_cutoff_violations(reference: DataFrame, as_of: AsOf) -> DataFrame:
    """Reference rows whose cutoff is not identical to the snapshot's."""
    return exploded(reference, ["account_id"], cutoff_rules(as_of))


def _counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def account_reconcile(wallets: DataFrame, reference: DataFrame, as_of: AsOf) -> DataFrame:
    """Four account totals against a reference taken at the same cutoff.

    Before any figure is compared the job fails on a reference of another cutoff, two of one
    account, and an account that the ledger does not hold; a missing figure is `unverified`.
    """
    fields = ["realized_pnl_u", "realized_funding_u", "fees_u", "free_balance_u"]
    cut = ["chain_id", "as_of_block", "as_of_block_hash", "as_of_log_index", "as_of_timestamp_ms"]
    right = _counted(reference, ["account_id"], "times").select("account_id", "times", *cut, *[F.col(c).alias(f"ref_{c}") for c in fields])
    mine = wallets.select("account_id", *fields, F.lit(True).alias("known"))
    rules = {**cutoff_rules(as_of), "repeated_account": F.col("times") > 1, "unknown_account": F.col("known").isNull()}
    joined = guarded(right.join(mine, "account_id", "left"), "account_id", rules, "account reference")
    return compare_long(joined, ["account_id"], {c: (F.col(c), F.col(f"ref_{c}")) for c in fields})


def _shape_rules() -> dict[str, Column]:
    closed, is_open = F.col("status") == "closed", F.col("status") == "open"
    return {
        "bad_status": ~F.coalesce(F.col("status").isin("open", "closed"), F.lit(False)),
        "missing_amount": F.col("lot_lns").isNull() | F.col("deposit_cns").isNull(),
        "negative_amount": (F.col("lot_lns") < 0) | (F.col("deposit_cns") < 0),
        "closed_not_empty": closed
        & ((F.col("lot_lns") != 0) | (F.col("deposit_cns") != 0) | F.col("side_name").isNotNull() | F.col("entry_q16").isNotNull()),
        "open_incomplete": is_open
        & (
            (F.col("lot_lns") <= 0)
            | ~F.coalesce(F.col("side_name").isin("long", "short"), F.lit(False))
            | ~F.coalesce(F.col("entry_q16") > 0, F.lit(False))
        ),
    }


def position_reference_rules(as_of: AsOf, market_ids: tuple[int, ...]) -> dict[str, Column]:
    """Rules over reference positions with `times` (rows of one position) and `markets` (of one account)."""
    if as_of.log_index is not None:
        raise DataQualityError("positions are compared at the end of a block only")
    if not market_ids or len(set(market_ids)) != len(market_ids) or min(market_ids) <= 0:
        raise DataQualityError("the markets of a position reference are distinct positive ids, one at least")
    return {
        **cutoff_rules(as_of),
        **_shape_rules(),
        "repeated_position": F.col("times") > 1,
        "outside_scope": ~F.coalesce(F.col("perpetual_id").isin(*market_ids), F.lit(False)),
        "incomplete_scope": F.col("markets") != len(market_ids),
    }


def _scoped(reference: DataFrame) -> DataFrame:
    return _counted(_counted(reference, ["account_id"], "markets"), ["account_id", "perpetual_id"], "times")


def position_reference_violations(reference: DataFrame, as_of: AsOf, market_ids: tuple[int, ...]) -> DataFrame:
    """Everything wrong with reference positions, which name each market of the scope once
    for each account, open or closed."""
    return exploded(_scoped(reference), ["account_id", "perpetual_id"], position_reference_rules(as_of, market_ids))


def position_reconcile(positions: DataFrame, reference: DataFrame, as_of: AsOf, market_ids: tuple[int, ...]) -> DataFrame:
    """Status, size, deposit (and side, entry when open) per position of the scope.

    A position that the ledger does not know counts as closed and empty.  A reference that
    breaks a rule of `position_reference_rules` fails the job; ledger positions outside the
    scope are not compared, `excluded_positions` lists them.
    """
    keys = ["account_id", "perpetual_id"]
    mine = positions.select(
        *keys, F.col("status").alias("c_status"), F.col("lot_lns").alias("c_lot"), F.col("deposit_cns").alias("c_deposit"),
        F.when(F.col("status") == "open", F.col("side_name")).alias("c_side"),
        F.when(F.col("status") == "open", F.col("entry_q16")).alias("c_entry"),
    )
    joined = guarded(_scoped(reference).join(mine, keys, "left"), "account_id", position_reference_rules(as_of, market_ids), "position reference")
    zero = F.lit(0).cast("decimal(38,0)")
    status = F.coalesce("c_status", F.lit("closed"))

    def check(field, actual, expected, applies=None):
        equal = F.when(actual.eqNullSafe(expected), "matched").otherwise("mismatch")
        row = F.struct(
            F.lit(field).alias("field"), actual.cast("string").alias("canonical"), expected.cast("string").alias("reference"),
            equal.alias("status"),
        )
        return row if applies is None else F.when(applies, row)

    either_open = (F.col("status") == "open") | (status == "open")
    checks = F.array_compact(
        F.array(
            check("status", status, F.col("status")),
            check("size", F.coalesce("c_lot", zero), F.col("lot_lns")),
            check("deposit", F.coalesce("c_deposit", zero), F.col("deposit_cns")),
            check("side", F.col("c_side"), F.col("side_name"), either_open),
            check("entry", F.col("c_entry"), F.col("entry_q16"), either_open),
        )
    )
    return joined.select(*keys, F.explode(checks).alias("c")).select(*keys, "c.*")


def excluded_positions(positions: DataFrame, reference: DataFrame, market_ids: tuple[int, ...]) -> DataFrame:
    """Ledger positions of the referenced accounts in markets outside the scope."""
    outside = positions.where(~F.col("perpetual_id").isin(*market_ids))
    return outside.join(reference.select("account_id"), "account_id", "left_semi").select("account_id", "perpetual_id", "status")


def truncated_equal(actual: Column, expected: Column, unit) -> Column:
    """Two unit amounts are equal after truncation to a coarser unit."""
    return trunc_div(actual, unit) == trunc_div(expected, unit)


def component_projection(cns_unit: int) -> dict[str, Column]:
    """Price and funding truncated separately to collateral units, then added."""
    unit = F.lit(cns_unit).cast("decimal(38,0)")
    funding = trunc_div(F.col("unsettled_u"), unit)
    pnl = trunc_div(F.col("price_pnl_u"), unit) + funding
    equity = F.col("deposit_cns") + pnl
    return {
        "projected_funding_cns": funding,
        "projected_pnl_cns": pnl,
        "projected_equity_cns": equity,
        "projected_buffer_cns": equity - trunc_div(F.col("maintenance_u"), unit),
    }


def liquidation_ticks() -> Column:
    """The liquidation price truncated to whole price ticks of its market."""
    return trunc_div(F.col("liquidation_u"), pow10(F.lit(UNIT_DIGITS) - F.col("price_decimals")) * dec(Q16))


def risk_scorecard(positions: DataFrame, reference: DataFrame, cns_unit: int) -> DataFrame:
    """Risk facts of open positions against a reference in collateral units, and the
    liquidation price in price ticks.

    Figures unknown to either side are `unverified`.  A reference of a position that is not
    open in the ledger, or two of one position, fail the job.
    """
    keys = ["account_id", "perpetual_id"]
    fields = ["maintenance_cns", "price_pnl_cns", "funding_cns", "total_pnl_cns", "equity_cns", "buffer_cns", "liquidation_pns"]
    unit = F.lit(cns_unit).cast("decimal(38,0)")
    mine = positions.where("is_open").withColumns(component_projection(cns_unit)).select(
        *keys,
        trunc_div(F.col("maintenance_u"), unit).alias("maintenance_cns"),
        trunc_div(F.col("price_pnl_u"), unit).alias("price_pnl_cns"),
        F.col("projected_funding_cns").alias("funding_cns"),
        F.col("projected_pnl_cns").alias("total_pnl_cns"),
        F.col("projected_equity_cns").alias("equity_cns"),
        F.col("projected_buffer_cns").alias("buffer_cns"),
        liquidation_ticks().alias("liquidation_pns"),
        F.lit(True).alias("known"),
    )
    right = _counted(reference, keys, "times").select(*keys, "times", *[F.col(c).alias(f"ref_{c}") for c in fields])
    rules = {"repeated_position": F.col("times") > 1, "not_open": F.col("known").isNull()}
    joined = guarded(right.join(mine, keys, "left"), "account_id", rules, "risk reference")
    return compare_long(joined, keys, {c: (F.col(c), F.col(f"ref_{c}")) for c in fields})


def market_scorecard(marks: DataFrame, reference: DataFrame, as_of: AsOf) -> DataFrame:
    """Mark price and time against a reference, with the age of the mark."""
    right = reference.select(
        "perpetual_id", F.col("mark_pns").alias("ref_mark_pns"), F.col("timestamp_ms").alias("ref_timestamp_ms")
    )
    joined = right.join(marks, "perpetual_id", "left").withColumn(
        "mark_age_ms", F.lit(as_of.timestamp_ms) - F.col("timestamp_ms")
    )
    return compare_long(
        joined,
        ["perpetual_id", "mark_age_ms"],
        {
            "mark_pns": (F.col("mark_pns"), F.col("ref_mark_pns")),
            "timestamp_ms": (F.col("timestamp_ms"), F.col("ref_timestamp_ms")),
        },
    )


def rollup(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Worst status of a group: mismatch, then unverified, then matched."""
    status = F.col("status")
    return checks.groupBy(*keys).agg(
        F.when(F.bool_or(status == "mismatch"), "mismatch")
        .when(F.bool_or(status == "unverified"), "unverified")
        .otherwise("matched")
        .alias("status"),
        F.count(F.lit(1)).alias("checks"),
        F.count(F.when(status == "matched", F.lit(1))).alias("matched"),
    )


OBSERVED = ["symbol", "price_decimals", "size_decimals", "init_margin_frac_hdths", "maint_margin_frac_hdths"]


def observation_violations(observed: DataFrame) -> DataFrame:
    """Shape errors of observed market metadata rows."""
    bad = exploded(
        observed,
        ["perpetual_id"],
        {
            "bad_id": F.col("perpetual_id") <= 0,
            "bad_symbol": ~F.coalesce(F.length(F.trim("symbol")).between(1, 64), F.lit(False)),
            "bad_scale": ~F.coalesce(F.col("price_decimals").between(0, 18) & F.col("size_decimals").between(0, 18), F.lit(False)),
            "bad_margin": ~F.coalesce(
                (F.col("init_margin_frac_hdths") > 100)
                & (F.col("maint_margin_frac_hdths") >= F.col("init_margin_frac_hdths")),
                F.lit(False),
            ),
        },
    )
    repeated = observed.groupBy("perpetual_id").count().where("count > 1")
    return bad.unionByName(repeated.select("perpetual_id", F.lit("repeated_market").alias("violation")))


def observed_context(observed: DataFrame, observed_at_ms: int, as_of: AsOf, max_age_ms: int) -> DataFrame:
    """Normalised observation rows with a row hash and a stale flag."""
    stale = as_of.timestamp_ms - observed_at_ms > max_age_ms
    return observed.select(
        "perpetual_id",
        F.trim("symbol").alias("symbol"),
        *OBSERVED[1:],
        F.lit(stale).alias("stale"),
        digest_json(F.struct("perpetual_id", F.trim("symbol").alias("symbol"), *OBSERVED[1:])).alias("row_hash"),
    )


def registry_diff(registered: DataFrame, observed: DataFrame) -> DataFrame:
    """Registry against observed metadata: same, changed, new or absent."""
    left = registered.select("perpetual_id", F.struct(*OBSERVED).alias("known"))
    right = observed.select("perpetual_id", F.struct(*OBSERVED).alias("seen"))
    return left.join(right, "perpetual_id", "full_outer").select(
        "perpetual_id",
        F.when(F.col("known").isNull(), "new")
        .when(F.col("seen").isNull(), "absent")
        .when(F.col("known") == F.col("seen"), "same")
        .otherwise("changed")
        .alias("change"),
    )


def unproven_markets(events: DataFrame, proofs: DataFrame, as_of: AsOf) -> DataFrame:
    """Markets named by events that have no parameter proof."""
    named = events.where(as_of.includes() & F.col("perpetual_id").isNotNull()).select("perpetual_id").distinct()
    return named.join(proofs, "perpetual_id", "left_anti")


def proof_mismatches(registered: DataFrame, proofs: DataFrame) -> DataFrame:
    """Fields in which a parameter proof and the registry differ."""
    fields = OBSERVED[1:]
    right = proofs.select("perpetual_id", *[F.col(c).alias(f"p_{c}") for c in fields])
    joined = registered.join(right, "perpetual_id")
    rules = {f"{c}_differs": ~F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in fields}
    return exploded(joined, ["perpetual_id"], rules)


def coverage_state(rows: DataFrame) -> DataFrame:
    """Classify index observations; the rules apply in this order."""
    processed, head, last = F.col("processed_block"), F.col("chain_head_block"), F.col("last_event_block")
    start, lag = F.col("start_block"), F.col("chain_head_block") - F.col("processed_block")
    quarantined = F.col("quarantine_from_block").isNotNull()
    bad_range = (
        (F.col("quarantine_from_block") < 0)
        | F.coalesce(F.col("quarantine_to_block") < F.col("quarantine_from_block"), F.lit(False))
        | (F.trim(F.coalesce("quarantine_reason", F.lit(""))) == "")
    )
    outside = F.coalesce((last < start) | (last > processed), F.lit(False))
    silence = F.when(last.isNotNull(), processed - last).otherwise(F.greatest(processed - start + 1, F.lit(0).cast("long")))
    quiet = last.isNull() | (silence >= F.col("quiet_after_blocks"))
    rules = [
        ((start < 0) | (F.col("max_lag_blocks") < 0) | (F.col("quiet_after_blocks") < 1), "unknown", "invalid_classifier_configuration"),
        (F.coalesce(head < 0, F.lit(False)) | F.coalesce(last < 0, F.lit(False)), "unknown", "negative_block_observation"),
        (processed == -1, "unknown", "indexer_not_started"),
        (processed < start - 1, "unknown", "processed_block_before_configured_range"),
        (quarantined & bad_range, "unknown", "invalid_quarantine_range"),
        (quarantined, "quarantined", "active_quarantine"),
        (head.isNull(), "unknown", "missing_chain_head"),
        (processed.isNull(), "unknown", "missing_processed_block"),
        (processed > head, "unknown", "processed_block_ahead_of_chain_head"),
        (outside, "unknown", "last_match_outside_processed_range"),
        (lag > F.col("max_lag_blocks"), "lagging", "coverage_lag_exceeded"),
        (last.isNull(), "caught_up_quiet", "covered_range_has_no_matched_events"),
        (quiet, "caught_up_quiet", "coverage_current_event_stream_quiet"),
    ]
    state = reason = None
    for condition, name, why in rules:
        hit = F.coalesce(condition, F.lit(False))
        state = F.when(hit, name) if state is None else state.when(hit, name)
        reason = F.when(hit, why) if reason is None else reason.when(hit, why)
    graded = rows.withColumns(
        {
            "state": state.otherwise("caught_up_active"),
            "reason": reason.otherwise("coverage_current_recent_match"),
        }
    )
    measured = F.col("state").isin("lagging", "caught_up_quiet", "caught_up_active")
    return graded.withColumns(
        {
            "coverage_lag_blocks": F.when(measured, lag),
            "scanned_silence_blocks": F.when(measured & (F.col("state") != "lagging"), silence),
        }
    )


#: Hex digits by which the levels of a table's hash group rows: 4096 children a node at most.
PREFIXES = (9, 6, 3, 0)


def checkpoint_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, hash) of a table of any size, the same for every order and partitioning of its rows.

    Equal rows count once with their number; rows meet by the first digits of their own hash.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    level = rows.groupBy(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    level = level.select(F.sha2(F.concat_ws(":", "h", "n"), 256).alias("h"), "n")
    for digits in PREFIXES:
        level = level.groupBy(F.substring("h", 1, digits).alias("up") if digits == PREFIXES[0] else F.substring("up", 1, digits).alias("up")).agg(
            F.array_sort(F.collect_list("h")).alias("x"), F.sum("n").alias("n")
        ).select("up", F.sha2(F.array_join("x", ","), 256).alias("h"), "n")
    return level.select(F.col("n").alias("rows"), F.concat(F.lit("sha256:"), "h").alias("hash"))


def checkpoint_hashes(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (name, rows, hash) per table; an empty table has none."""
    parts = [checkpoint_hash(t, sorted(t.columns)).select(F.lit(name).alias("name"), "rows", "hash") for name, t in tables.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
