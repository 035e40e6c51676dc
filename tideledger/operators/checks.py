"""Fail-closed checks: every check is a DataFrame of violations.

``require_clean`` is strict mode (raise if any row exists); ``quarantine``
splits good rows from violations instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.functions.keys import event_key
from tideledger.params import AsOf, Coverage, Registry
from tideledger.schema import KINDS, REQUIRED_FIELDS

ADDRESS = r"^0x[0-9a-fA-F]{40}$"
MAX_MARK_AGE_MS = 60_000
INT48 = 2**47


def require_clean(violations: DataFrame, message: str) -> None:
    """Strict mode: one short-circuiting job, a single row reaches the driver."""
    found = violations.take(1)
    if found:
        raise DataQualityError(f"{message}: {found[0].asDict()}")


def codes(rules: dict[str, Column]) -> Column:
    """Array of the names of the rules that hold on a row."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def exploded(df: DataFrame, ids: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule."""
    return df.select(*ids, F.explode(codes(rules)).alias("violation"))


def guarded(df: DataFrame, key: str, rules: dict[str, Column], message: str) -> DataFrame:
    """The rows as they are; the job that reads a row with a broken rule fails and names it."""
    found = codes(rules)
    stop = F.raise_error(F.concat(F.lit(f"{message}: "), F.array_join(found, ", "), F.lit(f" at {key} "), F.coalesce(F.col(key).cast("string"), F.lit("none"))))
    return df.withColumn(key, F.when(F.size(found) == 0, F.col(key)).otherwise(stop))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    # A filter is not pushed below a generator, so the rules are evaluated once a row.
    marked = df.withColumn("violations", F.explode(F.array(codes(rules))))
    clean = F.size("violations") == 0
    return marked.where(clean).drop("violations"), marked.where(~clean)


def with_event_id(events: DataFrame) -> DataFrame:
    return events if "event_id" in events.columns else events.withColumn("event_id", event_key())


def event_rules(events: DataFrame) -> dict[str, Column]:
    """Per-event validation: required fields, ranges, sides and funding schedule."""
    kind = F.col("kind")
    needed: dict[str, list[str]] = {}
    for name, fields in REQUIRED_FIELDS.items():
        for field in fields:
            needed.setdefault(field, []).append(name)
    rules = {
        "unknown_kind": ~kind.isin(KINDS),
        "negative_timestamp": F.col("timestamp_ms") < 0,
        "blank_contract": F.col("contract_address").isNull() | (F.trim("contract_address") == ""),
        "bad_side": (F.col("position_type") < 0) | (F.col("position_type") > 2),
        "bad_residue": F.col("price_residue_pnsq16").isNotNull()
        & (
            (F.col("price_residue_pnsq16") >= 65_536)
            | (F.col("price_residue_pnsq16") < 0)
            | ~kind.isin("position_opened", "position_increased")
        ),
        "side_not_explicit": kind.isin("position_opened", "position_inverted")
        & ~F.coalesce(F.col("position_type").isin(1, 2), F.lit(False)),
        "mark_not_positive": (kind == "mark_updated") & (F.col("mark_price_pns") <= 0),
        "scale_too_large": (F.col("funding_scaling_exp") > 18) | (F.col("funding_scaling_exp") < 0),
        "funding_not_int48": reduce(
            lambda a, b: a | b,
            [
                F.coalesce((F.col(c) < -INT48) | (F.col(c) >= INT48), F.lit(False))
                for c in ("funding_payment_pns", "funding_sum_pns")
            ],
        ),
        "funding_schedule_incomplete": F.col("funding_event_block").isNotNull()
        & (
            (kind != "market_funding")
            | (F.col("funding_event_block") <= F.col("block_number"))
            | F.col("funding_allow_overwrite").isNull()
            | F.col("funding_payment_pns").isNull()
            | F.col("funding_sum_pns").isNull()
        ),
    }
    for field, kinds in needed.items():
        missing = F.col(field).isNull()
        if field == "owner":
            missing = missing | (F.trim(field) == "")
        rules[f"missing_{field}"] = kind.isin(kinds) & missing
    return rules


def validate_events(events: DataFrame) -> DataFrame:
    events = with_event_id(events)
    return exploded(events, ["event_id", "kind"], event_rules(events))


def unlisted_market_events(events: DataFrame, registry: Registry) -> DataFrame:
    """Events that name an unknown or unlisted market."""
    named = with_event_id(events).where(F.col("perpetual_id").isNotNull() & (F.col("kind") != "contract_added"))
    return named.join(registry.listed(events.sparkSession).select("perpetual_id"), "perpetual_id", "left_anti")


def row_guards(as_of: AsOf, registry: Registry) -> dict[str, Column]:
    """Per-row ledger guards for rows inside the cutoff."""
    return {
        "chain_mismatch": F.col("chain_id") != as_of.chain_id,
        "after_cutoff_time": F.col("timestamp_ms") > as_of.timestamp_ms,
        "wrong_contract": F.lower("contract_address") != registry.exchange_address.lower(),
        "before_deployment": F.col("block_number") < registry.deployed_at_block,
    }


def duplicate_positions(events: DataFrame) -> DataFrame:
    """(block, log) places that hold more than one event."""
    return events.groupBy("block_number", "log_index").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def duplicate_ids(events: DataFrame) -> DataFrame:
    return with_event_id(events).groupBy("event_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def mixed_block_hashes(events: DataFrame) -> DataFrame:
    """Blocks whose events disagree on the block hash (min/max needs no distinct)."""
    return (
        events.groupBy("block_number")
        .agg(F.min("block_hash").alias("lo"), F.max("block_hash").alias("hi"))
        .where("lo <> hi")
    )


def ledger_guards(events: DataFrame, registry: Registry, as_of: AsOf) -> DataFrame:
    """All ledger guard violations as (violation, subject)."""
    kept = with_event_id(events).where(as_of.includes())
    rows = exploded(kept, ["event_id"], row_guards(as_of, registry)).select("violation", F.col("event_id").alias("subject"))
    place = F.concat_ws("/", F.col("block_number"), F.col("log_index"))
    return (
        rows.unionByName(
            duplicate_ids(kept).select(F.lit("duplicate_event").alias("violation"), F.col("event_id").alias("subject"))
        )
        .unionByName(duplicate_positions(kept).select(F.lit("repeated_position").alias("violation"), place.alias("subject")))
        .unionByName(
            mixed_block_hashes(kept).select(
                F.lit("mixed_block_hash").alias("violation"), F.col("block_number").cast("string").alias("subject")
            )
        )
    )


def adjacent_duplicates(events: DataFrame) -> DataFrame:
    """Later rows that repeat the (block, log) of an earlier one."""
    w = Window.partitionBy("block_number", "log_index").orderBy("tx_hash", "event_id")
    return with_event_id(events).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def registry_rules(registry: Registry, spark) -> DataFrame:
    """Violations of the market dimension and its constants."""
    document = spark.range(1).select(
        F.explode(
            codes(
                {
                    "no_chain": F.lit(registry.chain_id <= 0),
                    "no_deployment": F.lit(registry.deployed_at_block <= 0),
                    "no_markets": F.lit(not registry.markets),
                    "bad_exchange_address": ~F.lit(registry.exchange_address).rlike(ADDRESS),
                    "bad_collateral_scale": F.lit(not 0 <= registry.collateral_decimals <= 18),
                    "repeated_exclusion": F.lit(len(set(registry.excluded)) != len(registry.excluded)),
                }
            )
        ).alias("violation"),
        F.lit(None).cast("int").alias("perpetual_id"),
    )
    markets = registry.frame(spark)
    per_market = exploded(
        markets,
        ["perpetual_id"],
        {
            "bad_scale": ~F.col("price_decimals").between(0, 18) | ~F.col("size_decimals").between(0, 18),
            "bad_initial_fraction": F.col("init_margin_frac_hdths") <= 100,
            "maintenance_below_initial": F.col("maint_margin_frac_hdths") < F.col("init_margin_frac_hdths"),
            "bad_id": F.col("perpetual_id") <= 0,
            "bad_symbol": ~F.coalesce(F.col("symbol").rlike(r"^[\x20-\x7e]{1,64}$") & (F.trim("symbol") != ""), F.lit(False)),
            "excluded_but_listed": F.col("perpetual_id").isin(list(registry.excluded)) & F.col("listed"),
        },
    )
    repeated = (
        markets.groupBy("perpetual_id").count().where("count > 1").select("perpetual_id", F.lit("repeated_market").alias("violation"))
    )
    return document.unionByName(per_market).unionByName(repeated)


def mark_rules(as_of: AsOf) -> dict[str, Column]:
    """Integrity of a supplied mark; staleness is not an integrity fault."""
    same_block = F.col("block_number") == as_of.block_number
    rules = {
        "future_or_negative": (F.col("timestamp_ms") < 0)
        | (F.col("timestamp_ms") > as_of.timestamp_ms)
        | (F.col("block_number") > as_of.block_number),
        "price_not_positive": (F.col("mark_pns") <= 0) | F.coalesce(F.col("oracle_pns") <= 0, F.lit(False)),
    }
    other_hash = F.col("block_hash") != as_of.block_hash
    if as_of.log_index is None:
        rules["other_block_hash"] = same_block & other_hash
    else:
        late = F.coalesce(F.col("log_index") > as_of.log_index, F.lit(True))
        rules["not_at_cutoff"] = same_block & (late | F.coalesce(other_hash, F.lit(True)))
    return rules


def mark_violations(marks: DataFrame, as_of: AsOf) -> DataFrame:
    bad = exploded(marks, ["perpetual_id"], mark_rules(as_of))
    repeated = marks.groupBy("perpetual_id").count().where("count > 1")
    return bad.unionByName(repeated.select("perpetual_id", F.lit("repeated_market").alias("violation")))


def mark_is_fresh(as_of: AsOf, timestamp: str = "timestamp_ms") -> Column:
    return (F.lit(as_of.timestamp_ms) - F.col(timestamp)) < MAX_MARK_AGE_MS


def ledger_gate(events: DataFrame, as_of: AsOf, coverage: Coverage, max_lag_blocks: int | None = None) -> DataFrame:
    """One row: gate status, lag of coverage and silence since the last event."""
    kept = events.where(as_of.includes())
    facts = kept.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("block_number").alias("first_event_block"),
        F.max("block_number").alias("last_event_block"),
    )
    lag = max(0, as_of.block_number - coverage.processed_block)
    silence = F.greatest(F.lit(0).cast("long"), F.lit(coverage.processed_block) - F.col("last_event_block"))
    status = (
        F.when(F.lit(coverage.chain_id != as_of.chain_id), "chain-mismatch")
        .when(F.col("event_count") == 0, "empty-ledger")
        .when(F.col("last_event_block") > coverage.processed_block, "event-after-coverage")
        .when(F.col("first_event_block") < coverage.start_block, "event-before-coverage")
        .when(F.lit(max_lag_blocks is not None and lag > (max_lag_blocks or 0)), "coverage-stale")
        .otherwise("eligible")
    )
    return facts.select(
        status.alias("status"),
        "event_count",
        "last_event_block",
        F.lit(lag).cast("long").alias("coverage_lag_blocks"),
        F.when(F.col("last_event_block").isNotNull(), silence).alias("event_silence_blocks"),
    )


def require_gate(events: DataFrame, as_of: AsOf, coverage: Coverage, max_lag_blocks: int | None = None) -> dict:
    row = ledger_gate(events, as_of, coverage.validate(), max_lag_blocks).first().asDict()
    if row["status"] != "eligible":
        raise DataQualityError(f"ledger gate: {row['status']} (lag {row['coverage_lag_blocks']} blocks)")
    return row


def metric_gate(metrics: DataFrame) -> DataFrame:
    """Violations of the protocol metrics: negative volume, interest or value locked."""
    return exploded(
        metrics,
        ["perpetual_id"],
        {
            "negative_volume": F.col("taker_volume_u") < 0,
            "negative_open_interest": F.col("open_interest_u") < 0,
            "negative_value_locked": F.col("tvl_u") < 0,
        },
    )


def analytics_gate(events: DataFrame, as_of: AsOf, basis: Coverage) -> DataFrame:
    """Rows that may not enter window analytics."""
    kept = with_event_id(events)
    inside = as_of.includes()
    return exploded(
        kept,
        ["event_id"],
        {
            "chain_mismatch": F.col("chain_id") != as_of.chain_id,
            "after_cutoff_time": inside & (F.col("timestamp_ms") > as_of.timestamp_ms),
            "before_coverage": inside & (F.col("block_number") < basis.start_block),
        },
    )


def distinct_scope(ids: DataFrame, column: str, most: int = 20) -> DataFrame:
    """One row: is the id scope non-empty, distinct and within its bound?"""
    return ids.agg(
        F.count(column).alias("ids"), F.countDistinct(column).alias("distinct_ids")
    ).withColumn("valid", (F.col("ids") == F.col("distinct_ids")) & F.col("ids").between(1, most))
