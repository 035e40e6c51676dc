"""Range reads, point look-ups and paging over the canonical event table.

Every function is a filter with literal bounds on block, account or market, so
bounds reach the Parquet scan of the event table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.operators.checks import require_clean, with_event_id
from tideledger.operators.ledger import kind_is, latest_marks, sequence
from tideledger.params import AsOf, Coverage
from tideledger.schema import FUNDING_KINDS

MAX_PAGE, DEFAULT_PAGE, MAX_OFFSET = 1_000, 100, 100_000


def after(cursor: tuple[int, int]) -> Column:
    """Rows after a (block, log) cursor, written so the block bound is pushed down."""
    block, log = cursor
    return (F.col("block_number") >= block) & (
        (F.col("block_number") > block) | (F.col("log_index") > log)
    )


def scan_ordered(events: DataFrame, as_of: AsOf) -> DataFrame:
    """The whole table in (block, log, id) order: a range-partitioned sort."""
    return with_event_id(events.where(as_of.includes())).orderBy("block_number", "log_index", "event_id")


def scan_range(events: DataFrame, cursor: tuple[int, int], as_of: AsOf, budget: int | None = None) -> DataFrame:
    found = with_event_id(events.where(after(cursor) & as_of.includes()))
    if budget is not None and found.limit(budget + 1).count() > budget:
        raise DataQualityError(f"range holds more than {budget} events")
    return found


def scan_accounts(events: DataFrame, accounts: DataFrame, coverage: Coverage, as_of: AsOf) -> DataFrame:
    """Histories of many accounts in one read (semi join, not one read per account)."""
    inside = F.col("block_number") >= coverage.start_block
    found = with_event_id(events.where(F.col("account_id").isNotNull() & inside & as_of.includes()))
    return found.join(accounts.select("account_id").distinct(), "account_id", "left_semi")


def market_inputs(events: DataFrame, markets: DataFrame, as_of: AsOf) -> DataFrame:
    """Latest mark plus all funding inputs of the wanted markets, and markets without a mark."""
    marks = latest_marks(events, as_of).select("perpetual_id", F.lit("mark").alias("role"), F.col("mark_event_id").alias("event_id"))
    funding = with_event_id(events.where(kind_is(*FUNDING_KINDS) & as_of.includes())).select(
        "perpetual_id", F.when(kind_is("market_funding"), "funding").otherwise("scale").alias("role"), "event_id"
    )
    missing = markets.join(marks, "perpetual_id", "left_anti").select(
        "perpetual_id", F.lit("missing").alias("role"), F.lit(None).cast("string").alias("event_id")
    )
    wanted = marks.unionByName(funding).join(markets, "perpetual_id", "left_semi")
    return wanted.unionByName(missing)


def coverage_probe(events: DataFrame, coverage: Coverage, as_of: AsOf) -> DataFrame:
    kept = with_event_id(events.where(as_of.includes()))
    facts = kept.agg(
        F.count(F.lit(1)).alias("events"),
        F.min("block_number").alias("first_block"),
        F.max("block_number").alias("last_block"),
        F.max_by("event_id", sequence()).alias("latest_event_id"),
    )
    inside = (F.col("first_block") >= coverage.start_block) & (F.col("last_block") <= coverage.processed_block)
    return facts.withColumn("in_range", inside)


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    """Point look-up. The block is part of no id, so give ``scan_range`` bounds where known."""
    return with_event_id(events).where(F.col("event_id") == event_id)


def verify_point(events: DataFrame, point: DataFrame) -> DataFrame:
    """Is an earlier seen event (one row) still there with the same place and time?"""
    expected = point.select(
        "event_id", *[F.col(c).alias(f"e_{c}") for c in ("block_number", "log_index", "timestamp_ms")]
    )
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("block_number", "log_index", "timestamp_ms")]
    found = with_event_id(events).join(F.broadcast(expected), "event_id", "right")
    return found.withColumn("unchanged", reduce(lambda a, c: a & c, same))


def event_query(
    events: DataFrame,
    coverage: Coverage,
    *,
    account_id: int | None = None,
    perpetual_id: int | None = None,
    from_block: int | None = None,
    to_block: int | None = None,
    offset: int = 0,
    limit: int = DEFAULT_PAGE,
) -> DataFrame:
    """One page of events by account, market and block range."""
    low = coverage.start_block if from_block is None else from_block
    high = coverage.processed_block if to_block is None else to_block
    if not coverage.start_block <= low <= high <= coverage.processed_block:
        raise DataQualityError("event query leaves the covered block range")
    if not 0 <= offset <= MAX_OFFSET or not 1 <= limit <= MAX_PAGE:
        raise DataQualityError("event query page is out of bounds")
    found = events.where(F.col("block_number").between(low, high))
    if account_id is not None:
        found = found.where(F.col("account_id") == account_id)
    if perpetual_id is not None:
        found = found.where(F.col("perpetual_id") == perpetual_id)
    return with_event_id(found).orderBy("block_number", "log_index").offset(offset).limit(limit)


def page_after(events: DataFrame, cursor: tuple[int, int], as_of: AsOf, limit: int) -> DataFrame:
    """Keyset page: the next ``limit`` rows after the cursor."""
    return scan_range(events, cursor, as_of).orderBy("block_number", "log_index").limit(limit)


def event_view(events: DataFrame) -> DataFrame:
    """The evidence projection of an event."""
    return with_event_id(events).select(
        "event_id", "abi_event_name", "kind", "account_id", "perpetual_id", "block_number", "log_index", "timestamp_ms",
        "funding_event_block", "funding_payment_pns", "funding_sum_pns", "funding_scaling_exp", "mark_price_pns",
        F.col("provenance.schema_version").alias("schema_version"),
        F.col("provenance.ingestion_profile").alias("ingestion_profile"),
    )


def scope_facts(events: DataFrame, first: int, last: int, anchor: Column) -> DataFrame:
    """Count, ends, anchor presence and rows outside of a pinned block window."""
    outside = (F.col("block_number") < first) | (F.col("block_number") > last)
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.min("block_number").alias("first_block"),
        F.max("block_number").alias("last_block"),
        F.coalesce(F.bool_or(anchor), F.lit(False)).alias("anchored"),
        F.count(F.when(outside, F.lit(1))).alias("outside"),
    )


def require_scope(facts: DataFrame, events: int) -> None:
    row = facts.first()
    if row.events != events or not row.anchored or row.outside:
        raise DataQualityError(f"pinned window does not match its evidence: {row.asDict()}")


@dataclass(frozen=True)
class Header:
    """An independently read block header."""

    block_number: int
    block_hash: str
    timestamp_ms: int


@dataclass(frozen=True)
class PinnedWindow:
    """What a pinned window must be: its two boundary headers, its number of events, its last event."""

    chain_id: int
    contract_address: str
    first: Header
    last: Header
    events: int
    anchor_event_id: str

    def __post_init__(self):
        if self.first.block_number > self.last.block_number or self.first.timestamp_ms > self.last.timestamp_ms or self.events < 1:
            raise DataQualityError("a pinned window runs forward and holds events")


def pinned_violations(events: DataFrame, pin: PinnedWindow) -> DataFrame:
    """(violation, events) of an unfiltered window, in one pass; an empty table means that it holds.

    A row may break several rules.  The count and the anchor are rules of the whole window.
    """
    block, time = F.col("block_number"), F.col("timestamp_ms")

    def differs(header: Header):
        return (block == header.block_number) & ((F.col("block_hash") != header.block_hash) | (time != header.timestamp_ms))

    rules = {
        "outside_blocks": (block < pin.first.block_number) | (block > pin.last.block_number),
        "outside_times": (time < pin.first.timestamp_ms) | (time > pin.last.timestamp_ms),
        "chain_differs": F.col("chain_id") != pin.chain_id,
        "contract_differs": F.lower("contract_address") != pin.contract_address.lower(),
        "first_header_differs": differs(pin.first),
        "last_header_differs": differs(pin.last),
    }
    facts = with_event_id(events).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or((F.col("event_id") == pin.anchor_event_id) & (block <= pin.last.block_number)), F.lit(False)).alias("anchored"),
        *[F.count(F.when(F.coalesce(rule, F.lit(True)), F.lit(1))).alias(name) for name, rule in rules.items()],
    )
    found = [F.struct(F.lit(name).alias("violation"), F.col(name).alias("events")) for name in rules]
    found.append(F.struct(F.lit("count_differs").alias("violation"), F.when(F.col("n") != pin.events, F.greatest("n", F.lit(1))).otherwise(0).alias("events")))
    found.append(F.struct(F.lit("anchor_absent").alias("violation"), F.when(~F.col("anchored"), F.greatest("n", F.lit(1))).otherwise(0).alias("events")))
    return facts.select(F.explode(F.array(*found)).alias("v")).select("v.*").where("events > 0")


def require_pinned(events: DataFrame, pin: PinnedWindow) -> DataFrame:
    """The window, if it is the pinned one."""
    require_clean(pinned_violations(events, pin), "window is not the pinned one")
    return events


def recent_start(deployed: int, head: int, blocks: int) -> int:
    """First block of an inclusive recent window, not before deployment."""
    if blocks < 1 or deployed < 0 or head < deployed:
        raise DataQualityError("recent window needs at least one block after deployment")
    return max(head - blocks + 1, deployed, 0)


def conflicting_ids(rows: DataFrame) -> DataFrame:
    """Event ids that carry different facts."""
    payload = F.xxhash64(*[F.col(c) for c in sorted(rows.columns) if c != "event_id"])
    return (
        rows.select("event_id", payload.alias("h")).groupBy("event_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
    )


def union_dedupe(parts: list[DataFrame], *, strict: bool = True) -> DataFrame:
    """Union of event sets; the same id must mean the same row."""
    rows = [with_event_id(p) for p in parts]
    merged = reduce(lambda a, c: a.unionByName(c), rows)
    if strict:
        require_clean(conflicting_ids(merged), "one event id carries different facts")
    return merged.dropDuplicates(["event_id"])
