"""JSON documents: event bundles, market registries and evidence exports."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError
from tideledger.operators.checks import registry_rules, require_clean, with_event_id
from tideledger.params import MAX_REGISTRY_MARKETS, AsOf, Coverage, FundingScope, Registry
from tideledger.schema import EVENT, MARK

REGISTRY_SCHEMA = (
    "chain_id long, exchange_address string, deployed_at_block long, collateral struct<symbol string, address string, decimals int>,"
    " excluded_perpetuals array<int>, markets array<struct<perpetual_id int, symbol string, price_decimals int, size_decimals int,"
    " init_margin_frac_hdths int, maint_margin_frac_hdths int, listed boolean>>"
)
BUNDLE_SCHEMA = (
    f"name string, registry_file string, registry struct<{REGISTRY_SCHEMA}>,"
    " coverage struct<chain_id long, start_block long, processed_block long>,"
    " as_of struct<chain_id long, block_number long, block_hash string, timestamp_ms long, log_index int>,"
    f" events array<{EVENT.simpleString()}>, market_state array<{MARK.simpleString()}>,"
    " window_start_ms long, funding_coverage_markets array<int>"
)


@dataclass(frozen=True)
class Bundle:
    name: str
    events: DataFrame
    marks: DataFrame
    as_of: AsOf
    coverage: Coverage
    registry: Registry
    window_start_ms: int | None
    scope: FundingScope | None


def _registry(row) -> Registry:
    markets = row.markets or []
    if not markets:
        raise DataQualityError("registry has no markets")
    if len(markets) > MAX_REGISTRY_MARKETS:
        raise DataQualityError("registry has too many markets")
    ids = [m.perpetual_id for m in markets]
    if len(set(ids)) != len(ids):
        raise DataQualityError("registry repeats a market id")
    rows = tuple({**m.asDict(), "listed": m.listed is not False} for m in markets)
    return Registry(
        row.chain_id, row.exchange_address, row.deployed_at_block, row.collateral.decimals, rows,
        tuple(row.excluded_perpetuals or ()), row.collateral.symbol,
    )


def _one_document(df: DataFrame, what: str):
    """A document is one row of scalars; two or none is an error."""
    rows = df.take(2)
    if len(rows) != 1:
        raise DataQualityError(f"{what} must hold exactly one document")
    return rows[0]


def read_registry(spark: SparkSession, path: str) -> Registry:
    docs = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    registry = _registry(_one_document(docs, "registry"))
    require_clean(registry_rules(registry, spark), "invalid registry")
    return registry


def read_bundle(spark: SparkSession, path: str, root: str | None = None) -> Bundle:
    """One event bundle. Its events and marks stay distributed; scalars come to the driver."""
    docs = spark.read.schema(BUNDLE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = _one_document(
        docs.select(*[c for c in docs.columns if c not in ("events", "market_state")], F.size("events").alias("n")), "bundle"
    )
    if not head.n or head.n < 1:
        raise DataQualityError("bundle has no events")
    if head.registry is not None:
        registry = _registry(head.registry)
    elif head.registry_file:
        base = PurePosixPath(root) if root else PurePosixPath(path).parent
        registry = read_registry(spark, str(base / head.registry_file))
    else:
        raise DataQualityError("bundle names no registry")
    as_of, cover = AsOf(**head.as_of.asDict()), Coverage(**head.coverage.asDict())
    if len({registry.chain_id, as_of.chain_id, cover.chain_id}) != 1:
        raise DataQualityError("bundle mixes chains")
    scope = None
    if head.funding_coverage_markets:
        scope = FundingScope(cover.start_block, as_of.block_number, tuple(head.funding_coverage_markets))
    return Bundle(
        head.name or PurePosixPath(path).stem,
        with_event_id(docs.select(F.inline("events"))),
        docs.select(F.inline("market_state")),
        as_of,
        cover.validate(),
        registry,
        head.window_start_ms,
        scope,
    )


def export_evidence(df: DataFrame, path: str) -> None:
    """Write to a new path only; an existing path is an error."""
    df.write.mode("errorifexists").json(path)
