"""Scalar inputs of a run: cutoff, coverage and the market registry."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.errors import DataQualityError

# A registry is one hand-written document; this bound is checked before any broadcast.
MAX_REGISTRY_MARKETS = 10_000


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class AsOf:
    """A point in the event order. Without a log index the whole block counts."""

    chain_id: int
    block_number: int
    block_hash: str
    timestamp_ms: int
    log_index: int | None = None

    def includes(self, block="block_number", log="log_index") -> Column:
        block, log = col(block), col(log)
        if self.log_index is None:
            return block <= F.lit(self.block_number)
        return (block < F.lit(self.block_number)) | (
            (block == F.lit(self.block_number)) & (log <= F.lit(self.log_index))
        )


@dataclass(frozen=True)
class Coverage:
    """Range of blocks an indexer has processed."""

    chain_id: int
    start_block: int
    processed_block: int
    start_timestamp_ms: int | None = None

    def validate(self) -> "Coverage":
        if self.start_block < 0 or self.processed_block < self.start_block:
            raise DataQualityError("coverage range is inverted or negative")
        return self


@dataclass(frozen=True)
class FundingScope:
    """Markets and blocks for which every funding input was observed."""

    start_block: int
    end_block: int
    market_ids: tuple[int, ...]

    def validate(self, registry: "Registry", as_of: AsOf) -> "FundingScope":
        ids = self.market_ids
        if not 1 <= len(ids) <= 20 or len(set(ids)) != len(ids):
            raise DataQualityError("funding scope needs 1 to 20 distinct markets")
        if not registry.deployed_at_block <= self.start_block <= as_of.block_number:
            raise DataQualityError("funding scope starts outside deployment and cutoff")
        if self.end_block != as_of.block_number:
            raise DataQualityError("funding scope must end at the cutoff block")
        listed = {m["perpetual_id"] for m in registry.markets if m["listed"]}
        if not set(ids) <= listed:
            raise DataQualityError("funding scope names an unlisted market")
        return self


MARKET_FIELDS = pa.schema(
    [
        ("perpetual_id", pa.int32()),
        ("symbol", pa.string()),
        ("price_decimals", pa.int32()),
        ("size_decimals", pa.int32()),
        ("init_margin_frac_hdths", pa.int32()),
        ("maint_margin_frac_hdths", pa.int32()),
        ("listed", pa.bool_()),
    ]
)


@dataclass(frozen=True)
class Registry:
    """Protocol constants plus the (small, size-checked) market dimension."""

    chain_id: int
    exchange_address: str
    deployed_at_block: int
    collateral_decimals: int
    markets: tuple[dict, ...] = field(default_factory=tuple)
    excluded: tuple[int, ...] = ()
    collateral_symbol: str = "AUSD"

    def __post_init__(self):
        if len(self.markets) > MAX_REGISTRY_MARKETS:
            raise DataQualityError("registry has too many markets to broadcast")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [{name: m.get(name) for name in MARKET_FIELDS.names} for m in self.markets]
        return spark.createDataFrame(pa.Table.from_pylist(rows, schema=MARKET_FIELDS))

    def listed(self, spark: SparkSession) -> DataFrame:
        """Listed markets as a broadcast side of at most MAX_REGISTRY_MARKETS rows."""
        return F.broadcast(self.frame(spark).where("listed").drop("listed"))

    def attach(self, rows: DataFrame) -> DataFrame:
        """Market columns on every row; a row of a market that is not listed fails the job."""
        known = rows.join(self.listed(rows.sparkSession), "perpetual_id", "left")
        stop = F.raise_error(F.concat(F.lit("market is not listed: "), F.coalesce(F.col("perpetual_id").cast("string"), F.lit("none"))))
        checked = {c: F.when(F.col("symbol").isNull(), stop).otherwise(F.col(c)) for c in ("price_decimals", "size_decimals")}
        return known.withColumns({**checked, "symbol": F.when(F.col("symbol").isNull(), stop).otherwise(F.col("symbol"))})


def local_frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A small constant table (rules, shocks, windows) as a local relation."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
