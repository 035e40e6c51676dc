"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.catalog import binding as b
from tideledger.functions.exact import to_long, trunc_div
from tideledger.operators import accounting, analytics, funding
from tideledger.operators.ledger import position_state
from tideledger.params import AsOf, Coverage, FundingScope

CNS_UNITS = 65536 * 10**8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def cns(value: Column | str) -> Column:
    """Unit amount as whole millionths of a coin."""
    return to_long(trunc_div(F.col(value) if isinstance(value, str) else value, CNS_UNITS))


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def scope_at(cut: AsOf) -> FundingScope:
    return FundingScope(b.DEPLOYED, cut.block_number, b.SCOPE.market_ids)


def history(spark, sf, cut: AsOf = b.CUT) -> DataFrame:
    return b.planned(spark, ("history", sf, cut), lambda: _history(spark, sf, cut))


def positions(spark, sf, cut: AsOf = b.CUT) -> DataFrame:
    """Funded and priced positions of the book at a cutoff."""
    return b.planned(spark, ("positions", sf, cut), lambda: _positions(spark, sf, cut))


def plain_positions(spark, sf, cut: AsOf = b.CUT) -> DataFrame:
    """Priced positions without funding: one aggregation over the events."""
    return b.planned(spark, ("plain", sf, cut), lambda: _plain_positions(spark, sf, cut))


def _history(spark, sf, cut: AsOf) -> DataFrame:
    return funding.funded_history(b.book(spark, sf), b.REGISTRY, cut, scope_at(cut))


def _positions(spark, sf, cut: AsOf) -> DataFrame:
    events = b.book(spark, sf)
    state = funding.funded_state(history(spark, sf, cut), b.REGISTRY, scope_at(cut))
    return accounting.price_positions(state, b.supplied_marks(events, cut), b.REGISTRY, cut)


def _plain_positions(spark, sf, cut: AsOf) -> DataFrame:
    events = b.book(spark, sf)
    return accounting.price_positions(position_state(events, cut), b.supplied_marks(events, cut), b.REGISTRY, cut)


def states(spark, sf, cut: AsOf = b.CUT) -> DataFrame:
    return analytics.market_state(plain_positions(spark, sf, cut))


def eligibility(spark, sf, cut: AsOf = b.CUT, basis: Coverage = b.BOUNDED) -> DataFrame:
    return accounting.replay_eligibility(b.book(spark, sf), cut, basis, b.REGISTRY)


def wallet_rows(spark, sf, cut: AsOf = b.CUT) -> DataFrame:
    return accounting.wallets(b.book(spark, sf), positions(spark, sf, cut), b.REGISTRY, cut)
