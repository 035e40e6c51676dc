"""Mixing sources to target weights by a Pfair schedule; rows pass DataFrame functions only.

Rows of a source form blocks of `block_rows`.  The target is a fluid mix: at every moment the
sources that still have rows share the slots by their weights, exactly as given, so a source
that runs out leaves its share to the others by their weights.  Block k (from 0) of a source
may start in the slot in which the fluid mix starts it, and is due when the fluid mix has
finished it; each slot takes the startable block with the earliest deadline.  For one resource
that is used in full this keeps every source less than one block from its target at every
slot, for any weights, any number of sources and to the last block; no row is dropped.

The driver reads one count per source and takes one step per block (one per `block_rows` rows);
what it plans is written in pieces of PIECE blocks, so it holds one piece and one block of each
source.  The plan is broadcast up to SMALL_PLAN blocks and joined by (source, block) above.

A row's number inside its source comes from counts of hash buckets and a window inside one
bucket, so a source with a third of all rows is spread over BUCKETS windows.

Defined results: a null source counts as the empty name; repeated rows are separate rows;
nulls in other columns pass through; an empty table gives an empty result; a source without
a weight gets 1 / SLOTS of the sum of the weights, all such sources together at most as much as
the others.  With `slots` the weights are first rounded to whole units out of so many, which
needs as many slots as sources.  Columns named `position` are replaced.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideledger.llm.shared import Workspace

BLOCK_ROWS = 64
SLOTS = 1024
BUCKETS = 4096
PIECE = 1 << 20
SMALL_PLAN = 1 << 18


def whole_units(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Weights as units that add up to `slots`, by largest remainders; at least one each."""
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources need at least as many slots, not {slots}")
    total = sum(weights.values())
    if total <= 0:
        weights, total = dict.fromkeys(weights, 1.0), len(weights)
    spare = slots - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    units = {s: 1 + int(x) for s, x in exact.items()}
    left = slots - sum(units.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        units[s] += 1
    return units


def all_weighted(weights: dict[str, float]) -> dict[str, float]:
    """The weights, with a small one for sources that have none."""
    given = [w for w in weights.values() if w > 0]
    without = len(weights) - len(given)
    if not given:
        return dict.fromkeys(weights, 1.0)
    least = sum(given) / max(SLOTS, without)
    return {s: w if w > 0 else least for s, w in weights.items()}


def phases(blocks: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """Stretches between two moments at which a source runs out in the fluid mix.  Time `since`
    counts blocks per unit of weight; `base` slots lie before, `width` slots pass per unit of time."""
    ends = sorted((n / weights[s], s) for s, n in blocks.items() if n > 0)
    widths, width = [], 0
    for _, s in reversed(ends):
        width += weights[s]
        widths.append(width)
    out, since, base = [], 0.0, 0.0
    for (end, _), width in zip(ends, reversed(widths), strict=True):
        if end > since:
            out.append({"since": since, "base": base, "width": width})
            base += (end - since) * width
            since = end
    return out


def in_slots(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """The block (source, number) of each slot."""
    stretches = phases(blocks, weights)
    since = [p["since"] for p in stretches]

    def slot(time: float) -> float:
        p = stretches[max(0, bisect_left(since, time) - 1)]
        return p["base"] + (time - p["since"]) * p["width"]

    def job(s: str, k: int) -> tuple[int, int, str, int]:
        begin, end = slot(k / weights[s]), slot((k + 1) / weights[s])
        slack = 1e-7 + 1e-12 * end  # for rounding errors
        return floor(begin + slack), ceil(end - slack), s, k

    later = [job(s, 0) for s, n in blocks.items() if n > 0]
    heapq.heapify(later)
    ready: list[tuple[int, str, int]] = []
    for t in range(sum(blocks.values())):
        while later and (later[0][0] <= t or not ready):
            heapq.heappush(ready, heapq.heappop(later)[1:])
        _, s, k = heapq.heappop(ready)
        yield s, k
        if k + 1 < blocks[s]:
            heapq.heappush(later, job(s, k + 1))


def schedule(spark, blocks: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """Rows (_mix_plan, _mix_number, _mix_slot): the slot of each block of each source."""
    path, order, slot = Workspace(spark, "mix").path("plan"), in_slots(blocks, weights), 0
    while piece := list(islice(order, PIECE)):
        columns = {"_mix_plan": pa.array([s for s, _ in piece], pa.string()), "_mix_number": pa.array([k for _, k in piece], pa.int64()), "_mix_slot": pa.array(range(slot, slot + len(piece)), pa.int64())}
        spark.createDataFrame(pa.table(columns)).write.mode("append").parquet(path)
        slot += len(piece)
    plan = spark.read.schema("_mix_plan string, _mix_number long, _mix_slot long").parquet(path)
    return F.broadcast(plan) if slot <= SMALL_PLAN else plan


def mix(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS, slots: int | None = None, power: float = 0.5) -> DataFrame:
    """The rows with a `position` that orders them into the mix.

    Without `weights` a source weighs its number of rows to the given power.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(3)), F.lit(BUCKETS)).cast("int")
    tally = docs.groupBy(name.alias("_name"), bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = tally.withColumn("_start", F.coalesce(before, F.lit(0)))
    counts = {r["_name"]: r["n"] for r in tally.groupBy("_name").agg(F.sum("_n").alias("n")).collect()}
    if not counts:
        return docs.drop("position").withColumn("position", F.lit(0).cast("long"))
    wanted = weights if weights is not None else {s: float(n) ** power for s, n in counts.items()}
    wanted = {s: max(0.0, wanted.get(s, 0.0)) for s in counts}
    plan = schedule(spark, {s: -(-n // block_rows) for s, n in counts.items()}, all_weighted(wanted) if slots is None else whole_units(wanted, slots))

    starts = starts.select(F.col("_name").alias("_mix_name"), F.col("_bucket").alias("_mix_bucket"), F.col("_start").alias("_mix_start"))

    rows = docs.drop("position").withColumns({"_mix_name": name, "_mix_bucket": bucket})
    rank = F.row_number().over(W.partitionBy("_mix_name", "_mix_bucket").orderBy(F.xxhash64(F.col(f"`{key}`"), F.lit(5)), F.col(f"`{key}`")))
    ranked = rows.withColumn("_mix_rank", rank).join(starts, ["_mix_name", "_mix_bucket"])
    number = F.col("_mix_start") + F.col("_mix_rank") - 1
    placed = ranked.withColumns({"_mix_block": ((number - number % block_rows) / block_rows).cast("long"), "_mix_offset": number % block_rows})
    placed = placed.join(plan, (F.col("_mix_name") == F.col("_mix_plan")) & (F.col("_mix_block") == F.col("_mix_number")))
    position: Column = (F.col("_mix_slot") * block_rows + F.col("_mix_offset")).cast("long")
    return placed.withColumn("position", position).select(*[f"`{c}`" for c in docs.columns if c != "position"], "position")


def in_order(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, written files in the order of the mix (columns as given)."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(how.get("key", "doc_id")), F.col(how.get("source", "source")))
    return mix(own, **how).repartitionByRange("position").sortWithinPartitions("position").select("row.*")
