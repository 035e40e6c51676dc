"""Running sums and last-known values in event order, safe for hot keys.

A plain window sends every row of a key to one task.  Here the rows of a key are cut into
ranges of equal width on the first order column, always and for every key: each range runs its
own window, a summary per range (partial sums, last and first values) is carried into the
later ranges.  A task holds one range of a key; what is scanned per key is one row per range.
The plan does not depend on the size of the data, and nothing runs while it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a range in blocks: about a day.
RANGE_WIDTH = 216_000


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    range_width: int = RANGE_WIDTH,
) -> DataFrame:
    """Add ordered columns per key; ``order[0]`` must be an integer axis.

    sums:   running total up to and including the row (nulls count as 0)
    lasts:  last non-null value up to and including the row
    before: last non-null value strictly before the row
    leads:  value of the next row of the key
    """
    sums, lasts, before, leads = sums or {}, lasts or {}, before or {}, leads or {}
    inputs = {f"_in_{n}": e for part in (sums, lasts, before, leads) for n, e in part.items()}
    base = df.withColumns(inputs)
    tagged = base.withColumn("_range", F.floor(F.col(order[0]) / F.lit(range_width)).cast("long"))
    in_range = Window.partitionBy(*keys, "_range").orderBy(*order)
    upto = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = in_range.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_out_{n}": F.sum(F.col(f"_in_{n}")).over(upto) for n in sums}
    local |= {f"_out_{n}": F.last(F.col(f"_in_{n}"), True).over(upto) for n in lasts}
    local |= {f"_out_{n}": F.last(F.col(f"_in_{n}"), True).over(prior) for n in before}
    local |= {f"_out_{n}": F.lead(F.col(f"_in_{n}")).over(in_range) for n in leads}
    if leads:
        local["_is_last"] = F.lead(F.lit(True)).over(in_range).isNull()
    rows = tagged.withColumns(local)

    position = F.struct(*[F.col(c) for c in order])
    summary = [F.sum(F.col(f"_in_{n}")).alias(f"_part_{n}") for n in sums]
    for n in [*lasts, *before]:
        value = F.col(f"_in_{n}")
        summary.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(f"_part_{n}"))
    summary += [F.min_by(F.col(f"_in_{n}"), position).alias(f"_part_{n}") for n in leads]
    ranges = tagged.groupBy(*keys, "_range").agg(*summary)
    by_key = Window.partitionBy(*keys).orderBy("_range")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_carry_{n}": F.sum(F.col(f"_part_{n}")).over(earlier) for n in sums}
    carried |= {f"_carry_{n}": F.last(F.col(f"_part_{n}"), True).over(earlier) for n in [*lasts, *before]}
    carried |= {f"_carry_{n}": F.lead(F.col(f"_part_{n}")).over(by_key) for n in leads}
    carry = ranges.withColumns(carried).select(*keys, "_range", *carried)

    joined = rows.join(carry, [*keys, "_range"], "left")
    result = {}
    for n in sums:
        zero = F.lit(0)
        result[n] = F.coalesce(F.col(f"_out_{n}"), zero) + F.coalesce(F.col(f"_carry_{n}"), zero)
    for n in [*lasts, *before]:
        result[n] = F.coalesce(F.col(f"_out_{n}"), F.col(f"_carry_{n}"))
    for n in leads:
        result[n] = F.when(F.col("_is_last"), F.col(f"_carry_{n}")).otherwise(F.col(f"_out_{n}"))
    return joined.select(*df.columns, *[e.alias(n) for n, e in result.items()])
