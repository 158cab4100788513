"""Global order without a single task: row numbers and running sums over ranges of a key.

Rows are split at borders that a bounded sample of keys gives (the sample moves work, never results);
each range is numbered on its own and starts where the ranges before it end.  There are at most RANGES
ranges, so what crosses to the next step, and what the driver holds, is bounded however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ROWS_A_RANGE = 1_000_000
RANGES = 4096
SAMPLE_A_RANGE = 40


def ranged(df: DataFrame, by: str, *, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """df with a column ``range`` that rises with ``by``; keys that are null are in the first."""
    n = df.count()
    ranges = min(RANGES, -(-n // rows_a_range))
    if ranges <= 1:
        return df.withColumn("range", F.lit(0))
    sample = sorted(r[0] for r in df.select(by).filter(F.col(by).isNotNull()).sample(min(1.0, SAMPLE_A_RANGE * ranges / n), seed=5).collect())
    borders = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    if not borders:
        return df.withColumn("range", F.lit(0))
    # Borders at or below the key, by binary search: a row costs as many steps as the logarithm of the ranges.
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    held, key = F.array(*map(F.lit, borders)), F.col(by)
    number = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) <= key, low + step).otherwise(low))
    return df.withColumn("range", number)


def totals(df: DataFrame, by: str, amounts: dict[str, Column], *ties: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """df with the running sum of each amount in the order of ``by`` (then ties), by name."""
    held = {name: f"_{name}" for name in amounts}
    split = ranged(df, by, rows_a_range=rows_a_range).withColumns({held[name]: amount for name, amount in amounts.items()})
    starts = split.groupBy("range").agg(*[F.sum(x).alias(x) for x in held.values()])
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = starts.select("range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"start{x}") for x in held.values()])
    within = Window.partitionBy("range").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = split.withColumns({f"own{x}": F.sum(x).over(within) for x in held.values()}).join(F.broadcast(starts), "range")
    return out.select(*df.columns, *[(F.col(f"start{x}") + F.col(f"own{x}")).cast("long").alias(name) for name, x in held.items()])


def numbered(df: DataFrame, by: str, name: str, *ties: str, amount=None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """df with ``name``: the row's number from 1 in the order of ``by`` (then ties), or the running sum of amount."""
    return totals(df, by, {name: F.lit(1).cast("long") if amount is None else amount}, *ties, rows_a_range=rows_a_range)
