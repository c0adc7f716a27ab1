"""Exact order statistics without a sort: histograms that narrow down to the cell of each wanted place.

No task or row ever holds all values.  A pass counts the values of each open place's range in ``CELLS`` cells (map-side), and the cell that holds the place
becomes its range, cut to the least and largest value that it has.  A place is settled when its range is one value, however often that is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .steps import cut, small

CELLS = 1024


def nearest(share: float, n: Column) -> Column:
    """Place (from 0) of element min(n - 1, int(n * share))."""
    return F.least(n - 1, F.floor(n * share)).cast("long")


def around(share: float, n: Column) -> tuple[Column, Column, Column]:
    """The two places (from 0) between which a linearly interpolated percentile lies, and how far it is from the first."""
    at = (n - 1) * F.lit(float(share))
    low = F.floor(at).cast("long")
    return low, F.least(n - 1, low + 1).cast("long"), at - low


def places(rows: DataFrame, value: str, wanted: dict[str, Column], by: tuple[str, ...] = (), cells: int = CELLS) -> DataFrame:
    """``by``, ``n`` and for each name of ``wanted`` the value at that place (a column of ``n``, from 0) in the order of the group's values.

    Nulls and NaN don't count; a group without values has no row; infinite values are in order like others.  ``rows`` are read once for each
    pass: cut them first if that is dear."""
    own = [f"g{k}" for k in range(len(by))] or ["g0"]
    groups = [F.col(b) for b in by] or [F.lit(0)]
    number = F.col(value).cast("double")
    data = rows.where(number.isNotNull() & ~F.isnan(number)).select(*(b.alias(g) for b, g in zip(groups, own)), number.alias("v"))
    # Infinite ends leave no width to cut: they are cells of their own.
    most = 1.7976931348623157e308
    stats = cut(data.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    stats = stats.where("n > 0")
    asked = F.array(*(F.struct(F.lit(k).alias("id"), at.alias("place")) for k, at in enumerate(wanted.values())))
    state = cut(stats.select(*own, "n", "low", "high", F.inline(asked)))
    settled = []
    while True:
        settled.append(state.where("low = high").select(*own, "n", "id", F.col("low").alias("value")))
        left = state.where("low < high")
        if left.isEmpty():
            break
        ranges = small(left.select(*(F.col(g).alias(f"_{g}") for g in own), "id", "place", "n", "low", "high"))
        met = data.join(ranges, reduce(lambda x, y: x & y, (data[g].eqNullSafe(ranges[f"_{g}"]) for g in own)))
        low, high = (F.least(F.greatest(c, F.lit(-most)), F.lit(most)) for c in ("low", "high"))
        # Halves first, so that no difference overflows.
        share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2)
        cell = F.when(F.col("v") == F.col("low"), -1).when(F.col("v") == F.col("high"), cells).otherwise(F.least(F.greatest(F.floor(share * cells), F.lit(0)), F.lit(cells - 1)))
        counts = met.where("v >= low and v <= high").groupBy(*(f"_{g}" for g in own), "id", "place", "n", cell.cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("rows").over(Window.partitionBy(*(f"_{g}" for g in own), "id").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("rows") <= F.col("place")))
        # A place is from now on counted within its cell.
        state = cut(found.select(*(F.col(f"_{g}").alias(g) for g in own), "n", "low", "high", "id", (F.col("place") - (F.col("upto") - F.col("rows"))).alias("place")))
    every = reduce(DataFrame.unionByName, settled)
    out = every.groupBy(*own, "n").agg(*(F.max(F.when(F.col("id") == k, F.col("value"))).alias(name) for k, name in enumerate(wanted)))
    return out.select(*(F.col(g).alias(b) for b, g in zip(by, own)), "n", *wanted)


def quantiles(rows: DataFrame, value: str, linear: dict[str, float], ranked: dict[str, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``n``, for each name of ``linear`` that interpolated percentile and for each of ``ranked`` the value at that nearest rank."""
    n = F.col("n")
    wanted = {name: nearest(share, n) for name, share in (ranked or {}).items()}
    for name, share in linear.items():
        low, high, _ = around(share, n)
        wanted |= {f"{name}_low": low, f"{name}_high": high}
    found = places(rows, value, wanted, by)
    between = lambda name, share: (F.col(f"{name}_high") - F.col(f"{name}_low")) * around(share, n)[2] + F.col(f"{name}_low")
    mid = {name: F.when(F.col(f"{name}_low") == F.col(f"{name}_high"), F.col(f"{name}_low")).otherwise(between(name, share)).alias(name) for name, share in linear.items()}
    return found.select(*by, "n", *mid.values(), *(ranked or {}))
