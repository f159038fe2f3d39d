"""Exact quantiles and running totals without one task that sees every row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bins of a narrowing step, and rows from which on they are simply sorted.
_BINS, _FEW = 1024, 10_000
# Rank error of the ends between which a quantile is looked for is one row in so many; values between them that reach the driver.
_ACCURACY, _NEAR = 10_000, 200_000
# Bands of running totals.
_BANDS = 256


def nth_smallest(values: DataFrame, value: str, n: int) -> float:
    """The exact n-th smallest of a column of numbers, counted from 1.

    Equal bins over the range that must hold it are counted and the bin with
    the wanted rank becomes the next range, down to its own ends, until few
    rows are left. A step reads the column once and returns at most _BINS
    rows; ties, however many, are one value and end the search.
    """
    low, high = values.agg(F.min(value), F.max(value)).first()
    below = 0
    while low < high:
        inside = values.filter(F.col(value).between(low, high))
        width = (high - low) / _BINS
        if low + width == low:
            break
        at = F.least(F.floor((F.col(value) - low) / width), F.lit(_BINS - 1))
        bins = inside.groupBy(at.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b")
        )
        for found in sorted(bins.collect(), key=lambda r: r.bin):
            if below + found.n >= n:
                break
            below += found.n
        low, high = found.a, found.b
        if found.n <= _FEW:
            break
    if low == high:
        return low
    rest = values.filter(F.col(value).between(low, high)).select(value)
    return rest.orderBy(value).limit(n - below).agg(F.max(value)).first()[0]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], p: float) -> dict[str, float | None]:
    """The linearly interpolated quantile of the values of each column that are numbers, None if there are none.

    All columns are read together, twice: for their numbers and ends close around the quantile, then for the counts of the
    values between the ends and of the rows below. Where more values than _NEAR lie between, or not the one wanted, the column is narrowed.
    """
    if not columns:
        return {}
    numbers = {name: value.cast("double") for name, value in columns.items()}
    plain = df.select(*[F.when(~F.isnan(v), v).alias(name) for name, v in numbers.items()])
    around = [max(p - 4 / _ACCURACY, 0.0), min(p + 4 / _ACCURACY, 1.0)]
    read = [F.struct(F.count(c).alias("rows"), F.min(c).alias("least"), F.max(c).alias("most"), F.percentile_approx(c, around, _ACCURACY).alias("ends")).alias(c) for c in plain.columns]
    seen = {c: r for c, r in plain.agg(*read).first().asDict().items() if r.rows}
    ends = {c: (r.least, r.most) if r.rows <= _ACCURACY else tuple(r.ends) for c, r in seen.items()}
    counts: dict[str, dict[float | None, int]] = {c: {} for c in seen}
    if seen:
        values = F.explode(
            F.array(*[F.when(F.col(c) <= hi, F.struct(F.lit(c).alias("c"), F.when(F.col(c) >= lo, F.col(c)).alias("v"))) for c, (lo, hi) in ends.items()])
        ).alias("e")
        grouped = plain.select(values).filter("e IS NOT NULL").groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n"))
        found = grouped.limit(_NEAR + 1).collect()
        if len(found) <= _NEAR:
            for r in found:
                counts[r.c][r.v] = r.n

    def nth(c: str, n: int) -> float:
        upto = counts[c].get(None, 0)
        if n > upto:
            for v in sorted(v for v in counts[c] if v is not None):
                upto += counts[c][v]
                if upto >= n:
                    return v
        return nth_smallest(plain.select(c).filter(F.col(c).isNotNull()), c, n)

    out: dict[str, float | None] = dict.fromkeys(columns)
    for c, r in seen.items():
        spot = (r.rows - 1) * p
        a, b = (nth(c, int(rank) + 1) for rank in (math.floor(spot), math.ceil(spot)))
        out[c] = a + (b - a) * (spot - math.floor(spot))
    return out


def exact_quantile(df: DataFrame, value: Column, p: float, name: str = "quantile") -> DataFrame:
    """One row: the linearly interpolated quantile of the values that are numbers, null if there are none."""
    found = exact_quantiles(df, {"v": value}, p)["v"]
    return df.sparkSession.createDataFrame([(found,)], f"`{name}` double")


def positives(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column))


def median_of_positives(df: DataFrame, column: str) -> DataFrame:
    return exact_quantile(df, positives(column), 0.5, "median")


def _band(value: Column, splitters: list[float]) -> Column:
    """How many of the ascending splitters are at or below the value, by halving."""
    if not splitters:
        return F.lit(0)
    listed = F.array(*map(F.lit, splitters))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(splitters)) & (F.get(listed, at + step - 1) <= value), at + step
        ).otherwise(at),
    )


def running_totals(df: DataFrame, value: str, weights: list[str]) -> DataFrame:
    """Per distinct ``value``: the weights at it and the totals below it.

    Ranks come from two levels: the totals of bands between quantiles of the
    values are summed up in one window of _BANDS rows, and within a band a
    window of its own goes on from there, so no task sorts all values, however
    close together they lie.
    """
    shares = [k / _BANDS for k in range(1, _BANDS)]
    cuts = df.filter(F.col(value).isNotNull()).agg(F.percentile_approx(value, shares, 20 * _BANDS)).first()[0]
    band = _band(F.col(value), sorted(set(cuts or [])))
    grouped = df.groupBy(value).agg(*[F.sum(w).alias(w) for w in weights]).withColumn("band", band)
    by_band = grouped.groupBy("band").agg(*[F.sum(w).alias(f"band_{w}") for w in weights])
    earlier = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_band.select(
        "band", *[F.coalesce(F.sum(f"band_{w}").over(earlier), F.lit(0)).alias(f"offset_{w}") for w in weights]
    )
    within = Window.partitionBy("band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(F.broadcast(offsets), "band").select(
        value,
        *weights,
        *[
            (F.col(f"offset_{w}") + F.coalesce(F.sum(w).over(within), F.lit(0))).alias(f"below_{w}")
            for w in weights
        ],
    )
