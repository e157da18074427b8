"""Histograms with numpy's edges: bins are half-open, the last one is closed; what lies outside isn't counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_index(x: Column, bins: int, low: float, high: float) -> Column:
    """The bin of x from 0; NULL outside and for NaN."""
    if bins < 1 or not low < high:
        raise ValueError("a histogram needs a bin and low < high")
    raw = F.floor((x - low) * (bins / (high - low)))
    inside = (x >= low) & (x <= high) & ~F.isnan(x)
    return F.when(inside, F.least(raw, F.lit(bins - 1))).cast("long")


def histogram(df: DataFrame, value: Column, bins: int, low: float, high: float) -> DataFrame:
    """bin, n of the bins that have entries; one partial count per bin and task is shuffled."""
    return df.select(bin_index(value.cast("double"), bins, low, high).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def histogram2d(df: DataFrame, x: Column, y: Column, bins: tuple[int, int], x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """xbin, ybin, n of the cells that have entries."""
    cells = df.select(bin_index(x.cast("double"), bins[0], *x_range).alias("xbin"), bin_index(y.cast("double"), bins[1], *y_range).alias("ybin"))
    return cells.where("xbin is not null and ybin is not null").groupBy("xbin", "ybin").agg(F.count("*").alias("n"))


def unique_counts(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def cutflow(df: DataFrame, cuts: dict[str, Column]) -> DataFrame:
    """step, name, n: how many rows pass each cut and all before it, from one pass."""
    passed, counts = F.lit(True), []
    for cut in cuts.values():
        passed = passed & F.coalesce(cut, F.lit(False))
        counts.append(F.count_if(passed))
    one = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(counts)])
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("step"), F.lit(n).alias("name"), F.col(f"c{k}").alias("n")) for k, n in enumerate(cuts)])
    return one.select(F.inline(steps))
