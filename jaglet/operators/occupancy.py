"""How many events have rows of a bank, how many rows, and how many at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jaglet.operators.jagged import counts


def occupancy(df: DataFrame, narrow: dict[str, str]) -> DataFrame:
    """bank, events, rows, max_rows, scanned from one pass; narrow names a small column of each bank."""
    aggs = [F.count("*").alias("scanned")]
    for k, (bank, column) in enumerate(narrow.items()):
        n = counts(bank, column)
        aggs += [F.count_if(n > 0).alias(f"e{k}"), F.coalesce(F.sum(n), F.lit(0)).alias(f"r{k}"), F.coalesce(F.max(n), F.lit(0)).alias(f"m{k}")]
    one = df.agg(*aggs)
    banks = F.array(*[F.struct(F.lit(b).alias("bank"), F.col(f"e{k}").alias("events"), F.col(f"r{k}").alias("rows"), F.col(f"m{k}").alias("max_rows")) for k, b in enumerate(narrow)])
    return one.select(F.inline(banks), F.col("scanned"))
