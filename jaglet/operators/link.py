"""Joins inside the event: detector rows to the particles that their index names, and back. No shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jaglet.operators.jagged import field, let, rows


def _slots(n: Column) -> Column:
    """0 … n-1; sequence(0, -1) counts down, so none is spelt out."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def group_by_index(detector: Column, count: Column, index: str = "pindex") -> Column:
    """The detector's rows of each of `count` particles, in their order; other indices are dropped, particles without rows get [].

    Rows are sorted among one marker for each particle and one behind the last; a particle's rows are the slice
    between its marker and the next. So the cost is that of one sort, however the rows are dealt.
    """
    n = F.coalesce(count, F.lit(0)).cast("int")
    return let(F.struct(detector.alias("rows"), n.alias("n")), lambda x: _grouped(x["rows"], x["n"], index))


def _grouped(held: Column, n: Column, index: str) -> Column:
    entry = lambda key, mark, at: F.struct(key.cast("long").alias("key"), F.lit(mark).alias("mark"), at.cast("int").alias("at"))
    marks = F.transform(_slots(n + 1), lambda i: entry(i, 0, i))
    there = F.coalesce(F.transform(held, lambda r, i: entry(r[index], 1, i)), F.slice(marks, 1, 0))
    order = F.sort_array(F.concat(marks, there))

    def slices(order: Column) -> Column:
        places = F.filter(F.transform(order, lambda e, k: F.struct(e["mark"].alias("mark"), k.alias("k"))), lambda e: e["mark"] == 0)
        return let(F.transform(places, lambda e: e["k"]), lambda at: F.transform(_slots(n), lambda i: own(order, F.get(at, i), F.get(at, i + 1))))

    def own(order: Column, start: Column, stop: Column) -> Column:
        return F.transform(F.slice(order, start + 2, stop - start - 1), lambda e: F.get(held, e["at"]))

    return let(order, slices)


def gather(detector: Column, particles: Column, index: str = "pindex") -> Column:
    """Of each detector row its particle, NULL where the index names none."""
    return F.transform(detector, lambda r: F.get(particles, r[index].cast("int")))


def rows_for_index(detector: Column, key: int | Column, index: str = "pindex") -> Column:
    """The detector's rows with an index; none without the bank."""
    return F.filter(detector, lambda r: r[index] == key)


def link(df: DataFrame, particles: str, detectors: Iterable[str], fields: dict[str, list[str]], index: str = "pindex", directions: str = "both") -> DataFrame:
    """df with linked banks; fields names the columns of each bank.

    "down" puts arrays of each detector's rows beside every particle, "up" puts `particle` beside every detector row,
    "both" does both. Banks without the index column stay as they are.
    """
    if directions not in ("both", "up", "down"):
        raise ValueError(f"directions must be both, up or down: {directions!r}")
    own = rows(particles, fields[particles])
    new = {}
    grouped = []
    for d in detectors:
        if index not in fields[d]:
            continue
        there = rows(d, fields[d])
        if directions != "down":
            new[d] = _with_particle(there, own, fields[d], index)
        grouped.append((d, group_by_index(there, F.size(field(particles, fields[particles][0])), index)))
    if directions != "up" and grouped:
        held = F.struct(own.alias("own"), *[g.alias(f"g{k}") for k, (_, g) in enumerate(grouped)])
        new[particles] = let(held, lambda x: _with_rows(x, fields[particles], [d for d, _ in grouped]))
    return df.withColumns(new)


def _with_particle(there: Column, own: Column, names: list[str], index: str) -> Column:
    return let(own, lambda o: F.transform(there, lambda r: F.struct(*[r[c].alias(c) for c in names], F.get(o, r[index].cast("int")).alias("particle"))))


def _with_rows(held: Column, names: list[str], detectors: list[str]) -> Column:
    return F.transform(held["own"], lambda p, i: F.struct(*[p[c].alias(c) for c in names], *[F.get(held[f"g{k}"], i).alias(d) for k, d in enumerate(detectors)]))
