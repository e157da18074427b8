"""Expressions over banks, i.e. nullable arrays of structs, that stay within the event and prune columns.

Spark reads only the fields that `bank.field` names, but all of them under a lambda over the whole struct; so banks
are cut down to the wanted fields by `rows()` first. A NULL bank and an empty one both have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = F.array


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each event: Catalyst doesn't share what stands under a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def field(bank: str, name: str) -> Column:
    """One column of a bank as an array."""
    return F.col(f"`{bank}`.`{name}`")


def rows(bank: str, names: Iterable[str]) -> Column:
    """A bank with some of its columns, NULL if absent."""
    return F.arrays_zip(*[field(bank, n) for n in names])


def counts(bank: str, narrow: str) -> Column:
    """Rows of a bank, 0 if absent, by its column `narrow`."""
    return F.coalesce(F.size(field(bank, narrow)), F.lit(0)).cast("long")


def keep_rows(array: Column, condition: Callable[[Column], Column]) -> Column:
    """The rows that meet a condition; every event stays."""
    return F.filter(array, condition)


def any_row(array: Column, condition: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(array, condition), F.lit(False))


def all_rows(array: Column, condition: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(array, condition), F.lit(True))


def total(array: Column, value: Callable[[Column], Column] | None = None) -> Column:
    """The sum in double precision, 0 without rows."""
    values = F.transform(array, lambda r: (value(r) if value else r).cast("double"))
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def mean(array: Column) -> Column:
    """NULL without rows."""
    return total(array) / F.nullif(F.size(array), F.lit(0))


def first(array: Column, index: int | Column = 0) -> Column:
    """A row by its place from 0, NULL if there is none."""
    return F.get(array, F.lit(index) if isinstance(index, int) else index)


def value(array: Column, index: int | Column, name: str, kind: str | None = None) -> Column:
    """One cell of a bank, NULL where the row is missing, cast to `kind` if given."""
    cell = first(array, index)[name]
    return cell if kind is None else cell.cast(kind)


def value_or(array: Column, index: int | Column, name: str, default) -> Column:
    """One cell of a bank, or the default where the row is missing."""
    return F.coalesce(value(array, index, name), F.lit(default))


def typed_rows(array: Column, wanted: dict[str, str], have: Iterable[str]) -> Column:
    """Rows as structs of the wanted names and types; columns that aren't there, and NULLs, are zeros."""
    have = set(have)
    zero = lambda t: F.lit(0).cast(t)
    return F.transform(array, lambda r: F.struct(*[(F.coalesce(r[n].cast(t), zero(t)) if n in have else zero(t)).alias(n) for n, t in wanted.items()]))


def inner_total(array: Column, name: str) -> Column:
    """Of each row the sum along a fixed-length array column."""
    return F.transform(array, lambda r: F.aggregate(F.transform(r[name], lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def indexed(array: Column) -> Column:
    """Structs of (row, i), i from 0."""
    return F.transform(array, lambda r, i: F.struct(r.alias("row"), i.cast("int").alias("i")))


def leading(array: Column, key: Callable[[Column], Column]) -> Column:
    """The row with the greatest key, the first of equals, as a struct (key, i, row); NULL without rows. NaN keys lose."""
    ranked = F.transform(array, lambda r, i: F.struct(F.when(F.isnan(key(r).cast("double")), F.lit(None)).otherwise(key(r)).alias("key"), (-i).alias("back")))
    found = lambda best: F.when(best.isNotNull(), F.struct(best["key"].alias("key"), (-best["back"]).alias("i"), F.get(array, -best["back"]).alias("row")))
    return let(F.array_max(ranked), found)


def pairs(array: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """pair(a, b) of all rows a before b, as an array."""
    return let(indexed(array), lambda held: F.flatten(F.transform(held, lambda a: F.transform(F.slice(held, a["i"] + 2, F.size(held)), lambda b: pair(a, b)))))


def product(left: Column, right: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """pair(a, b) of every row of left and every row of right, nested by left."""
    return let(right, lambda inner: F.transform(left, lambda a: F.transform(inner, lambda b: pair(a, b))))


def flat(df: DataFrame, bank: str, names: Iterable[str], keep: Iterable[str] = ("event_id",)) -> DataFrame:
    """The flat twin: a row per bank row with row_idx; events without rows are absent."""
    names = list(names)
    exploded = df.select(*keep, F.posexplode(rows(bank, names)).alias("row_idx", "__r"))
    return exploded.select(*keep, F.col("row_idx").cast("long").alias("row_idx"), *[F.col(f"__r.`{n}`") for n in names])


def exploded(df: DataFrame, keep: Iterable[str], array: Column, row: str = "row") -> DataFrame:
    """`keep`, row_idx and each row of a computed array. An inner explode would compute the array once more, to filter by its size."""
    return df.select(*keep, F.posexplode_outer(array).alias("row_idx", row)).where("row_idx is not null").withColumn("row_idx", F.col("row_idx").cast("long"))


def nest(flat_rows: DataFrame, bank: str, names: Iterable[str], events: DataFrame | None = None) -> DataFrame:
    """The inverse of flat: event_id and the bank in row order; with `events`, those without rows get []."""
    names = list(names)
    packed = F.sort_array(F.collect_list(F.struct("row_idx", F.struct(*names).alias("row"))))
    out = flat_rows.groupBy("event_id").agg(F.transform(packed, lambda s: s["row"]).alias(bank))
    if events is None:
        return out
    kind = out.schema[bank].dataType
    return events.select("event_id").join(out, "event_id", "left").select("event_id", F.coalesce(F.col(f"`{bank}`"), F.array().cast(kind)).alias(bank))


# ---- cuts in words

CALLS = {"any": "exists({a}, r -> coalesce({e}, false))", "all": "forall({a}, r -> coalesce({e}, false))", "num": "size(filter({a}, r -> coalesce({e}, false)))", "sum": "aggregate(transform({a}, r -> cast({e} AS double)), 0D, (s, x) -> s + x)", "max": "array_max(transform({a}, r -> {e}))", "min": "array_min(transform({a}, r -> {e}))"}
_WORD = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_][A-Za-z_0-9]*|\d[\w.]*|\s+|.", re.S)


class Cut:
    """A condition in Spark SQL over a bank's column names.

    Without any(), all(), num(), sum(), max() or min() it is a row cut: rows that meet it stay, all events stay.
    With one of these around every column it is an event cut: events that meet it stay whole. NaN meets no comparison.
    """

    def __init__(self, text: str, columns: dict[str, bool]):
        """columns: the bank's column names, and whether each may hold NaN."""
        self.text, self.columns = text, columns
        tokens = _WORD.findall(text)
        self.names = list(dict.fromkeys(t.strip("`") for t in tokens if t.strip("`") in columns and t[0] not in "'\""))
        if not self.names:
            raise ValueError(f"the cut {text!r} names no column of the bank")
        self.by_event = any(t.lower() in CALLS and self._called(tokens, i) for i, t in enumerate(tokens))
        self._tokens = tokens

    @staticmethod
    def _called(tokens: list[str], i: int) -> bool:
        rest = next((t for t in tokens[i + 1 :] if not t.isspace()), "")
        return rest == "("

    def _row(self, tokens: list[str]) -> str:
        out = []
        for i, t in enumerate(tokens):
            name = t.strip("`")
            if name in self.columns and t[0] not in "'\"" and not self._called(tokens, i):
                out.append(f"nullif(r.`{name}`, double('NaN'))" if self.columns[name] else f"r.`{name}`")
            else:
                out.append(t)
        return "".join(out)

    def sql(self, array: str) -> str:
        """For a row cut the filtered array, for an event cut the condition."""
        if not self.by_event:
            return f"filter({array}, r -> coalesce({self._row(self._tokens)}, false))"
        out, i, tokens = [], 0, self._tokens
        while i < len(tokens):
            t = tokens[i]
            if t.lower() in CALLS and self._called(tokens, i):
                start = tokens.index("(", i)
                depth, end = 0, start
                for end in range(start, len(tokens)):
                    depth += (tokens[end] == "(") - (tokens[end] == ")")
                    if not depth:
                        break
                else:
                    raise ValueError(f"unbalanced brackets in {self.text!r}")
                inner = self._row(tokens[start + 1 : end]).strip()
                out.append(CALLS[t.lower()].format(a=f"coalesce({array}, array())", e=inner or "true"))
                i = end + 1
                continue
            if t.strip("`") in self.columns and t[0] not in "'\"":
                raise ValueError(f"{t!r} in the event cut {self.text!r} stands outside any(), all(), num(), sum(), max() and min()")
            out.append(t)
            i += 1
        return f"coalesce({''.join(out)}, false)"
