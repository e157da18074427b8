"""Event filters: which tables an event must have, which tags its record and itself may bear. Filters only narrow."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from jaglet.schema import Dictionary
from jaglet.tags import TagRegistry, any_bit


def _many(x) -> list:
    return [x] if isinstance(x, (str, int)) else list(x)


@dataclass(frozen=True)
class FilterSpec:
    """All clauses hold together. None is no clause; an empty set of tags can't arise."""

    require: tuple[str, ...] = ()
    record_tags: frozenset[int] | None = None
    event_tags: frozenset[int] | None = None
    any_mask: int | None = None

    @property
    def active(self) -> bool:
        return bool(self.require) or self.record_tags is not None or self.event_tags is not None or self.any_mask is not None

    def narrowed(self, dictionary: Dictionary, registry: TagRegistry, require: str | Iterable[str] | None = None, record_tag: int | Iterable[int] | None = None, event_tag=None, event_tag_any=None) -> FilterSpec:
        """This filter and more: required banks add up, sets of tags are intersected, a second bit mask is an error.

        Tag names, in event_tag too, go to the bit mask, and numbers beside names in one list are bits of it.
        """
        out = self
        if require is not None:
            names = _many(require)
            for n in names:
                dictionary[n]  # unknown names are errors before any read
            out = replace(out, require=tuple(dict.fromkeys([*out.require, *names])))
        if record_tag is not None:
            out = replace(out, record_tags=self._meet(out.record_tags, _many(record_tag), "record_tag"))
        if event_tag is not None:
            given = _many(event_tag)
            if any(isinstance(t, str) for t in given):
                if event_tag_any is not None:
                    raise ValueError("tag names in event_tag and event_tag_any exclude each other")
                event_tag_any = given
            else:
                out = replace(out, event_tags=self._meet(out.event_tags, given, "event_tag"))
        if event_tag_any is not None:
            if out.any_mask is not None:
                raise ValueError("event_tag_any is set already")
            mask = 0
            for t in _many(event_tag_any):
                mask |= registry.mask(t) if isinstance(t, str) else int(t)
            out = replace(out, any_mask=mask)
        return out

    @staticmethod
    def _meet(old: frozenset[int] | None, new: list, name: str) -> frozenset[int]:
        if any(isinstance(t, bool) or not isinstance(t, int) for t in new):
            raise TypeError(f"{name} takes integers")
        met = frozenset(new) if old is None else old & frozenset(new)
        if not met:
            raise ValueError(f"no {name} is left")
        return met

    def condition(self) -> Column | None:
        """The filter over an event frame's columns."""
        parts = [F.col(f"`{n}`").isNotNull() for n in self.require]
        if self.record_tags is not None:
            parts.append(F.col("record_tag").isin(sorted(self.record_tags)))
        if self.event_tags is not None:
            parts.append(F.col("event_tag").isin(sorted(self.event_tags)))
        if self.any_mask is not None:
            parts.append(any_bit(F.col("event_tag"), self.any_mask))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def merge_ranges(ranges: Iterable[tuple[int, int]], most: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges, clamped to [0, most), sorted and merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a), b if most is None else min(b, most)) for a, b in ranges):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def in_ranges(index: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    """Whether an index is in any of the ranges; each range prunes on its own."""
    out = F.lit(False)
    for a, b in merge_ranges(ranges):
        out = out | ((index >= a) & (index < b))
    return out
