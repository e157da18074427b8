"""Event tags: sets of up to 32 bits in one unsigned word, and registries that name the bits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF


class TagSet(int):
    """A set of bits 0 to 31; an int, so it can be stored and compared as one."""

    def __new__(cls, bits: int = 0) -> TagSet:
        if not 0 <= bits <= WORD:
            raise ValueError(f"a tag has 32 bits: {bits}")
        return super().__new__(cls, bits)

    @classmethod
    def of(cls, *indices: int) -> TagSet:
        if any(not 0 <= i < 32 for i in indices):
            raise ValueError("bit indices are 0 to 31")
        return cls(sum(1 << i for i in set(indices)))

    def contains(self, other: int) -> bool:
        return self & other == other

    def intersects(self, other: int) -> bool:
        return bool(self & other)

    def insert(self, other: int) -> TagSet:
        return TagSet(int(self) | other)

    def __or__(self, other: int) -> TagSet:
        return self.insert(other)

    __ror__ = __or__

    def indices(self) -> list[int]:
        return [i for i in range(32) if self >> i & 1]


class TagRegistry:
    """Names of bits, kept in the order of insertion."""

    def __init__(self, bits: dict[str, int] | Iterable[str] = ()):
        self._bits: dict[str, int] = {}
        for name, bit in bits.items() if isinstance(bits, dict) else ((n, k) for k, n in enumerate(bits)):
            self.insert(name, bit)

    def insert(self, name: str, bit: int) -> None:
        if not name or name != name.strip() or "=" in name or "\n" in name:
            raise ValueError(f"bad tag name {name!r}")
        if not 0 <= bit < 32:
            raise ValueError(f"bit of {name!r} is not in 0 to 31: {bit}")
        if self._bits.get(name, bit) != bit or any(b == bit and n != name for n, b in self._bits.items()):
            raise ValueError(f"{name!r} or bit {bit} is taken")
        self._bits[name] = bit

    def __iter__(self) -> Iterator[tuple[str, int]]:
        return iter(self._bits.items())

    def __len__(self) -> int:
        return len(self._bits)

    def position(self, name: str) -> int | None:
        return self._bits.get(name)

    def name(self, bit: int) -> str | None:
        return next((n for n, b in self if b == bit), None)

    def mask(self, name: str) -> TagSet:
        if name not in self._bits:
            raise KeyError(f"no tag {name!r}; there are {', '.join(self._bits) or 'none'}")
        return TagSet.of(self._bits[name])

    def mask_of(self, names: Iterable[str]) -> TagSet:
        out = TagSet()
        for n in names:
            out = out.insert(self.mask(n))
        return out

    def to_text(self) -> str:
        return "".join(f"{n}={b}\n" for n, b in self)

    @classmethod
    def parse(cls, text: str) -> TagRegistry:
        out = cls()
        for line in filter(None, text.splitlines()):
            name, eq, bit = line.rpartition("=")
            if not eq or not bit.isdigit():
                raise ValueError(f"not a tag line: {line!r}")
            out.insert(name, int(bit))
        return out


def tag_flags(name: str, **bits: int) -> type:
    """A class of named tags: flags.Name is the TagSet of its bit, NAMES the pairs, registry() a registry of them."""
    registry = TagRegistry(bits)
    body = {n: TagSet.of(b) for n, b in bits.items()}
    return type(name, (), {**body, "NAMES": tuple(bits.items()), "name_of": staticmethod(registry.name), "registry": staticmethod(lambda: TagRegistry(bits))})


def any_bit(tag: Column, mask: int) -> Column:
    return tag.bitwiseAND(F.lit(mask & WORD).cast("long")) != 0


def all_bits(tag: Column, mask: int) -> Column:
    return tag.bitwiseAND(F.lit(mask & WORD).cast("long")) == (mask & WORD)


def bit_indices(tag: Column) -> Column:
    """The set bits as an ascending array."""
    return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", tag, i).bitwiseAND(F.lit(1)) == 1)
