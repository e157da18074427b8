"""Bank schemas: their text and JSON forms, dictionaries, their union over files, name patterns, Spark types."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import types as T

from jaglet.errors import SchemaConflict

# Type letters, their codes, sizes in bytes, numpy and Spark types.
LETTERS = {
    "B": (1, 1, "i1", T.ByteType()),
    "S": (2, 2, "i2", T.ShortType()),
    "I": (3, 4, "i4", T.IntegerType()),
    "F": (4, 4, "f4", T.FloatType()),
    "D": (5, 8, "f8", T.DoubleType()),
    "L": (8, 8, "i8", T.LongType()),
}
MOST_SCHEMAS, LONGEST = 65_536, 1 << 24
_TEXT = re.compile(r"\s*\{([^{}]+)\}\s*\{([^{}]*)\}\s*")


@dataclass(frozen=True)
class Column:
    """One column of a bank; length over 1 is a fixed-length array."""

    name: str
    letter: str
    length: int = 1

    @property
    def size(self) -> int:
        return LETTERS[self.letter][1] * self.length

    @property
    def spark(self) -> T.DataType:
        kind = LETTERS[self.letter][3]
        return kind if self.length == 1 else T.ArrayType(kind, False)

    @property
    def type_text(self) -> str:
        return self.letter if self.length == 1 else f"{self.letter}#{self.length}"

    @classmethod
    def parse(cls, name: str, kind: str) -> Column:
        letter, _, length = kind.strip().partition("#")
        if letter not in LETTERS:
            raise ValueError(f"unknown column type {kind!r} of {name!r}")
        if "#" in kind and not (length.isdigit() and 1 <= int(length) <= LONGEST):
            raise ValueError(f"bad array length in {kind!r} of {name!r}")
        return cls(name.strip(), letter, int(length) if length else 1)


@dataclass(frozen=True)
class Bank:
    """A bank's name, ids and columns."""

    name: str
    group: int
    item: int
    columns: tuple[Column, ...]

    @classmethod
    def parse(cls, text: str) -> Bank:
        """From ``{Name/group/item}{col/T,col/T#N}``."""
        m = _TEXT.fullmatch(text)
        head = [p.strip() for p in m[1].split("/")] if m else []
        if len(head) != 3 or not (head[1].isdigit() and head[2].isdigit()):
            raise ValueError(f"not a bank schema: {text!r}")
        columns = []
        for part in filter(None, (p.strip() for p in m[2].split(","))):
            name, slash, kind = part.partition("/")
            if not slash:
                raise ValueError(f"column without a type: {part!r}")
            columns.append(Column.parse(name, kind))
        return cls(head[0], int(head[1]), int(head[2]), tuple(columns)).checked()

    @classmethod
    def parse_json(cls, text: str) -> Bank:
        """From ``{"name":…, "group":…, "item":…, "entries":[{"name":…, "type":…}]}``."""
        try:
            raw = json.loads(text)
            return cls(raw["name"], int(raw["group"]), int(raw["item"]), tuple(Column.parse(e["name"], e["type"]) for e in raw["entries"])).checked()
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise ValueError(f"not a bank schema in JSON: {e}") from None

    def checked(self) -> Bank:
        if not 0 <= self.group < 65_536 or not 0 <= self.item < 256:
            raise ValueError(f"ids of {self.name!r} out of range: {self.group}/{self.item}")
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names) or not all(names) or not self.name:
            raise ValueError(f"{self.name!r} has empty or repeated column names")
        return self

    def to_text(self) -> str:
        return f"{{{self.name}/{self.group}/{self.item}}}{{{','.join(f'{c.name}/{c.type_text}' for c in self.columns)}}}"

    @property
    def row_size(self) -> int:
        return sum(c.size for c in self.columns)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, True, {"length": c.length}) for c in self.columns])

    def field(self) -> T.StructField:
        """The bank's column of an event frame: NULL where the event lacks it, [] where it has no rows."""
        return T.StructField(self.name, T.ArrayType(self.spark), True, {"group": self.group, "item": self.item})

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"bank {self.name!r} has no column {name!r}")

    def select(self, names: Iterable[str]) -> Bank:
        return Bank(self.name, self.group, self.item, tuple(self.column(n) for n in names))

    @classmethod
    def from_spark(cls, field: T.StructField, group: int = 0, item: int = 0) -> Bank:
        """The schema of an event frame's bank column; types that banks don't have are errors."""
        back = {v[3].typeName(): k for k, v in LETTERS.items()}
        columns = []
        for f in field.dataType.elementType.fields:
            array = isinstance(f.dataType, T.ArrayType)
            kind = f.dataType.elementType if array else f.dataType
            if kind.typeName() not in back:
                raise TypeError(f"{field.name}.{f.name}: a bank can't hold {f.dataType.simpleString()}")
            columns.append(Column(f.name, back[kind.typeName()], int(f.metadata.get("length", 1)) if array else 1))
        return cls(field.name, int(field.metadata.get("group", group)), int(field.metadata.get("item", item)), tuple(columns))


class Dictionary:
    """Banks by name, in order."""

    def __init__(self, banks: Iterable[Bank] = ()):
        self._by: dict[str, Bank] = {}
        for b in banks:
            self.add(b)

    def add(self, bank: Bank) -> None:
        """Add or replace a bank."""
        if bank.name not in self._by and len(self._by) >= MOST_SCHEMAS:
            raise ValueError(f"a dictionary holds at most {MOST_SCHEMAS} banks")
        self._by[bank.name] = bank.checked()

    def __iter__(self) -> Iterator[Bank]:
        return iter(self._by.values())

    def __len__(self) -> int:
        return len(self._by)

    def __contains__(self, name: str) -> bool:
        return name in self._by

    def __getitem__(self, name: str) -> Bank:
        if name not in self._by:
            raise KeyError(f"no bank {name!r}; there are {', '.join(self._by) or 'none'}")
        return self._by[name]

    def names(self) -> list[str]:
        return list(self._by)

    def by_id(self, group: int, item: int) -> Bank | None:
        return next((b for b in self if (b.group, b.item) == (group, item)), None)

    def sorted(self) -> list[Bank]:
        """By (group, item), as dictionaries are shown."""
        return sorted(self, key=lambda b: (b.group, b.item, b.name))

    def to_text(self) -> str:
        return "\n".join(b.to_text() for b in self)

    @classmethod
    def parse(cls, text: str) -> Dictionary:
        return cls(Bank.parse(line) for line in text.splitlines() if line.strip())

    @classmethod
    def union(cls, parts: Iterable[tuple[str, Dictionary]]) -> Dictionary:
        """All banks of files (path, dictionary), the first file's first; layouts and ids must agree."""
        out = cls()
        for path, part in parts:
            for b in part:
                if b.name in out and out[b.name] != b:
                    raise SchemaConflict(f"bank {b.name!r} of {path} differs from other files: {b.to_text()} and {out[b.name].to_text()}")
                other = out.by_id(b.group, b.item)
                if other is not None and other.name != b.name:
                    raise SchemaConflict(f"banks {b.name!r} of {path} and {other.name!r} share the id {b.group}/{b.item}")
                out.add(b)
        return out


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def match_names(dictionary: Dictionary, patterns: str | Iterable[str]) -> dict[str, list[str]]:
    """Banks and their columns that globs on ``bank`` or ``bank/column`` match; a bank by name keeps all columns."""
    globs = [patterns] if isinstance(patterns, str) else list(patterns)
    out = {}
    for b in dictionary:
        whole = any(fnmatch.fnmatchcase(b.name, g) for g in globs)
        cols = [c.name for c in b.columns if whole or any(fnmatch.fnmatchcase(f"{b.name}/{c.name}", g) for g in globs)]
        if cols or whole:
            out[b.name] = cols
    return out


def resolve_banks(dictionary: Dictionary, patterns: str | Iterable[str]) -> list[str]:
    """Names of banks, in dictionary order; a literal that isn't there, or a glob without a match, is an error."""
    parts = [p.strip() for p in patterns.split(",")] if isinstance(patterns, str) else list(patterns)
    if not parts or not all(parts):
        raise ValueError("empty bank pattern")
    wanted: set[str] = set()
    for p in parts:
        hits = {n for n in dictionary.names() if fnmatch.fnmatchcase(n, p)} if is_glob(p) else {p} & set(dictionary.names())
        if not hits:
            raise KeyError(f"no bank matches {p!r}")
        wanted |= hits
    return [n for n in dictionary.names() if n in wanted]
