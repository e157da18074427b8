"""The binary event-record container: decoding and encoding of files, records, banks and columns.

A file is a header, a dictionary record, data records and a trailer with the index of records. A record's events
are stored whole, by bank (a stream per bank) or by column (a stream per column), under one of five codecs. Streams
are only inflated when a bank or column is asked for. All functions work on bytes and numpy arrays; files are
reached through `FileBytes`, so any store that can read ranges will do.
"""

from __future__ import annotations

import functools
import gzip
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from jaglet.errors import ContainerError, CorruptFileError
from jaglet.schema import LETTERS, Bank, Column, Dictionary
from jaglet.tags import TagRegistry

# Fixed values of the format: magic words, sizes, ids and bits.
FILE_WORD, MAGIC, MAGIC_SWAPPED = 0x4F504948, 0xC0DA0100, 0x0001DAC0
HEADER, EVENT_HEADER, STRUCTURE = 56, 16, 8
VERSION = 6
DICTIONARY, DICTIONARY_JSON, REGISTRY = (120, 2), (120, 1), (120, 3)
CONFIG_KEY, CONFIG_VALUE, INDEX = (32555, 1), (32555, 2), (32111, 1)
BANK_TYPE, STRING_TYPE, COMPOSITE_TYPE = 11, 6, 10
# Compression tags by codec, for whole, by-bank and by-column layouts.
TAGS = {"none": (0, 13, 14), "lz4": (1, 9, 10), "lz4hc": (2, 6, 7), "gzip": (3, 11, 12), "zstd": (4, 5, 8)}
LAYOUTS = ("perchunk", "perbank", "percolumn")
BY_TAG = {tag: (codec, LAYOUTS[k]) for codec, tags in TAGS.items() for k, tag in enumerate(tags)}
COMPOSITE = {"b": "B", "s": "S", "i": "I", "f": "F", "d": "D", "l": "L"}
#: Inflating by more than this is taken for corruption.
MOST_INFLATION = 1056
RECORD_BYTES, RECORD_BYTES_SPLIT = 8 << 20, 32 << 20


class FileBytes:
    """Ranges of a file: a local path, or any URI that pyarrow's filesystems reach."""

    def __init__(self, path: str):
        self.path = path
        from jaglet.sources.paths import store_of

        store, inner = store_of(path)
        self._file = store.open_input_file(inner)
        self._file.seek(0, 2)
        self.size = self._file.tell()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise CorruptFileError(f"{n} bytes reach beyond the file", self.path, at)
        self._file.seek(at)
        return self._file.read(n)

    def close(self) -> None:
        self._file.close()


class MemoryBytes:
    """The same over bytes in memory."""

    def __init__(self, data: bytes, path: str = "<memory>"):
        self._data, self.path, self.size = data, path, len(data)

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise CorruptFileError(f"{n} bytes reach beyond the data", self.path, at)
        return self._data[at : at + n]

    def close(self) -> None:
        pass


def inflate(codec: str, data: bytes, size: int) -> bytes:
    """`size` bytes; LZ4 streams may hold more, which is cut off."""
    if size == 0:
        return b""
    if codec != "none" and size > MOST_INFLATION * max(len(data), 1):
        raise CorruptFileError("implausible inflated size")
    if codec == "none":
        if len(data) < size:
            raise CorruptFileError("stored bytes end early")
        return data[:size]
    try:
        if codec == "gzip":
            import zlib

            out = zlib.decompressobj(31).decompress(data)
        elif codec == "zstd":
            out = pa.Codec("zstd").decompress(data, size, asbytes=True)
        else:
            out = _lz4(data, size)
    except (OSError, ValueError, pa.ArrowException, Exception) as e:
        if isinstance(e, ContainerError):
            raise
        raise CorruptFileError(f"{codec} stream doesn't inflate: {e}") from None
    if len(out) < size:
        raise CorruptFileError(f"{codec} stream inflates to {len(out)} of {size} bytes")
    return out[:size]


def _lz4(data: bytes, size: int) -> bytes:
    """A raw LZ4 block. Its true length has to be known to tell a short stream from a full one."""
    length = lz4_length(data)
    if length < size:
        raise CorruptFileError(f"lz4 stream inflates to {length} of {size} bytes")
    return pa.Codec("lz4_raw").decompress(data, length, asbytes=True)


def lz4_length(data: bytes) -> int:
    """The inflated length of a raw LZ4 block, from its sequence headers."""
    at, end, out = 0, len(data), 0
    while at < end:
        token = data[at]
        at += 1
        run = token >> 4
        if run == 15:
            while True:
                if at >= end:
                    raise CorruptFileError("lz4 block ends within a length")
                run += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        at += run
        out += run
        if at >= end:
            if at > end:
                raise CorruptFileError("lz4 block ends within literals")
            break
        at += 2
        run = (token & 15) + 4
        if token & 15 == 15:
            while True:
                if at >= end:
                    raise CorruptFileError("lz4 block ends within a length")
                run += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
        out += run
    return out


def deflate(codec: str, data: bytes, level: int | None = None) -> bytes:
    if codec == "none":
        return data
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    if not data:
        return b""
    if codec == "zstd":
        return pa.Codec("zstd", level or 3).compress(data, asbytes=True)
    return (pa.Codec("lz4_raw", 9) if codec == "lz4hc" else pa.Codec("lz4_raw")).compress(data, asbytes=True)


@dataclass(frozen=True)
class RecordSpan:
    """A record of a file: where it is, how many events it has, its user words."""

    position: int
    length: int
    events: int
    user_word_1: int = 0
    user_word_2: int = 0


@dataclass
class RecordHeader:
    length: int
    number: int
    header_length: int
    events: int
    index_length: int
    bits: int
    user_header: int
    data_length: int
    tag: int
    stored: int
    user_word_1: int
    user_word_2: int
    big: bool

    @classmethod
    def parse(cls, raw: bytes, path: str = "", at: int = 0) -> RecordHeader:
        magic = struct.unpack_from("<I", raw, 28)[0]
        if magic not in (MAGIC, MAGIC_SWAPPED):
            raise CorruptFileError(f"record magic is {magic:#010x}", path, at + 28)
        order = ">" if magic == MAGIC_SWAPPED else "<"
        w = struct.unpack_from(order + "10I2Q", raw)
        tag = w[9] >> 28
        if tag not in BY_TAG:
            raise CorruptFileError(f"unknown compression tag {tag}", path, at + 36)
        out = cls(w[0] * 4, w[1], w[2] * 4, w[3], w[4], w[5], w[6], w[8], tag, (w[9] & 0x0FFFFFFF) * 4, w[10], w[11], order == ">")
        if out.header_length > out.length or out.header_length < HEADER or out.length == 0:
            raise CorruptFileError("record lengths contradict each other", path, at)
        if out.events * 4 > out.index_length:
            raise CorruptFileError("more events than the index has room for", path, at)
        return out

    def pad(self, shift: int) -> int:
        return self.bits >> shift & 3

    @property
    def inflated(self) -> int:
        return self.index_length + self.user_header + self.pad(20) + self.data_length


class Record:
    """The events of one record. `tags` and `presence` are at hand; banks and columns are inflated on demand."""

    def __init__(self, header: RecordHeader, payload: bytes, dictionary: Dictionary):
        self.header, self.dictionary = header, dictionary
        self.codec, self.layout = BY_TAG[header.tag]
        stored = payload[: header.stored - header.pad(24)] if header.stored else payload
        if self.layout == "perchunk":
            self._whole(inflate(self.codec, stored, header.inflated))
        else:
            if header.big:
                raise CorruptFileError("split layouts are little-endian")
            self._split(stored)

    # ---- whole records

    def _whole(self, raw: bytes) -> None:
        h = self.header
        order = ">" if h.big else "<"
        sizes = np.frombuffer(raw, order + "u4", h.events).astype(np.int64)
        base = h.index_length + h.user_header + h.pad(20)
        starts = base + np.concatenate(([0], np.cumsum(sizes)))
        if starts[-1] > len(raw):
            raise CorruptFileError("events reach beyond the record")
        self.tags = np.zeros(h.events, np.int64)
        self._found: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
        self._raw = raw
        for e in range(h.events):
            at, end = int(starts[e]), int(starts[e + 1])
            if end - at < EVENT_HEADER:
                raise CorruptFileError("event shorter than its header")
            self.tags[e] = struct.unpack_from(order + "I", raw, at + 8)[0]
            at += EVENT_HEADER
            while at + STRUCTURE <= end:
                group, item, kind, word = struct.unpack_from(order + "HBBI", raw, at)
                n, head = word & 0xFFFFFF, word >> 24
                if at + STRUCTURE + n > end:
                    raise CorruptFileError("structure reaches beyond its event")
                self._found.setdefault((group, item), []).append((e, at + STRUCTURE, n, head, kind))
                at += STRUCTURE + n
        self.ids = list(self._found)

    # ---- split records

    def _split(self, raw: bytes) -> None:
        if len(raw) < 20:
            raise CorruptFileError("split record ends within its prefix")
        version = raw[0]
        banks, events, stored, size = struct.unpack_from("<4I", raw, 4)
        column = self.layout == "percolumn"
        if version not in ((1, 2, 3) if column else (2, 3)):
            raise CorruptFileError(f"unknown split version {version}")
        if events != self.header.events or banks > 65_536 * 256:
            raise CorruptFileError("split record contradicts its header")
        d = inflate("lz4", raw[20 : 20 + stored], size)
        row = -(-banks // 8)
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            width = np.dtype(kind).itemsize * n
            if at + width > len(d):
                raise CorruptFileError("split directory ends early")
            out = np.frombuffer(d, kind, n, at)
            at += width
            return out

        described = take(np.dtype([("g", "<u2"), ("i", "u1"), ("t", "u1")]).descr and "V4", banks)
        described = np.frombuffer(described.tobytes(), [("g", "<u2"), ("i", "u1"), ("t", "u1")])
        self.ids = [(int(x["g"]), int(x["i"])) for x in described]
        if column:
            cols = take("<u2", banks).astype(int)
        else:
            packed, plain = take("<u4", banks).astype(np.int64), take("<u4", banks).astype(np.int64)
            cols = np.zeros(banks, int)
        self.tags = take("<u4", events).astype(np.int64)
        flags = np.unpackbits(take("u1", events * row).reshape(events, row), axis=1, bitorder="little")[:, :banks] if row else np.zeros((events, 0), np.uint8)
        self._present = flags.astype(bool)
        self._sizes = take("<u4", banks * events).reshape(banks, events).astype(np.int64)
        streams = int(np.maximum(cols, 1).sum())
        if column:
            both = take("<u4", 2 * streams).reshape(streams, 2).astype(np.int64)
            packed, plain = both[:, 0], both[:, 1]
        heads = take("u1", banks) if len(d) - at >= banks else np.zeros(banks, np.uint8)
        self._encoding = np.zeros(streams, np.uint8)
        sums = np.zeros(streams, "<u4")
        if column and version == 3:
            self._encoding, sums = take("u1", streams), take("<u4", streams)
        self._heads = heads
        starts = 20 + stored + np.concatenate(([0], np.cumsum(packed)))
        if starts[-1] > len(raw):
            raise CorruptFileError("streams reach beyond the record")
        first = np.concatenate(([0], np.cumsum(np.maximum(cols, 1))))
        self._cols = cols

        @functools.lru_cache(maxsize=None)
        def stream(k: int) -> bytes:
            data = raw[starts[k] : starts[k + 1]]
            if sums[k]:
                import xxhash

                if xxhash.xxh3_64_intdigest(data) & 0xFFFFFFFF != sums[k]:
                    raise CorruptFileError("stream checksum differs")
            out = inflate(self.codec, data, int(plain[k]))
            width, way = self._encoding[k] >> 4, self._encoding[k] & 15
            if way == 1 and width > 1:
                cut = len(out) // width * width
                out = np.frombuffer(out[:cut], np.uint8).reshape(width, -1).T.tobytes() + out[cut:]
            elif way > 1:
                raise CorruptFileError(f"unknown stream encoding {way}")
            return out

        self._stream, self._first = stream, first

    # ---- banks

    def present(self, bank: Bank) -> np.ndarray:
        """Of each event, whether it has the bank."""
        key, out = (bank.group, bank.item), np.zeros(self.header.events, bool)
        if self.layout == "perchunk":
            out[[x[0] for x in self._found.get(key, ())]] = True
        elif key in self.ids:
            out = self._present[:, self.ids.index(key)].copy()
        return out

    def read(self, bank: Bank, names: Iterable[str] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(rows of each event, -1 where the bank is absent; columns over all events)."""
        own = self.dictionary.by_id(bank.group, bank.item) or bank
        wanted = [own.column(n) for n in (names if names is not None else [c.name for c in own.columns])]
        rows = np.full(self.header.events, -1, np.int64)
        key, size = (bank.group, bank.item), own.row_size
        if self.layout == "perchunk":
            found = {x[0]: x for x in reversed(self._found.get(key, ()))}  # the first of an event counts
            parts = [found[e] for e in sorted(found)]
            for x in parts:
                rows[x[0]] = self._rows(x[2], size, own)
            return rows, {c.name: self._join(c, own, [(self._raw, x[1], x[2] // size) for x in parts], self.header.big) for c in wanted}
        if key not in self.ids:
            return rows, {c.name: self._join(c, own, [], False) for c in wanted}
        b = self.ids.index(key)
        here = np.flatnonzero(self._present[:, b])
        sizes = self._sizes[b][here]
        for e, n in zip(here, sizes, strict=True):
            rows[e] = self._rows(int(n), size, own)
        if self._cols[b]:
            if self._cols[b] != len(own.columns):
                raise CorruptFileError(f"bank {own.name!r} has {self._cols[b]} streams and {len(own.columns)} columns")
            out = {}
            for c in wanted:
                data = self._stream(int(self._first[b]) + own.columns.index(c))
                if len(data) != int(rows[here].sum()) * c.size:
                    raise CorruptFileError(f"column {own.name}/{c.name} has a wrong length")
                out[c.name] = _typed(np.frombuffer(data, "<" + LETTERS[c.letter][2]), c)
            return rows, out
        data, starts = self._stream(int(self._first[b])), np.concatenate(([0], np.cumsum(sizes)))
        if starts[-1] != len(data):
            raise CorruptFileError(f"bank {own.name!r} has a wrong length")
        return rows, {c.name: self._join(c, own, [(data, int(s), int(n) // size) for s, n in zip(starts, sizes, strict=False)], False) for c in wanted}

    @staticmethod
    def _rows(n: int, size: int, bank: Bank) -> int:
        if size == 0 or n % size:
            raise CorruptFileError(f"bank {bank.name!r}: {n} bytes are no whole rows of {size}")
        return n // size

    @staticmethod
    def _join(c: Column, bank: Bank, parts: list[tuple[bytes, int, int]], big: bool) -> np.ndarray:
        before = sum(x.size for x in bank.columns[: bank.columns.index(c)])
        kind = np.dtype((">" if big else "<") + LETTERS[c.letter][2])
        pieces = [np.frombuffer(data, kind, n * c.length, at + n * before) for data, at, n in parts]
        flat = np.concatenate(pieces) if pieces else np.zeros(0, kind)
        return _typed(flat.astype(kind.newbyteorder("<"), copy=False), c)

    def composites(self, group: int, item: int) -> list[tuple[str, bytes] | None]:
        """Of each event, the format and rows of a composite bank; None where it is absent or ordinary."""
        out: list[tuple[str, bytes] | None] = [None] * self.header.events
        if self.layout == "perchunk":
            for e, at, n, head, _ in reversed(self._found.get((group, item), ())):
                out[e] = (self._raw[at : at + head].split(b"\0")[0].decode("latin-1"), self._raw[at + head : at + n]) if head else None
        elif (group, item) in self.ids:
            b = self.ids.index((group, item))
            head = int(self._heads[b])
            data, at = self._stream(int(self._first[b])) if head else b"", 0
            for e in np.flatnonzero(self._present[:, b]) if head else ():
                n = int(self._sizes[b][e])
                out[e] = (data[at : at + head].split(b"\0")[0].decode("latin-1"), data[at + head : at + n])
                at += n
        return out


def _typed(flat: np.ndarray, c: Column) -> np.ndarray:
    return flat if c.length == 1 else flat.reshape(-1, c.length)


def composite_columns(form: str) -> list[Column]:
    """f0, f1, … of a composite format; characters that name no type are skipped."""
    return [Column(f"f{k}", COMPOSITE[c]) for k, c in enumerate(x for x in form.lower() if x in COMPOSITE)]


def composite_rows(form: str, data: bytes) -> np.ndarray:
    cols = composite_columns(form)
    kind = np.dtype([(c.name, "<" + LETTERS[c.letter][2]) for c in cols])
    return np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], kind) if cols else np.zeros(0, kind)


@dataclass
class FileInfo:
    """What a file says about itself, and where its records are."""

    path: str
    header: dict
    dictionary: Dictionary
    registry: TagRegistry
    config: dict[str, str]
    spans: list[RecordSpan] = field(default_factory=list)
    complete: bool = True

    @property
    def events(self) -> int:
        return sum(s.events for s in self.spans)


def read_record(source, span: RecordSpan, dictionary: Dictionary) -> Record:
    """Read and check a record; errors say which file and where."""
    try:
        raw = source.read(span.position, HEADER)
        header = RecordHeader.parse(raw, source.path, span.position)
        body = source.read(span.position + header.header_length, header.length - header.header_length)
        return Record(header, body, dictionary)
    except CorruptFileError as e:
        raise CorruptFileError(e.reason, source.path, span.position if e.offset is None else e.offset) from None


def open_file(source, salvage: bool = False) -> FileInfo:
    """Headers, dictionary and record map of a container; with salvage, whatever records can still be found."""
    dictionary, registry, config, head = Dictionary(), TagRegistry(), {}, {}
    first = 0
    try:
        head = _file_header(source)
        first = head["header_length"] + head["user_header_length"]
        if head["user_header_length"]:
            dictionary, registry, config = _dictionary(source, head["header_length"])
    except CorruptFileError:
        if not salvage:
            raise
    info = FileInfo(source.path, head, dictionary, registry, config)
    if salvage:
        info.spans, info.complete = _resync(source, first, info), False
        return info
    spans = _trailer(source, head)
    info.spans = _scan(source, first, head["trailer_position"]) if spans is None else spans
    return info


def _file_header(source) -> dict:
    raw = source.read(0, HEADER)
    if struct.unpack_from("<I", raw)[0] != FILE_WORD and struct.unpack_from(">I", raw)[0] != FILE_WORD:
        raise CorruptFileError("not an event-record container", source.path, 0)
    magic = struct.unpack_from("<I", raw, 28)[0]
    if magic not in (MAGIC, MAGIC_SWAPPED):
        raise CorruptFileError(f"file magic is {magic:#010x}", source.path, 28)
    w = struct.unpack_from((">" if magic == MAGIC_SWAPPED else "<") + "8I2Q2I", raw)
    if not 1 <= w[5] & 0xFF <= VERSION:
        raise ContainerError(f"unsupported version {w[5] & 0xFF}", source.path, 20)
    names = ("word", "file_number", "header_length", "record_count", "index_length", "bits", "user_header_length", "magic", "user_register", "trailer_position", "user_int_1", "user_int_2")
    out = dict(zip(names, w, strict=True))
    out |= {"header_length": w[2] * 4, "version": w[5] & 0xFF, "has_dictionary": bool(w[5] >> 8 & 1), "has_trailer": bool(w[5] >> 10 & 1)}
    return out


def _dictionary(source, at: int) -> tuple[Dictionary, TagRegistry, dict[str, str]]:
    header = RecordHeader.parse(source.read(at, HEADER), source.path, at)
    record = Record(header, source.read(at + header.header_length, header.length - header.header_length), Dictionary())
    if record.layout != "perchunk":
        raise CorruptFileError("the dictionary is no whole record", source.path, at)
    text = lambda key: [(e, record._raw[p : p + n].decode("utf-8", "replace").rstrip("\0")) for e, p, n, _, _ in record._found.get(key, ())]
    try:
        banks = [Bank.parse(t) for _, t in text(DICTIONARY)]
        known = {b.name for b in banks}
        banks += [b for b in (Bank.parse_json(t) for _, t in text(DICTIONARY_JSON)) if b.name not in known]
        registry = TagRegistry.parse("".join(t for _, t in text(REGISTRY)))
    except ValueError as e:
        raise CorruptFileError(str(e), source.path, at) from None
    values = dict(text(CONFIG_VALUE))
    return Dictionary(banks), registry, {k: values.get(e, "") for e, k in text(CONFIG_KEY)}


INDEX_BANK = Bank("file::index", *INDEX, (Column("position", "L"), Column("length", "I"), Column("entries", "I"), Column("userWordOne", "L"), Column("userWordTwo", "L")))


def _trailer(source, head: dict) -> list[RecordSpan] | None:
    """The record map of the trailer; None if there is none or it is no good."""
    at = head["trailer_position"]
    if not HEADER <= at <= source.size - HEADER:
        return None
    try:
        header = RecordHeader.parse(source.read(at, HEADER), source.path, at)
        record = Record(header, source.read(at + header.header_length, header.length - header.header_length), Dictionary([INDEX_BANK]))
        rows, cols = record.read(INDEX_BANK)
    except CorruptFileError:
        return None
    if not len(rows) or rows[0] < 0:
        return None
    word = lambda v: int(v) & 0xFFFFFFFFFFFFFFFF
    spans = [RecordSpan(int(p), int(n), int(e), word(a), word(b)) for p, n, e, a, b in zip(*(cols[c.name] for c in INDEX_BANK.columns), strict=True)]
    return spans if all(s.position >= HEADER and s.events >= 0 and s.position + HEADER <= at for s in spans) else None


def _scan(source, at: int, trailer: int) -> list[RecordSpan]:
    """The record map from the records themselves, one after the other, up to the trailer if there is one."""
    out, end = [], trailer if at <= trailer <= source.size else source.size
    while at + HEADER <= end:
        header = RecordHeader.parse(source.read(at, HEADER), source.path, at)
        if at + header.length > source.size:
            raise CorruptFileError("the file ends within a record", source.path, at)
        out.append(RecordSpan(at, header.length, header.events, header.user_word_1, header.user_word_2))
        at += header.length
    return out


def _candidates(source, at: int, block: int = 1 << 22) -> Iterator[int]:
    """Places on the 4-byte grid from `at` on whose header bears a magic word; the source is read in blocks."""
    words = [struct.pack("<I", m) for m in (MAGIC, MAGIC_SWAPPED)]
    while at + HEADER <= source.size:
        raw = source.read(at + 28, min(block + 3, source.size - at - 28))
        found = set()
        for w in words:
            k = raw.find(w)
            while k >= 0:
                if k % 4 == 0 and k < block:
                    found.add(at + k)
                k = raw.find(w, k + 1)
        yield from (x for x in sorted(found) if x + HEADER <= source.size)
        at += block


def _resync(source, at: int, info: FileInfo) -> list[RecordSpan]:
    """Records on the 4-byte grid that decode; a trailer isn't one of them. What lies within a good record isn't tried."""
    out, free = [], at - at % 4
    for at in _candidates(source, free):
        if at < free:
            continue
        try:
            header = RecordHeader.parse(source.read(at, HEADER), source.path, at)
            span = RecordSpan(at, header.length, header.events, header.user_word_1, header.user_word_2)
            record = read_record(source, span, info.dictionary)
        except ContainerError:
            continue
        if at and INDEX not in record.ids:
            if not info.dictionary.names() and DICTIONARY in record.ids:
                try:
                    info.dictionary, info.registry, info.config = _dictionary(source, at)
                except ContainerError:
                    continue
            elif DICTIONARY not in record.ids:
                out.append(span)
        free = at + header.length
    return out


# ---- writing


@dataclass
class Event:
    """An event to write: its tag, and (group, item, type, composite header, rows) of each structure."""

    tag: int = 0
    structures: list[tuple[int, int, int, bytes, bytes]] = field(default_factory=list)

    def bank(self, bank: Bank, columns: dict[str, np.ndarray], rows: int) -> Event:
        parts = []
        for c in bank.columns:
            a = np.ascontiguousarray(columns[c.name], "<" + LETTERS[c.letter][2])
            if a.size != rows * c.length:
                raise ValueError(f"{bank.name}/{c.name}: {a.size} values for {rows} rows of {c.length}")
            parts.append(a.tobytes())
        return self.raw(bank.group, bank.item, BANK_TYPE, b"", b"".join(parts))

    def composite(self, group: int, item: int, form: str, rows: list[tuple]) -> Event:
        cols = composite_columns(form)
        kind = np.dtype([(c.name, "<" + LETTERS[c.letter][2]) for c in cols])
        head = form.encode("latin-1")
        return self.raw(group, item, COMPOSITE_TYPE, head + b"\0" * (-len(head) % 4), np.array(rows, kind).tobytes())

    def raw(self, group: int, item: int, kind: int, head: bytes, data: bytes) -> Event:
        if len(head) + len(data) >= 1 << 24 or len(head) > 255:
            raise ValueError("a structure holds less than 16 MiB")
        self.structures.append((group, item, kind, head, data))
        return self

    def encode(self) -> bytes:
        body = b"".join(struct.pack("<HBBI", g, i, k, len(h) + len(d) | len(h) << 24) + h + d for g, i, k, h, d in self.structures)
        return b"EVNT" + struct.pack("<3I", EVENT_HEADER + len(body), self.tag & 0xFFFFFFFF, 0) + body


def encode_record(events: list[Event], codec: str = "none", layout: str = "perchunk", dictionary: Dictionary | None = None, number: int = 0, user_words: tuple[int, int] = (0, 0), level: int | None = None, byte_split: bool = False) -> bytes:
    """The bytes of a record."""
    if codec not in TAGS or layout not in LAYOUTS:
        raise ValueError(f"no codec and layout {codec}+{layout}")
    encoded = [e.encode() for e in events]
    sizes = [len(x) for x in encoded]
    if layout == "perchunk":
        body = deflate(codec, struct.pack(f"<{len(sizes)}I", *sizes) + b"".join(encoded), level)
    else:
        body = _encode_split(events, codec, layout == "percolumn", dictionary or Dictionary(), level, byte_split)
    pad = -len(body) % 4
    total = HEADER + len(body) + pad
    bits = VERSION | pad << 24 | 4 << 28
    tag = TAGS[codec][LAYOUTS.index(layout)]
    head = struct.pack("<10I2Q", total // 4, number, HEADER // 4, len(events), 4 * len(events), bits, 0, MAGIC, sum(sizes), tag << 28 | (len(body) + pad) // 4, *user_words)
    return head + body + b"\0" * pad


def _encode_split(events: list[Event], codec: str, by_column: bool, dictionary: Dictionary, level, byte_split: bool) -> bytes:
    ids = sorted({(g, i): (k, len(h)) for e in reversed(events) for g, i, k, h, _ in reversed(e.structures)}.items())
    held = [{(g, i): h + d for g, i, _, h, d in reversed(e.structures)} for e in events]
    row = -(-len(ids) // 8)
    present = np.array([[key in x for key, _ in ids] for x in held], bool).reshape(len(events), len(ids))
    flags = np.packbits(present, axis=1, bitorder="little").tobytes() if row else b""
    sizes = np.array([[len(x.get(key, b"")) for x in held] for key, _ in ids], "<u4").tobytes()
    streams, widths, columns = [], [], []
    for key, (_, head) in ids:
        whole = [x[key] for x in held if key in x]
        bank = dictionary.by_id(*key) if by_column and not head else None
        if bank is not None and bank.row_size and all(len(w) % bank.row_size == 0 for w in whole):
            columns.append(len(bank.columns))
            before = 0
            for c in bank.columns:
                rows = [len(w) // bank.row_size for w in whole]
                streams.append(b"".join(w[n * before : n * (before + c.size)] for w, n in zip(whole, rows, strict=True)))
                widths.append(c.size if c.length == 1 else 1)
                before += c.size
        else:
            columns.append(0), streams.append(b"".join(whole)), widths.append(1)
    packed, encodings = [], []
    for s, w in zip(streams, widths, strict=True):
        best, way = deflate(codec, s, level), 0
        if byte_split and by_column and w > 1 and s:
            other = deflate(codec, np.frombuffer(s, np.uint8).reshape(-1, w).T.tobytes(), level)
            best, way = min((best, 0), (other, 1), key=lambda x: len(x[0]))
        packed.append(best), encodings.append(w << 4 | way if way else 0)
    described = b"".join(struct.pack("<HBB", *key, kind) for key, (kind, _) in ids)
    lengths = [(len(p), len(s)) for p, s in zip(packed, streams, strict=True)]
    tags = struct.pack(f"<{len(events)}I", *(e.tag & 0xFFFFFFFF for e in events))
    heads = bytes(head for _, (_, head) in ids)
    if by_column:
        directory = described + struct.pack(f"<{len(columns)}H", *columns) + tags + flags + sizes + b"".join(struct.pack("<2I", *x) for x in lengths) + heads
    else:
        directory = described + b"".join(struct.pack("<I", a) for a, _ in lengths) + b"".join(struct.pack("<I", b) for _, b in lengths) + tags + flags + sizes + heads
    version = (3 if byte_split else 1) if by_column else 2
    if version == 3:
        import xxhash

        directory += bytes(encodings) + b"".join(struct.pack("<I", xxhash.xxh3_64_intdigest(p) & 0xFFFFFFFF) for p in packed)
    small = deflate("lz4", directory)
    return struct.pack("<B3x4I", version, len(ids), len(events), len(small), len(directory)) + small + b"".join(packed)


class Writer:
    """Writes one container to a binary stream. Records are flushed by events and bytes."""

    def __init__(self, out, dictionary: Dictionary, registry: TagRegistry | None = None, config: dict[str, str] | None = None, compression: str = "lz4", record_events: int = 100_000, record_bytes: int | None = None, level: int | None = None, byte_split: bool = False):
        self.codec, _, layout = compression.partition("+")
        self.layout = layout or "perchunk"
        if self.codec not in TAGS or self.layout not in LAYOUTS:
            raise ValueError(f"unknown compression {compression!r}")
        if level is not None and not 1 <= level <= 6:
            raise ValueError("zstd levels are 1 to 6")
        self.out, self.dictionary, self.level, self.byte_split = out, dictionary, level, byte_split
        self.most_events, self.most_bytes = record_events, record_bytes or (RECORD_BYTES if self.layout == "perchunk" else RECORD_BYTES_SPLIT)
        self.user_words = (0, 0)
        self._held, self._bytes, self._spans, self.events = [], 0, [], 0
        meta = [Event().raw(*DICTIONARY, BANK_TYPE, b"", b.to_text().encode()) for b in dictionary]
        if registry and len(registry):
            meta.append(Event().raw(*REGISTRY, BANK_TYPE, b"", registry.to_text().encode()))
        meta += [Event().raw(*CONFIG_KEY, STRING_TYPE, b"", k.encode()).raw(*CONFIG_VALUE, STRING_TYPE, b"", v.encode()) for k, v in (config or {}).items()]
        self._dictionary = encode_record(meta)
        self._body = [self._dictionary]
        self._at = HEADER + len(self._dictionary)

    def add(self, event: Event) -> None:
        size = sum(len(h) + len(d) + STRUCTURE for *_, h, d in event.structures) + EVENT_HEADER
        if self._held and (len(self._held) >= self.most_events or self._bytes + size > self.most_bytes):
            self.flush()
        self._held.append(event)
        self._bytes += size

    @property
    def size(self) -> int:
        """Bytes written and held so far."""
        return self._at + self._bytes

    def set_record_tag(self, word_1: int, word_2: int = 0) -> None:
        """The user words of records from here on."""
        if (word_1, word_2) != self.user_words:
            self.flush()
        self.user_words = (word_1, word_2)

    def flush(self) -> None:
        if not self._held:
            return
        raw = encode_record(self._held, self.codec, self.layout, self.dictionary, len(self._spans), self.user_words, self.level, self.byte_split)
        self._spans.append(RecordSpan(self._at, len(raw), len(self._held), *self.user_words))
        self._body.append(raw)
        self._at += len(raw)
        self.events += len(self._held)
        self._held, self._bytes = [], 0

    def finish(self) -> list[RecordSpan]:
        """Write everything with the trailer; the record map."""
        self.flush()
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        cols = {"position": [s.position for s in self._spans], "length": [s.length for s in self._spans], "entries": [s.events for s in self._spans], "userWordOne": [signed(s.user_word_1) for s in self._spans], "userWordTwo": [signed(s.user_word_2) for s in self._spans]}
        trailer = encode_record([Event().bank(INDEX_BANK, {k: np.array(v, np.int64) for k, v in cols.items()}, len(self._spans))])
        bits = VERSION | 1 << 8 | 1 << 10 | 5 << 28
        self.out.write(struct.pack("<8I2Q2I", FILE_WORD, 1, HEADER // 4, 0, 0, bits, len(self._dictionary), MAGIC, 0, self._at, 0, 0))
        for part in self._body:
            self.out.write(part)
        self.out.write(trailer)
        return self._spans


def records(source, info: FileInfo, keep: Callable[[RecordSpan], bool] = lambda s: True) -> Iterator[tuple[int, int, Record]]:
    """(index, first event, record) of a file's records that are kept; headers alone decide what is read."""
    first = 0
    for k, span in enumerate(info.spans):
        if keep(span):
            yield k, first, read_record(source, span, info.dictionary)
        first += span.events
