import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jaglet.errors import ContainerError, CorruptFileError
from jaglet.schema import Dictionary
from jaglet.sources import container as C
from jaglet.tags import TagRegistry
from tests.fixtures import EVENT, PARTICLE, PIDS

PAIRS = [f"{c}+{x}" for c in C.TAGS for x in C.LAYOUTS]


def written(compression="lz4", **options) -> bytes:
    out = io.BytesIO()
    w = C.Writer(out, Dictionary([PARTICLE, EVENT]), TagRegistry({"dvcs": 0}), {"run": "42", "empty": ""}, compression, record_events=3, **options)
    for e in range(8):
        event = C.Event(1 << (e % 3)).bank(EVENT, {"evno": np.array([1000 + e])}, 1)
        if n := e % 4:
            pid = e * 100 + np.arange(n)
            event.bank(PARTICLE, {"pid": pid, "px": e + 0.1 * np.arange(n), "cov": np.stack([pid, pid + 0.5, pid + 0.25], 1)}, n)
        event.composite(700, 5, "if", [(10, 1.5), (20, 2.5)])
        w.add(event)
    w.finish()
    return out.getvalue()


def read(raw: bytes, salvage=False):
    source = C.MemoryBytes(raw)
    info = C.open_file(source, salvage)
    pids, tags = [], []
    for _, _, r in C.records(source, info):
        rows, cols = r.read(PARTICLE, ["pid", "cov"])
        at = np.concatenate(([0], np.cumsum(np.maximum(rows, 0))))
        pids += [cols["pid"][a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        tags += r.tags.tolist()
        assert [bool(x) for x in r.present(PARTICLE)] == [x >= 0 for x in rows]
        form, data = r.composites(700, 5)[0]
        assert form == "if" and C.composite_rows(form, data)["f1"].tolist() == [1.5, 2.5]
    return info, pids, tags


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("pair", PAIRS)
def test_every_codec_and_layout(pair, split):
    info, pids, tags = read(written(pair, byte_split=split))
    assert pids == PIDS and tags == [1 << (e % 3) for e in range(8)]
    assert info.dictionary.names() == ["REC::Particle", "REC::Event"] and info.config == {"run": "42", "empty": ""} and info.registry.mask("dvcs") == 1
    assert [s.events for s in info.spans] == [3, 3, 2]


def test_scan_without_trailer():
    raw = bytearray(written())
    raw[40:48] = b"\0" * 8
    info, pids, _ = read(bytes(raw[: struct.unpack_from("<Q", written(), 40)[0]]))
    assert pids == PIDS and len(info.spans) == 3


def test_salvage():
    raw = bytearray(written("zstd+perbank"))
    raw[8:56] = b"\xff" * 48
    with pytest.raises(ContainerError):
        C.open_file(C.MemoryBytes(bytes(raw)))
    _, pids, _ = read(bytes(raw), salvage=True)
    assert pids == PIDS
    info = C.open_file(C.MemoryBytes(written()))
    hurt = bytearray(written())
    hurt[info.spans[1].position + 28] ^= 0xFF
    _, pids, _ = read(bytes(hurt), salvage=True)
    assert pids == PIDS[:3] + PIDS[6:]


def test_big_endian_whole_record():
    swap = lambda b: np.frombuffer(b, "<u4").astype(">u4").tobytes()
    event = b"EVNT"[::-1] + struct.pack(">3I", 16 + 8 + 12, 7, 0) + struct.pack(">HBBI", 300, 30, 11, 8) + struct.pack(">q", 77)
    event = event[:8] + struct.pack(">I", 7) + event[12:]
    body = struct.pack(">I", len(event)) + event
    head = struct.pack(">10I2Q", (56 + len(body) + (-len(body) % 4)) // 4, 0, 14, 1, 4, 6 | (-len(body) % 4) << 24, 0, C.MAGIC, len(event), (len(body) + (-len(body) % 4)) // 4, 0, 0)
    header = C.RecordHeader.parse(head)
    assert header.big
    r = C.Record(header, body + b"\0" * (-len(body) % 4), Dictionary([EVENT]))
    rows, cols = r.read(EVENT)
    assert rows.tolist() == [1] and cols["evno"].tolist() == [77] and r.tags.tolist() == [7]
    assert swap(b"\1\0\0\0") == b"\0\0\0\1"


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["none", "lz4+percolumn", "zstd+perbank"]), st.integers(0, 10**6), st.integers(1, 255))
def test_damage_is_an_error_or_harmless(pair, at, bits):
    raw = bytearray(written(pair))
    raw[at % len(raw)] ^= bits
    try:
        source = C.MemoryBytes(bytes(raw))
        info = C.open_file(source)
        for _, _, r in C.records(source, info):
            for b in (PARTICLE, EVENT):
                rows, cols = r.read(b)
                assert all(len(v) == np.maximum(rows, 0).sum() for v in cols.values())
    except (ContainerError, KeyError):
        pass


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_truncation_is_an_error_or_a_shorter_read(cut):
    raw = written("gzip+percolumn")
    try:
        source = C.MemoryBytes(raw[: cut % len(raw)])
        for _, _, r in C.records(source, C.open_file(source)):
            r.read(PARTICLE)
    except ContainerError:
        pass


@given(st.binary(max_size=3000))
def test_lz4_length(data):
    packed = C.deflate("lz4", data)
    assert not data or C.lz4_length(packed) == len(data)
    assert C.inflate("lz4", packed, len(data)) == data
    if data:
        with pytest.raises(CorruptFileError):
            C.inflate("lz4", packed, len(data) + 1)


def test_limits():
    with pytest.raises(CorruptFileError):
        C.inflate("zstd", b"x", 1 << 30)
    with pytest.raises(ValueError):
        C.Event().raw(1, 1, 11, b"", b"\0" * (1 << 24))
    with pytest.raises(ValueError):
        C.Writer(io.BytesIO(), Dictionary(), compression="rar")
    with pytest.raises(ValueError):
        C.Writer(io.BytesIO(), Dictionary(), compression="zstd", level=9)
    empty = io.BytesIO()
    C.Writer(empty, Dictionary([EVENT])).finish()
    info = C.open_file(C.MemoryBytes(empty.getvalue()))
    assert info.events == 0 and info.spans == []
