import pytest
from hypothesis import given
from hypothesis import strategies as st

from jaglet.errors import SchemaConflict
from jaglet.operators.batches import RecordRow, plan, step_size
from jaglet.operators.filters import FilterSpec, merge_ranges
from jaglet.operators.jagged import Cut
from jaglet.operators.sinks import dangling, safe_names
from jaglet.schema import LETTERS, Bank, Column, Dictionary, match_names, resolve_banks
from jaglet.tags import TagRegistry, TagSet

P = Bank.parse("{REC::Particle/300/1}{pid/I,px/F,cov/F#3}")
E = Bank.parse("{REC::Event/300/30}{evno/L}")
C = Bank.parse("{REC::Calorimeter/332/11}{pindex/S,energy/F}")


def test_text_and_json_agree():
    assert P.to_text() == "{REC::Particle/300/1}{pid/I,px/F,cov/F#3}" and P.row_size == 20
    assert Bank.parse_json('{"name":"A","group":1,"item":2,"entries":[{"name":"x","type":"F#4"}]}') == Bank.parse("{A/1/2}{x/F#4}")
    for bad in ("{A/1}{x/I}", "{A/1/2}{x/Q}", "{A/1/2}{x/I#0}", "{A/1/2}{x/I,x/F}", "{A/1/999}{x/I}", "nothing"):
        with pytest.raises(ValueError):
            Bank.parse(bad)


names = st.text("abcXYZ_", min_size=1, max_size=6)


@given(names, st.integers(0, 65535), st.integers(0, 255), st.lists(st.tuples(names, st.sampled_from(sorted(LETTERS)), st.integers(1, 9)), min_size=1, max_size=5, unique_by=lambda c: c[0]))
def test_text_round_trip(name, group, item, cols):
    bank = Bank(name, group, item, tuple(Column(*c) for c in cols))
    assert Bank.parse(bank.to_text()) == bank


def test_union():
    other = Bank.parse("{OTHER::Thing/400/1}{v/I}")
    both = Dictionary.union([("a", Dictionary([P, E])), ("b", Dictionary([E, other]))])
    assert both.names() == ["REC::Particle", "REC::Event", "OTHER::Thing"]
    with pytest.raises(SchemaConflict, match="REC::Particle"):
        Dictionary.union([("a", Dictionary([P])), ("b", Dictionary([Bank.parse("{REC::Particle/300/1}{pid/L}")]))])
    with pytest.raises(SchemaConflict, match="IMPOSTOR"):
        Dictionary.union([("a", Dictionary([P])), ("b", Dictionary([Bank.parse("{IMPOSTOR::Bank/300/1}{x/I}")]))])


def test_patterns():
    d = Dictionary([P, E, C])
    assert match_names(d, "REC::P*") == {"REC::Particle": ["pid", "px", "cov"]}
    assert match_names(d, ["*/p*"]) == {"REC::Particle": ["pid", "px"], "REC::Calorimeter": ["pindex"]}
    assert match_names(d, "none*") == {}
    assert resolve_banks(d, "REC::C*,REC::Event") == ["REC::Event", "REC::Calorimeter"]
    for bad in ("REC::None", "X*"):
        with pytest.raises(KeyError):
            resolve_banks(d, bad)


def test_dangling():
    hb = Bank.parse("{RECHB::Particle/310/1}{pid/I}")
    d = Dictionary([P, E, C, hb])
    assert dangling(d, ["REC::Event", "REC::Calorimeter"]) == ["REC::Calorimeter"]
    assert dangling(d, ["REC::Particle", "REC::Calorimeter"]) == []


def test_tags():
    t = TagSet.of(0, 3)
    assert t == 9 and t.contains(1) and not t.contains(3) and t.intersects(3) and t.indices() == [0, 3] and TagSet(1 << 31).indices() == [31]
    r = TagRegistry({"dvcs": 0, "sidis": 5})
    assert r.mask_of(["dvcs", "sidis"]) == 33 and r.name(5) == "sidis" and r.position("x") is None and TagRegistry.parse(r.to_text()).to_text() == r.to_text()
    for bad in ("", " a", "a=b", "a\nb"):
        with pytest.raises(ValueError):
            TagRegistry({bad: 1})
    with pytest.raises(KeyError):
        r.mask_of(["dvcs", "nope"])
    with pytest.raises(ValueError):
        TagSet(1 << 32)


def test_filters_narrow():
    d, r = Dictionary([P, E]), TagRegistry({"dvcs": 0, "sidis": 1})
    f = FilterSpec().narrowed(d, r, require="REC::Event", record_tag=[1, 2, 3])
    f = f.narrowed(d, r, require=["REC::Particle", "REC::Event"], record_tag=[2, 3, 4], event_tag=["dvcs", 4])
    assert f.require == ("REC::Event", "REC::Particle") and f.record_tags == {2, 3} and f.any_mask == 5 and f.event_tags is None and f.active
    with pytest.raises(ValueError):
        f.narrowed(d, r, record_tag=9)
    with pytest.raises(ValueError):
        f.narrowed(d, r, event_tag_any=1)
    with pytest.raises(KeyError):
        f.narrowed(d, r, require="REC::None")
    assert FilterSpec().narrowed(d, r, event_tag=[1, 2]).narrowed(d, r, event_tag=2).event_tags == {2}


def test_ranges_and_steps():
    assert merge_ranges([(5, 9), (0, 3), (2, 4), (9, 12), (7, 7), (-5, 1)], 11) == [(0, 4), (5, 11)]
    assert step_size(10) == (10, None) and step_size("1 KiB") == (None, 1024) and step_size("2.5 MB") == (None, 2_500_000)
    for bad in (0, -1, "x", "10", "0 MB", "3 parsecs"):
        with pytest.raises(ValueError):
            step_size(bad)
    with pytest.raises(TypeError):
        step_size(True)
    table = [RecordRow(f, f"f{f}", f * 10 + k * 4, min(4, 10 - 4 * k), 100) for f in (0, 1) for k in range(3)]
    assert [(c.start, c.stop) for c in plan(table, 8)] == [(0, 8), (8, 10), (10, 18), (18, 20)]
    assert [(c.start, c.stop) for c in plan(table, 1, 2, 13)] == [(2, 4), (4, 8), (8, 10), (10, 13)]
    assert [(c.start, c.stop) for c in plan(table, "250 B")] == [(0, 8), (8, 10), (10, 18), (18, 20)]
    assert plan(table, 5, 20) == []


def test_cut_text():
    cols = {"pid": False, "px": True}
    assert not Cut("pid = 11 and abs(px) > 2", cols).by_event
    assert Cut("pid = 11", cols).sql("a") == "filter(a, r -> coalesce(r.`pid` = 11, false))"
    assert Cut("any(pid = 11) AND num() > 1", cols).by_event
    with pytest.raises(ValueError):
        Cut("1 = 1", cols)
    with pytest.raises(ValueError):
        Cut("any(pid = 1) and px > 2", cols).sql("a")


def test_safe_names():
    assert safe_names(["REC::Particle/pid", "1x"]) == ["REC_Particle_pid", "_1x"]
    with pytest.raises(ValueError):
        safe_names(["a::b", "a/b"])
