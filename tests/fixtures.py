"""Event frames of known content."""

from jaglet.frame import EventChain
from jaglet.schema import Bank, Dictionary

PARTICLE = Bank.parse("{REC::Particle/300/1}{pid/I,px/F,cov/F#3}")
EVENT = Bank.parse("{REC::Event/300/30}{evno/L}")
FRAME = "event_id long, file_index int, file_path string, record_index int, record_tag long, event_tag long, `REC::Particle` array<struct<pid:int,px:float,cov:array<float>>>, `REC::Event` array<struct<evno:long>>"
PIDS = [[], [100], [200, 201], [300, 301, 302], [], [500], [600, 601], [700, 701, 702]]


def sample(spark) -> EventChain:
    """Eight events, three to a record; e % 4 particles, none at all for e = 0 and 4."""
    rows = []
    for e in range(8):
        particles = [(e * 100 + r, e + r * 0.1, [float(e * 100 + r), e * 100 + r + 0.5, e * 100 + r + 0.25]) for r in range(e % 4)] or None
        rows.append((e, 0, "mem", e // 3, 0, 1 << (e % 3), particles, [(1000 + e,)]))
    out = EventChain.from_frame(spark.createDataFrame(rows, FRAME).coalesce(1), {"dvcs": 0, "sidis": 1, "elastic": 2}, {"run": "42"})
    out.dictionary = Dictionary([PARTICLE, EVENT])
    return out
