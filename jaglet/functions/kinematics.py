"""Three- and four-vector expressions over momentum components."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rest mass of the proton target, GeV.
PROTON = 0.9382720894300001


@dataclass(frozen=True)
class Vector:
    """A momentum with an optional energy; + and - act on all components."""

    px: Column
    py: Column
    pz: Column
    energy: Column | None = None

    @property
    def p2(self) -> Column:
        return self.px * self.px + self.py * self.py + self.pz * self.pz

    @property
    def p(self) -> Column:
        return F.sqrt(self.p2)

    @property
    def pt(self) -> Column:
        return F.sqrt(self.px * self.px + self.py * self.py)

    @property
    def phi(self) -> Column:
        return F.atan2(self.py, self.px)

    @property
    def theta(self) -> Column:
        return F.atan2(self.pt, self.pz)

    @property
    def eta(self) -> Column:
        return F.asinh(self.pz / F.nullif(self.pt, F.lit(0.0)))

    @property
    def mass2(self) -> Column:
        if self.energy is None:
            raise ValueError("a three-vector has no mass")
        return self.energy * self.energy - self.p2

    @property
    def mass(self) -> Column:
        """The invariant mass; 0 where rounding makes its square negative."""
        return F.sqrt(F.greatest(self.mass2, F.lit(0.0)))

    def _with(self, other: Vector, sign: int) -> Vector:
        both = (lambda a, b: a + b) if sign > 0 else (lambda a, b: a - b)
        energy = None if self.energy is None or other.energy is None else both(self.energy, other.energy)
        return Vector(both(self.px, other.px), both(self.py, other.py), both(self.pz, other.pz), energy)

    def __add__(self, other: Vector) -> Vector:
        return self._with(other, 1)

    def __sub__(self, other: Vector) -> Vector:
        return self._with(other, -1)

    def dot(self, other: Vector) -> Column:
        space = self.px * other.px + self.py * other.py + self.pz * other.pz
        return space if self.energy is None or other.energy is None else self.energy * other.energy - space


def to_vector(row, mass: Column | None = None, momentum: tuple[str, str, str] = ("px", "py", "pz"), fields: tuple[str, ...] = ()) -> Vector:
    """The vector of a struct or row: three components, with `mass` four; an energy that is there excludes a mass."""
    x, y, z = (row[m].cast("double") for m in momentum)
    own = next((f for f in fields if f in ("E", "energy")), None)
    if own and mass is not None:
        raise ValueError(f"the rows have {own!r} already; give no mass")
    if own:
        return Vector(x, y, z, row[own].cast("double"))
    if mass is None:
        return Vector(x, y, z)
    return Vector(x, y, z, F.sqrt(x * x + y * y + z * z + mass * mass))


def delta_phi(a: Column, b: Column) -> Column:
    """a - b in (-pi, pi]."""
    d = a - b
    two = F.lit(2 * math.pi)
    wrapped = d - two * F.floor((d + math.pi) / two)
    return F.when(wrapped == -math.pi, F.lit(math.pi)).otherwise(wrapped)


def delta_r(a: Vector, b: Vector) -> Column:
    return F.sqrt(F.pow(a.eta - b.eta, F.lit(2)) + F.pow(delta_phi(a.phi, b.phi), F.lit(2)))


def dis(electron: Vector, beam: float, target: float = PROTON) -> dict[str, Column]:
    """q2, nu, xb, y and w of a scattered electron; the beam runs along z, massless."""
    nu = F.lit(beam) - electron.energy
    q2 = F.lit(2 * beam) * (electron.energy - electron.pz)
    w2 = F.lit(target * target) + 2 * target * nu - q2
    return {"q2": q2, "nu": nu, "xb": q2 / F.nullif(2 * target * nu, F.lit(0.0)), "y": nu / beam, "w": F.sqrt(F.when(w2 >= 0, w2))}


def missing_mass2(beam: float, seen: Vector, target: float = PROTON) -> Column:
    """Square of the mass that beam and target lose to what isn't seen."""
    rest = Vector(F.lit(0.0), F.lit(0.0), F.lit(float(beam)), F.lit(beam + target)) - seen
    return rest.mass2


def sidis(electron: Vector, hadron: Vector, beam: float) -> dict[str, Column]:
    """z, the hadron's share of the energy that the electron lost, and pt, its momentum across the virtual photon.

    NULL without a hadron or an electron; the beam runs along z, massless.
    """
    photon = Vector(-electron.px, -electron.py, F.lit(float(beam)) - electron.pz)
    along = Vector(hadron.px, hadron.py, hadron.pz).dot(photon) / F.nullif(photon.p, F.lit(0.0))
    across = hadron.p * hadron.p - along * along
    return {"z": hadron.energy / F.nullif(F.lit(float(beam)) - electron.energy, F.lit(0.0)), "pt": F.sqrt(F.when(across >= 0, across).when(across < 0, F.lit(0.0)))}


def fiducial(row: Column, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> Column:
    """Whether a row lies within the bounds, themselves excluded; false without the row or a bounded value."""
    inside = F.lit(True)
    for n, v in (least or {}).items():
        inside = inside & (row[n] > v)
    for n, v in (most or {}).items():
        inside = inside & (row[n] < v)
    return F.coalesce(inside, F.lit(False))


def corrected(rows: Column, names: list[str], scale, momentum: tuple[str, str, str] = ("px", "py", "pz")) -> Column:
    """Rows (columns `names`) whose momenta are multiplied by scale(row), a correction made before anything is derived."""
    return F.transform(rows, lambda r: F.struct(*[(r[n] * scale(r) if n in momentum else r[n]).alias(n) for n in names]))


def region(status: Column) -> Column:
    """Detector region of a status word: its absolute value's thousands."""
    return F.floor(F.abs(status) / 1000).cast("long")


def sampling_fraction(energy: Column, momentum: Column) -> Column:
    return energy / F.nullif(momentum, F.lit(0.0))
