"""Particle masses and names by code, as Spark expressions over tables that may be edited at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masses in GeV. 45, 46, 47 and 49 are nuclei in the Geant3 numbering.
MASS_GEV: dict[int, float] = {
    11: 0.0005109989506900001, -11: 0.0005109989506900001, 13: 0.1056583755, -13: 0.1056583755, 15: 1.7769300000000001, -15: 1.7769300000000001,
    12: 0.0, -12: 0.0, 14: 0.0, -14: 0.0, 16: 0.0, -16: 0.0, 22: 0.0,
    211: 0.13957039000000002, -211: 0.13957039000000002, 111: 0.1349768, 321: 0.49367700000000003, -321: 0.49367700000000003, 130: 0.49761099999999997, 310: 0.49761099999999997,
    221: 0.547862, 223: 0.78266, 331: 0.95778, 333: 1.01946,
    2212: 0.9382720894300001, -2212: 0.9382720894300001, 2112: 0.9395654219, -2112: 0.9395654219, 3122: 1.115683, -3122: 1.115683,
    3222: 1.1893699999999998, 3212: 1.192642, 3112: 1.197449, 3322: 1.31486, 3312: 1.32171, 3334: 1.67245,
    1000010020: 1.87561293134931, 1000010030: 2.80892112314931, 1000020030: 2.80839153219862, 1000020040: 3.72737933279862,
    45: 1.87561293134931, 46: 2.80892112314931, 47: 3.72737933279862, 49: 2.80839153219862,
}
# Short names.
NAME: dict[int, str] = {
    11: "e-", -11: "e+", 13: "mu-", -13: "mu+", 15: "tau-", -15: "tau+", 12: "nu(e)", -12: "nu(e)~", 14: "nu(mu)", -14: "nu(mu)~", 16: "nu(tau)", -16: "nu(tau)~", 22: "gamma",
    211: "pi+", -211: "pi-", 111: "pi0", 321: "K+", -321: "K-", 130: "K(L)0", 310: "K(S)0", 221: "eta", 223: "omega(782)", 331: "eta'(958)", 333: "phi(1020)",
    2212: "p", -2212: "p~", 2112: "n", -2112: "n~", 3122: "Lambda", -3122: "Lambda~", 3222: "Sigma+", 3212: "Sigma0", 3112: "Sigma-", 3322: "Xi0", 3312: "Xi-", 3334: "Omega-",
    1000010020: "D2", 1000010030: "T3", 1000020030: "He3", 1000020040: "He4", 45: "D2", 46: "T3", 47: "He4", 49: "He3",
}


def _lookup(code: Column, table: dict, default: Column) -> Column:
    entries = [F.lit(x) for k, v in table.items() for x in (int(k), v)]
    return F.coalesce(F.try_element_at(F.create_map(*entries), code.cast("int")), default) if entries else default


def pdg_mass(code: Column, unit: str = "GeV", unknown: float = math.nan) -> Column:
    """The mass of a code, in GeV or MeV; codes that aren't in the table, 0 among them, give `unknown`."""
    if unit not in ("GeV", "MeV"):
        raise ValueError(f"unit must be GeV or MeV: {unit!r}")
    scale = 1.0 if unit == "GeV" else 1000.0
    return _lookup(code, {k: v * scale for k, v in MASS_GEV.items()}, F.lit(float(unknown)))


def pdg_name(code: Column, unknown: str = "?") -> Column:
    return _lookup(code, NAME, F.lit(unknown))


def pdg_masses(codes: Column, unit: str = "GeV", unknown: float = math.nan) -> Column:
    """pdg_mass of every element of an array."""
    return F.transform(codes, lambda c: pdg_mass(c, unit, unknown))
