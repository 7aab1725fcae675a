"""Units as a factor and exponents of dimensions, and the species' own units."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Base units and the project's own, as a factor and exponents of amount, length, time and mass.
UNITS: dict[str, tuple[float, dict[str, int]]] = {
    "mol": (1.0, {"amount": 1}),
    "m": (1.0, {"length": 1}),
    "s": (1.0, {"time": 1}),
    "g": (1.0, {"mass": 1}),
    "h": (3600.0, {"time": 1}),
    "hour": (3600.0, {"time": 1}),
    "day": (86400.0, {"time": 1}),
    "year": (365.25 * 86400, {"time": 1}),
    "ppm": (1e-6, {}),
    "ppb": (1e-9, {}),
    "ppt": (1e-12, {}),
    "gC": (1 / 12.011, {"amount": 1}),
    "gCO2": (1 / 44.0, {"amount": 1}),
    "gCH4": (1 / 16.04, {"amount": 1}),
}
PREFIXES = {"P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "n": 1e-9, "p": 1e-12}

#: Units of emissions, mixing ratios, budgets and of the optimisation of each species.
SPECIES: dict[str, dict[str, str]] = {
    "co2": {"emission": "umol/m2/s", "mix": "ppm", "budget": "PgC", "optimisation": "umol"},
    "ch4": {"emission": "nmol/m2/s", "mix": "ppb", "budget": "TgCH4", "optimisation": "nmol"},
    "bc": {"emission": "umol/m2/s", "mix": "ppt", "budget": "GgC", "optimisation": "umol"},
}


def species(name: str) -> dict[str, str]:
    return SPECIES[name.lower()]


@dataclass(frozen=True)
class Unit:
    factor: float
    exponents: dict[str, int] = field(default_factory=dict)

    def power(self, dimension: str) -> int:
        return self.exponents.get(dimension, 0)

    def __mul__(self, other: Unit) -> Unit:
        keys = self.exponents.keys() | other.exponents.keys()
        return Unit(self.factor * other.factor, {k: n for k in keys if (n := self.power(k) + other.power(k))})

    def __pow__(self, n: int) -> Unit:
        return Unit(self.factor**n, {k: v * n for k, v in self.exponents.items()})


def one(name: str) -> Unit:
    if name in UNITS:
        return Unit(UNITS[name][0], dict(UNITS[name][1]))
    if name[:1] in PREFIXES and name[1:] in UNITS:
        factor, exponents = UNITS[name[1:]]
        return Unit(PREFIXES[name[0]] * factor, dict(exponents))
    raise ValueError(f"unknown unit: {name}")


def known(name: str) -> bool:
    return name in UNITS or (name[:1] in PREFIXES and name[1:] in UNITS)


def factor_of(part: str) -> Unit:
    """A number, or a unit with or without an exponent: `m2`, `s-1`, `m^-2`, `gCH4`."""
    if re.fullmatch(r"[0-9.]+", part):
        return Unit(float(part))
    if known(part):
        return one(part)
    got = re.fullmatch(r"(.+?)\^?(-?[0-9]+)", part)
    if not got:
        raise ValueError(f"unknown unit: {part}")
    return one(got[1]) ** int(got[2])


def unit(text: str) -> Unit:
    """`umol/m2/s`, `s m3 kg-1`, `kg m**-2`, `1` ..."""
    out, sign = Unit(1.0), 1
    for token in re.findall(r"/|[^\s/*]+", text.replace("**", "^")):
        if token == "/":
            sign = -1
        else:
            out *= factor_of(token) ** sign
            sign = 1
    return out


@dataclass(frozen=True)
class Conversion:
    """value * factor * area**area_power * seconds**time_power."""

    factor: float
    area_power: int
    time_power: int


def conversion(source: str, target: str) -> Conversion:
    """From one unit to another, of which the powers of length and time may differ by an area or a time step."""
    a, b = unit(source), unit(target)
    length, time = b.power("length") - a.power("length"), b.power("time") - a.power("time")
    if a.power("length") not in (-2, 0, 2) or b.power("length") not in (-2, 0, 2) or length not in (-2, 0, 2):
        raise ValueError(f"no conversion over areas from {source} to {target}")
    if time not in (-1, 0, 1):
        raise ValueError(f"no conversion over time from {source} to {target}")
    rest = lambda u: {k: n for k, n in u.exponents.items() if k not in ("length", "time")}
    if rest(a) != rest(b):
        raise ValueError(f"{source} and {target} measure different things")
    return Conversion(a.factor / b.factor, length // 2, time)


def is_extensive(text: str) -> bool:
    """Whether values of the unit add up over time."""
    return unit(text).power("time") == 0
