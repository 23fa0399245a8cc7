"""Physical units: a scale and integer or half-integer powers of base units. ``None`` stands for "no unit" (indices, booleans)."""

from __future__ import annotations

import re
from fractions import Fraction
from math import isclose, pi


class UnitError(RuntimeError):
    pass


# Base symbols, derived units as (scale, powers), decimal prefixes.
BASES = ("m", "kg", "s", "A", "K", "mol", "cd", "rad", "counts")
DERIVED: dict[str, tuple[float, dict[str, int]]] = {
    "one": (1.0, {}), "dimensionless": (1.0, {}), "percent": (0.01, {}), "g": (1e-3, {"kg": 1}), "count": (1.0, {"counts": 1}), "deg": (pi / 180, {"rad": 1}),
    "Hz": (1.0, {"s": -1}), "N": (1.0, {"kg": 1, "m": 1, "s": -2}), "J": (1.0, {"kg": 1, "m": 2, "s": -2}), "W": (1.0, {"kg": 1, "m": 2, "s": -3}),
    "Pa": (1.0, {"kg": 1, "m": -1, "s": -2}), "C": (1.0, {"A": 1, "s": 1}), "V": (1.0, {"kg": 1, "m": 2, "s": -3, "A": -1}), "T": (1.0, {"kg": 1, "s": -2, "A": -1}),
    "eV": (1.602176634e-19, {"kg": 1, "m": 2, "s": -2}), "angstrom": (1e-10, {"m": 1}), "Å": (1e-10, {"m": 1}), "L": (1e-3, {"m": 3}), "bar": (1e5, {"kg": 1, "m": -1, "s": -2}),
    "min": (60.0, {"s": 1}), "h": (3600.0, {"s": 1}), "hour": (3600.0, {"s": 1}), "D": (86400.0, {"s": 1}), "day": (86400.0, {"s": 1}),
    "month": (2629746.0, {"s": 1}), "M": (2629746.0, {"s": 1}), "year": (31556952.0, {"s": 1}), "Y": (31556952.0, {"s": 1}),
}
PREFIXES = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "µ": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}

ALIASES: dict[str, Unit] = {}
_TERM = re.compile(r"\s*([*/])?\s*(?:([A-Za-zÅµ%]+)|(\d+(?:\.\d+)?(?:e[+-]?\d+)?))(?:\s*(?:\^|\*\*)\s*\(?\s*(-?\d+(?:/\d+)?)\s*\)?)?")


class Unit:
    """``Unit("kg*m/s^2")``; also ``mm``, ``us``, ``1/s`` and names given to :func:`alias`."""

    def __init__(self, text: str | Unit = "one"):
        if isinstance(text, Unit):
            self.scale, self.powers = text.scale, dict(text.powers)
            return
        self.scale, self.powers, at = 1.0, {}, 0
        while at < len(text.strip()):
            m = _TERM.match(text, at)
            if not m:
                raise UnitError(f"not a unit: {text!r}")
            power = Fraction(m[4] or 1) * (-1 if m[1] == "/" else 1)
            part = _named(m[2], text) if m[2] else _made(float(m[3]), {})
            self.scale *= part.scale ** float(power)
            for base, p in part.powers.items():
                self.powers[base] = self.powers.get(base, Fraction(0)) + p * power
            at = m.end()
        self.powers = {b: p for b, p in self.powers.items() if p}

    def __mul__(self, other: Unit) -> Unit:
        return _made(self.scale * other.scale, {b: self.powers.get(b, 0) + other.powers.get(b, 0) for b in {**self.powers, **other.powers}})

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def __pow__(self, power: float) -> Unit:
        return _made(self.scale ** float(power), {b: p * Fraction(power).limit_denominator(1000) for b, p in self.powers.items()})

    def __eq__(self, other: object) -> bool:
        other = Unit(other) if isinstance(other, str) else other
        return isinstance(other, Unit) and self.powers == other.powers and isclose(self.scale, other.scale, rel_tol=1e-12)

    def __hash__(self) -> int:
        return hash(frozenset(self.powers.items()))

    def __str__(self) -> str:
        named = next((n for n in ("dimensionless", *BASES, *DERIVED) if self == Unit(n)), None)
        if named:
            return named
        body = "*".join(b if p == 1 else f"{b}^{p}" if p.denominator == 1 else f"{b}^({p})" for b, p in sorted(self.powers.items()))
        return body if self.scale == 1 else f"{self.scale:g}*{body}" if body else f"{self.scale:g}"

    __repr__ = __str__

    def factor_to(self, other: Unit) -> float:
        if self.powers != other.powers:
            raise UnitError(f"cannot convert {self} to {other}")
        return self.scale / other.scale


def _made(scale: float, powers: dict) -> Unit:
    unit = Unit.__new__(Unit)
    unit.scale, unit.powers = scale, {b: Fraction(p) for b, p in powers.items() if p}
    return unit


def _named(name: str, text: str) -> Unit:
    if name in ALIASES:
        return ALIASES[name]
    if name in BASES:
        return _made(1.0, {name: 1})
    if name in DERIVED:
        return _made(*DERIVED[name])
    if name[0] in PREFIXES and (name[1:] in BASES or name[1:] in DERIVED):
        return _made(PREFIXES[name[0]], {}) * _named(name[1:], text)
    raise UnitError(f"not a unit: {text!r}")


def alias(**names: str | Unit) -> None:
    """Give units names of one's own, as in ``alias(speed="m/s")``."""
    ALIASES.update({n: Unit(u) for n, u in names.items()})


def remove_alias(*names: str) -> None:
    for name in names:
        ALIASES.pop(name, None)


def unit_of(x: str | Unit | None) -> Unit | None:
    return Unit(x) if isinstance(x, str) else x


ONE, COUNTS, RAD, DEG = Unit("one"), Unit("counts"), Unit("rad"), Unit("deg")
