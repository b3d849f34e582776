"""The units that texts may name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cache

from .algebra import BASE, SLOTS, Lin, Quantity, UnitFault

#: SI prefixes, in the order in which they are tried.
PREFIXES = {
    "Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6,
    "n": -9, "p": -12, "f": -15, "a": -18, "z": -21, "y": -24,
}

#: Name, dimension, factor, offset, kind of quantity, other names.
DERIVED = (
    ("rad", "1", "1", "0", "Angle", "radian"),
    ("sr", "1", "1", "0", "SolidAngle", "steradian"),
    ("Hz", "T^-1", "1", "0", "Frequency", "hertz"),
    ("N", "M*L*T^-2", "1", "0", "Force", "newton"),
    ("Pa", "M*L^-1*T^-2", "1", "0", "Pressure", "pascal"),
    ("J", "M*L^2*T^-2", "1", "0", "Energy", "joule"),
    ("W", "M*L^2*T^-3", "1", "0", "Power", "watt"),
    ("C", "T*I", "1", "0", "ElectricCharge", "coulomb"),
    ("V", "M*L^2*T^-3*I^-1", "1", "0", "ElectricPotential", "volt"),
    ("F", "M^-1*L^-2*T^4*I^2", "1", "0", "Capacitance", "farad"),
    ("Ohm", "M*L^2*T^-3*I^-2", "1", "0", "Resistance", "ohm"),
    ("S", "M^-1*L^-2*T^3*I^2", "1", "0", "Conductance", "siemens"),
    ("Wb", "M*L^2*T^-2*I^-1", "1", "0", "MagneticFlux", "weber"),
    ("T", "M*T^-2*I^-1", "1", "0", "MagneticFluxDensity", "tesla"),
    ("H", "M*L^2*T^-2*I^-2", "1", "0", "Inductance", "henry"),
    ("degC", "Theta", "1", "273.15", "Temperature", "celsius"),
    ("lm", "J", "1", "0", "LuminousFlux", "lumen"),
    ("lx", "J*L^-2", "1", "0", "Illuminance", "lux"),
    ("Bq", "T^-1", "1", "0", "Activity", "becquerel"),
    ("Gy", "L^2*T^-2", "1", "0", "AbsorbedDose", "gray"),
    ("kat", "N*T^-1", "1", "0", "CatalyticActivity", "katal"),
    ("min", "T", "60", "0", "Time", "minute"),
    ("hour", "T", "3600", "0", "Time", ""),
    ("day", "T", "86400", "0", "Time", ""),
    ("year", "T", "31557600", "0", "Time", "yr"),
    ("deg", "1", "0.017453292519943295", "0", "Angle", "degree"),
    ("ha", "L^2", "10000", "0", "Area", "hectare"),
    ("L", "L^3", "1/1000", "0", "Volume", "liter litre l"),
    ("t", "M", "1000", "0", "Mass", "tonne metric_ton"),
    ("eV", "M*L^2*T^-2", "1.602176634e-19", "0", "Energy", "electronvolt"),
    ("Da", "M", "1.66053906892e-27", "0", "Mass", "dalton"),
    ("bar", "M*L^-1*T^-2", "100000", "0", "Pressure", ""),
    ("mbar", "M*L^-1*T^-2", "100", "0", "Pressure", "mb"),
    ("hPa", "M*L^-1*T^-2", "100", "0", "Pressure", "hectopascal"),
    ("atm", "M*L^-1*T^-2", "101325", "0", "Pressure", "atmosphere"),
    ("percent", "1", "1/100", "0", "Ratio", ""),
    ("permille", "1", "1/1000", "0", "Ratio", ""),
    ("ppm", "1", "1/1000000", "0", "Ratio", ""),
    ("ppb", "1", "1/1000000000", "0", "Ratio", ""),
    ("ppt", "1", "1/1000000000000", "0", "Ratio", ""),
    ("ppmv", "1", "1/1000000", "0", "MoleFraction", ""),
    ("ppbv", "1", "1/1000000000", "0", "MoleFraction", ""),
)


def dimension(text: str) -> tuple[Lin, ...]:
    """The vector of a product of slot symbols such as ``M*L^-1*T^-2``."""
    out = [Fraction(0)] * 7
    for part in text.split("*"):
        name, _, exponent = part.strip().partition("^")
        if name == "1" and not exponent:
            continue
        if name not in SLOTS:
            raise UnitFault(f"no such dimension: {name}")
        try:
            out[SLOTS.index(name)] += Fraction(exponent.strip("()")) if exponent else 1
        except ValueError as e:
            raise UnitFault(f"no such exponent: {exponent}") from e
    return tuple(map(Lin, out))


@dataclass
class Catalog:
    """Base units, derived units, prefixes, and the names that take prefixes. Problems found on loading are listed."""

    base: dict[str, Quantity] = field(default_factory=dict)
    derived: dict[str, Quantity] = field(default_factory=dict)
    prefixes: dict[str, Fraction] = field(default_factory=dict)
    prefixable: set[str] = field(default_factory=set)
    kinds: dict[str, str] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)

    def find(self, name: str) -> Quantity | None:
        """By name: base, then derived, then prefix and prefixable name."""
        found = self.base.get(name) or self.derived.get(name)
        if found is not None:
            return found
        for p, factor in self.prefixes.items():
            rest = name[len(p) :]
            if name.startswith(p) and rest in self.prefixable:
                q = self.base.get(rest) or self.derived[rest]
                return Quantity(q.dims, factor * q.factor)
        return None

    def names(self) -> list[str]:
        """Everything that resolves."""
        return sorted({*self.base, *self.derived, *(p + n for p in self.prefixes for n in self.prefixable)})

    def collisions(self) -> list[str]:
        """Names that a prefix makes of another name, or that two prefixes make."""
        made: dict[str, list[str]] = {}
        for p in self.prefixes:
            for n in self.prefixable:
                made.setdefault(p + n, []).append(f"{p}+{n}")
        return sorted(n for n, ways in made.items() if len(ways) > 1 or n in self.base or n in self.derived)

    def extended(self, entries: Mapping[str, Mapping], prefixes: Mapping[str, object] = {}) -> Catalog:
        """With a project's units: each has ``dim`` or ``expr`` (in terms of known units, in any order), ``factor``,
        ``offset``, ``prefixable``, ``aliases``. Base units and prefixes stand; a derived unit may be redefined, which is
        noted."""
        from .text import parse

        out = Catalog(dict(self.base), dict(self.derived), dict(self.prefixes), set(self.prefixable), dict(self.kinds))
        for p, f in prefixes.items():
            if p in out.prefixes:
                raise UnitFault(f"prefix {p} can't be redefined")
            out.prefixes[p] = _rational(f)
        waiting = {}
        for name, e in entries.items():
            if name in out.base:
                raise UnitFault(f"base unit {name} can't be redefined")
            if name in out.derived:
                out.problems.append(f"derived unit {name} is redefined")
            waiting[name] = e
        for name in waiting:
            out.derived.pop(name, None)
        while waiting:
            done = []
            for name, e in waiting.items():
                try:
                    if "dim" in e:
                        q = Quantity(dimension(e["dim"]))
                    else:
                        q = parse(e["expr"], out).unit
                except UnitFault:
                    continue
                out.derived[name] = Quantity(q.dims, q.factor * _rational(e.get("factor", 1)), _rational(e.get("offset", 0)))
                out.kinds[name] = e.get("quantitykind", "")
                if e.get("prefixable"):
                    out.prefixable.add(name)
                done.append(name)
            if not done:
                raise UnitFault(f"units defined by each other or by unknown ones: {', '.join(sorted(waiting))}")
            for name in done:
                for alias in waiting.pop(name).get("aliases", ()):
                    out.derived[alias] = out.derived[name]
        if clash := out.collisions():
            raise UnitFault(f"prefixed names collide: {', '.join(clash)}")
        return out


def _rational(x: object) -> Fraction:
    if isinstance(x, float):
        raise UnitFault("factors and offsets must be whole numbers or text")
    try:
        return Fraction(x)
    except (ValueError, TypeError, ZeroDivisionError) as e:
        raise UnitFault(f"not a rational number: {x!r}") from e


@cache
def default_catalog() -> Catalog:
    out = Catalog(base={n: Quantity.base(i) for i, n in enumerate(BASE)}, prefixes={p: Fraction(10) ** e for p, e in PREFIXES.items()})
    out.kinds = dict(zip(BASE, ("Mass", "Length", "Time", "Temperature", "ElectricCurrent", "AmountOfSubstance", "LuminousIntensity"), strict=True))
    for name, dim, factor, offset, kind, aliases in DERIVED:
        q = Quantity(dimension(dim), Fraction(factor), Fraction(offset))
        for n in (name, *aliases.split()):
            out.derived[n], out.kinds[n] = q, kind
    out.prefixable = set(out.base)
    return out
