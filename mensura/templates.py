"""Settings to begin a project with: units of a few disciplines, written out, and the defaults shown."""

from __future__ import annotations

from .units.catalog import DERIVED, PREFIXES, default_catalog

#: Units by discipline, each with its dimension and factor in base units.
DISCIPLINES = {
    "climate": {"sverdrup": ("L^3*T^-1", "1000000"), "dobson": ("N*L^-2", "0.0004462"), "langley": ("M*T^-2", "41840"), "mbar": ("M*L^-1*T^-2", "100"), "knot": ("L*T^-1", "463/900")},
    "astronomy": {"AU": ("L", "149597870700"), "parsec": ("L", "30856775814913673"), "lightyear": ("L", "9460730472580800"), "jansky": ("M*T^-2", "1e-26"), "gauss": ("M*T^-2*I^-1", "0.0001")},
    "geosciences": {"darcy": ("L^2", "9.869233e-13"), "gal": ("L*T^-2", "0.01"), "poise": ("M*L^-1*T^-1", "0.1"), "stokes": ("L^2*T^-1", "0.0001"), "acre": ("L^2", "4046.8564224")},
    "biology-medicine": {"dalton": ("M", "1.66053906660e-27"), "mmHg": ("M*L^-1*T^-2", "133.322387415"), "katal": ("N*T^-1", "1"), "molar": ("N*L^-3", "1000"), "curie": ("T^-1", "37000000000")},
    "legacy": {"inch": ("L", "0.0254"), "foot": ("L", "0.3048"), "mile": ("L", "1609.344"), "pound": ("M", "0.45359237"), "psi": ("M*L^-1*T^-2", "6894.757293168")},
}


def entry(name: str, dim: str, factor: str) -> str:
    return f'{name} = {{dim = "{dim}", factor = "{factor}"}}'


def project(chosen: list[str]) -> str:
    """The text of a settings file: the chosen disciplines' units, and those of the others as comments."""
    if unknown := sorted(set(chosen) - set(DISCIPLINES)):
        raise ValueError(f"unknown templates: {', '.join(unknown)}; there are {', '.join(DISCIPLINES)}")
    out = ["# What the checker is told about this project.", "scale = false", "external = []", "exclude = []", "", "[units.derived]"]
    for name, units in DISCIPLINES.items():
        out.append(f"# {name}")
        out += [("" if name in chosen else "# ") + entry(n, *u) for n, u in units.items()]
    out += ["# this project's own", ""]
    return "\n".join(out)


def defaults() -> str:
    """The catalogue that holds without a settings file, as one, all commented out."""
    out = [f"# base units: {', '.join(default_catalog().base)}", f"# prefixes: {', '.join(PREFIXES)}", "[units.derived]"]
    out += ["# " + f'{name} = {{dim = "{dim}", factor = "{factor}"' + (f', offset = "{offset}"' if str(offset) not in ("0", "0.0") else "") + "}" for name, dim, factor, offset, *_ in DERIVED]
    return "\n".join(out) + "\n"
