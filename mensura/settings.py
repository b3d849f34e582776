"""A project's settings, from a TOML file found upwards of its sources."""

from __future__ import annotations

import hashlib
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .sources.comments import AFFINE, ASSUME, UNIT, Comments, Pattern, scan
from .units import Catalog, Quantity, UnitFault, default_catalog, parse
from .units.text import WIDENINGS

FILE = "mensura.toml"
VERSION = 2  # of the rules; findings kept by another aren't used


@dataclass
class Settings:
    catalog: Catalog = field(default_factory=default_catalog)
    allow: tuple[str, ...] = ()  # spellings, names of WIDENINGS
    strip_tags: bool = False
    kept_tags: tuple[str, ...] = ()
    patterns: tuple[Pattern, ...] = UNIT
    dead: tuple[Pattern, ...] = ()  # captures that overlap these don't count
    assumes: tuple[Pattern, ...] = ASSUME
    conversions: tuple[Pattern, ...] = AFFINE
    scale: bool = False
    external: tuple[str, ...] = ()  # modules that needn't be there
    severities: dict[str, str] = field(default_factory=dict)  # by rule or code; "off" drops
    exclude: tuple[str, ...] = ()
    defines: dict[str, str] = field(default_factory=dict)  # macros for sources that are preprocessed
    includes: tuple[str, ...] = ()  # folders of what they include
    problem: str | None = None  # why the file couldn't be used

    @property
    def digest(self) -> str:
        """Of all that findings depend on."""
        return hashlib.sha256(repr((VERSION, sorted(self.catalog.derived.items()), self.catalog.prefixes, self.allow, self.strip_tags, self.kept_tags, self.patterns, self.dead, self.assumes, self.conversions, self.scale, sorted(self.defines.items()))).encode()).hexdigest()

    def comments(self, text: str, declared: frozenset[int]) -> Comments:
        return scan(text, self.patterns, self.dead, declared, self.assumes, self.conversions)

    def read(self, text: str) -> Quantity:
        return parse(text, self.catalog, self.allow, self.strip_tags, self.kept_tags).unit


def _pattern(entry: list | dict, sep: str | None) -> Pattern:
    """A pattern of ``[opening, closing]`` or of a table with open, close, sep and regex."""
    p = Pattern(entry["open"], entry.get("close", "}"), entry.get("sep", sep), entry.get("regex")) if isinstance(entry, dict) else Pattern(*entry[:2], entry[2] if len(entry) > 2 else sep)
    re.compile(p.regex or "")
    if not p.opening or not p.closing:
        raise ValueError("a pattern needs an opening and a closing text")
    return p


def find(start: Path) -> Path | None:
    return next((d / FILE for d in (start, *start.parents) if (d / FILE).is_file()), None)


def load(path: Path | None) -> Settings:
    """Settings of a file; one that can't be used gives the defaults and says why."""
    if path is None:
        return Settings()
    try:
        raw = tomllib.loads(Path(path).read_text())
        units = raw.get("units", {})
        lexer = raw.get("lexer", {})
        own = lambda kind, sep=None: tuple(_pattern(p, sep) for p in raw.get("patterns", {}).get(kind, ()))
        defines = raw.get("preprocess", {}).get("defines", {})
        if unknown := set(lexer) - set(WIDENINGS) - {"strip_tags", "kept_tags"}:
            raise UnitFault(f"unknown spellings: {', '.join(sorted(unknown))}")
        return Settings(
            catalog=default_catalog().extended(units.get("derived", {}), units.get("prefixes", {})) if units else default_catalog(),
            allow=tuple(n for n in WIDENINGS if lexer.get(n)),
            strip_tags=bool(lexer.get("strip_tags")),
            kept_tags=tuple(lexer.get("kept_tags", ())),
            patterns=own("unit") or UNIT,
            dead=own("dead"),
            assumes=own("assume", ":") or ASSUME,
            conversions=own("conversion", "->") or AFFINE,
            scale=bool(raw.get("scale", False)),
            external=tuple(raw.get("external", ())),
            severities=dict(raw.get("severity", {})),
            exclude=tuple(raw.get("exclude", ())),
            defines={str(k): str(v) for k, v in (defines.items() if isinstance(defines, dict) else [d.partition("=")[::2] for d in defines])},
            includes=tuple(raw.get("preprocess", {}).get("includes", ())),
        )
    except (OSError, ValueError, TypeError, KeyError, re.error) as e:
        return Settings(problem=str(e))
