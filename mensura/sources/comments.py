"""Unit annotations and directives in the comments of a source text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

#: Text before the first exclamation mark outside quotes.
_CODE = re.compile(r"""((?:[^!'"]|'[^']*'|"[^"]*")*)!""")


@dataclass(frozen=True)
class Pattern:
    """Delimiters of a kind of capture; what parts its two halves, if it has two; and an expression that its stripped text
    must match as a whole to count, if there is one."""

    opening: str
    closing: str = "}"
    sep: str | None = None
    regex: str | None = None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out, at = [], 0
        while (a := text.find(self.opening, at)) >= 0 and (b := text.find(self.closing, a + len(self.opening))) >= 0:
            at = b + len(self.closing)
            inner = text[a + len(self.opening) : b]
            if self.regex is None or re.fullmatch(self.regex, inner.strip()):
                out.append((a, at, inner))
        return out


UNIT = (Pattern("@unit{"),)
ASSUME, AFFINE = (Pattern("@unit_assume{", sep=":"),), (Pattern("@unit_affine_conversion{", sep="->"),)


@dataclass
class Annotation:
    kind: str  # PRE or POST
    line: int
    col: int
    end_col: int
    unit: str


@dataclass
class Directive:
    line: int
    col: int
    end_col: int
    first: str  # assumed unit, or source unit
    second: str  # reason, or target unit


@dataclass
class Comments:
    annotations: list[Annotation] = field(default_factory=list)
    assumes: list[Directive] = field(default_factory=list)
    conversions: list[Directive] = field(default_factory=list)
    issues: list[tuple[str, int, int, int, str]] = field(default_factory=list)  # code, line, col, end, message
    pre_lines: list[int] = field(default_factory=list)


def comment_start(line: str) -> int | None:
    """Where a line's comment starts (from 0); a quote that stays open hides what follows it."""
    m = _CODE.match(line) if "!" in line else None
    return len(m[1]) if m else None


def scan(
    text: str, patterns: Iterable[Pattern] = UNIT, dead: Iterable[Pattern] = (), declared: frozenset[int] = frozenset(),
    assumes: tuple[Pattern, ...] = ASSUME, conversions: tuple[Pattern, ...] = AFFINE,
) -> Comments:
    """All annotations. patterns: the first that captures on a line wins; dead: captures that overlap these don't count;
    assumes, conversions: the directives' patterns; declared: lines on which declarations begin, below which a plain comment counts as being about them."""
    out = Comments()
    patterns = tuple(patterns)
    for number, line in enumerate(text.splitlines(), 1):
        at = comment_start(line)
        if at is None:
            continue
        body, mark = line[at:], line[at + 1 : at + 2]
        if mark in (">", "!"):
            out.pre_lines.append(number)
        code = line[:at].strip()
        if not code and mark not in ("<", ">", "!") and number + 1 not in declared:
            continue  # prose
        gone = [(a, b) for d in dead for a, b, _ in d.spans(body)]
        live = lambda spans, gone=gone: [s for s in spans if not any(s[0] < b and a < s[1] for a, b in gone)]
        directives = [("assume", p, out.assumes) for p in assumes] + [("conversion", p, out.conversions) for p in conversions]
        for what, p, store in directives:
            found = live(p.spans(body))
            for a, b, inner in found:
                left, _, right = (x.strip() for x in inner.partition(p.sep or ":"))
                if left and right:
                    store.append(Directive(number, at + a, at + b, left, right))
                else:
                    out.issues.append(("U001", number, at + a, at + b, f"unit {what} needs two parts, parted by {p.sep or ':'!r}"))
            if not found and p.opening in body:
                out.issues.append(("U001", number, at, len(line), f"unit {what} isn't closed"))
        captured = [(i, live(p.spans(body))) for i, p in enumerate(patterns)]
        captured = [(i, c) for i, c in captured if c]
        if not captured:
            if any(p.opening in body for p in patterns) and not gone:
                out.issues.append(("U001", number, at, len(line), "unit annotation isn't closed"))
            continue
        (_, first), *others = captured
        if len(first) > 1:
            out.issues += [("U001", number, at + a, at + b, "more than one unit annotation on a line") for a, b, _ in first]
            continue
        a, b, unit = first[0]
        if not unit.strip():
            out.issues.append(("U001", number, at + a, at + b, "unit annotation is empty"))
            continue
        for _, c in others:
            if c[0][2].strip() != unit.strip():
                out.issues.append(("U021", number, at + c[0][0], at + c[0][1], f"patterns disagree: {unit.strip()} holds, not {c[0][2].strip()}"))
        if mark == "<" or (mark not in (">", "!") and code):
            kind = "POST"
        else:
            kind = "PRE"
            if mark not in (">", "!"):
                out.pre_lines.append(number)
        out.annotations.append(Annotation(kind, number, at + a, at + b, unit.strip()))
    return out
