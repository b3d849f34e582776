"""A small C preprocessor for Fortran: conditions, plain macros, includes, and where each line came from."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

#: An include directive, for finding what a text includes.
INCLUDE = r"(?m)^[ \t]*#[ \t]*include[ \t]+[\"<]([^\">\n]+)[\">]"
_DIRECTIVE = re.compile(r"\s*#\s*(\w+)\s*(.*)")


def needed(path: str, text: str, defines: Mapping[str, str], includes: bool) -> bool:
    """Sources in upper-case suffixes with directives, if there is anything to define or include."""
    return path.rsplit(".", 1)[-1][:1] == "F" and bool(defines or includes) and any(line.lstrip().startswith("#") for line in text.splitlines())


def _truth(text: str, macros: Mapping[str, str]) -> bool:
    """A condition of defined(), names, numbers, comparisons, !, && and ||."""
    text = re.sub(r"defined\s*\(?\s*(\w+)\s*\)?", lambda m: str(int(m[1] in macros)), text)
    text = re.sub(r"[A-Za-z_]\w*", lambda m: (macros.get(m[0], "0") or "0") if re.fullmatch(r"-?\d*", macros.get(m[0], "0")) else "0", text)
    tokens = re.findall(r"\d+|&&|\|\||[<>=!]=|[<>!()+-]", text)
    at = 0

    def take(*signs: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at] in signs:
            at += 1
            return tokens[at - 1]
        return None

    def atom() -> int:
        nonlocal at
        if take("!"):
            return int(not atom())
        if take("-"):
            return -atom()
        if take("("):
            x = either()
            take(")")
            return x
        at += 1
        return int(tokens[at - 1]) if at <= len(tokens) and tokens[at - 1].isdigit() else 0

    def compared() -> int:
        x = atom()
        while op := take("<", ">", "<=", ">=", "==", "!="):
            y = atom()
            x = int({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "==": x == y, "!=": x != y}[op])
        return x

    def both() -> int:
        x = compared()
        while take("&&"):
            y = compared()
            x = int(bool(x) and bool(y))
        return x

    def either() -> int:
        x = both()
        while take("||"):
            y = both()
            x = int(bool(x) or bool(y))
        return x

    return bool(either())


def expand(text: str, defines: Mapping[str, str] | None = None, include: Callable[[str], str | None] = lambda name: None, depth: int = 0) -> tuple[str, list[int]]:
    """The text without directives, and for each of its lines the line (from 1) of the source that it came from; lines of an
    included text came from the line that includes it. Lines that don't hold are left out."""
    macros = dict(defines or {})
    out: list[str] = []
    came: list[int] = []
    stack: list[list[bool]] = []  # [holds, some branch has held, all around hold]
    on = lambda: all(s[0] for s in stack)
    for number, line in enumerate(text.splitlines(), 1):
        m = _DIRECTIVE.match(line)
        if m is None:
            if on():
                names = [n for n in macros if macros[n] and n in line]
                for n in names:
                    line = re.sub(rf"\b{re.escape(n)}\b", lambda _, n=n: macros[n], line)
                out.append(line)
                came.append(number)
            continue
        word, rest = m[1], m[2].strip()
        if word in ("ifdef", "ifndef", "if"):
            holds = on() and (((rest.split() or [""])[0] in macros) == (word == "ifdef") if word != "if" else _truth(rest, macros))
            stack.append([holds, holds, on()])
        elif word in ("else", "elif") and stack:
            s = stack[-1]
            s[0] = s[2] and not s[1] and (word == "else" or _truth(rest, macros))
            s[1] |= s[0]
        elif word == "endif" and stack:
            stack.pop()
        elif word == "define" and on() and re.match(r"\w+(\s|$)", rest):
            name, _, value = rest.partition(" ")
            macros[name] = value.strip()
        elif word == "undef" and on():
            macros.pop(rest, None)
        elif word == "include" and on() and depth < 20:
            body = include(rest.strip('"<>'))
            if body is not None:
                inner, _ = expand(body, macros, include, depth + 1)
                out += inner.splitlines()
                came += [number] * len(inner.splitlines())
    return "\n".join(out) + "\n" * bool(out), came
