"""Reading sources and the comments in them."""

import pytest

from mensura.sources import comments, fortran
from mensura.sources.comments import Pattern


def one(text, kind="assign"):
    src = fortran.read(text)
    assert not src.errors
    return next(s for s in src.statements if s.kind == kind)


@pytest.mark.parametrize(
    "text,shape",
    [
        ("a = b + c*d**2", ("math", "+")), ("a = -b**2", ("unary", "-")), ("a(i, 2:n) = f(x, y=3.0)", ("call", "f")), ("o%p%q = r%s(2)%t", ("member", "t")),
        ("a = (b)", ("paren", "")), ("a = 1.5d-3_dp", ("number", "1.5d-3_dp")), ("a = 'it''s ! no comment'", ("string", "'it''s ! no comment'")), ("if (x > 1) a = b", ("identifier", "b")),
        ("a = b .and. .not. c", ("logic", ".and.")), ("a = [1.0, 2.0]", ("array", "")), ("p => q", ("identifier", "q")), ("where (m) a = b/c", ("math", "/")),
        ("a = &\n  & b - &\n  ! between\n  c", ("math", "-")), ("10 a = b", ("identifier", "b")), ("a = x**(-0.5)", ("math", "**")),
    ],
)
def test_expressions(text, shape):
    value = one(text).nodes[1]
    assert (value.kind, value.text) == shape


def test_power_binds_to_the_right_and_sums_to_the_left():
    v = one("a = b**c**d").nodes[1]
    assert v.children[1].text == "**"
    v = one("a = b - c - d").nodes[1]
    assert v.children[0].text == "-" and v.span == (1, 4, 1, 13)


def test_structure():
    src = fortran.read(
        """module m
  use other, only: x, y => z
  use third, w => v
  private
  public :: t
  type t
    real(dp) :: mass = 1.0, speed(3)
  end type t
  integer, parameter :: n = 3
contains
  pure real function f(a, b) result(r)
    real, intent(in) :: a, &
       b
    real, save :: s
    common /blk/ q
    call g(a, key=b); r = a
  end function
end module
"""
    )
    assert [(s.kind, s.name, s.parent, s.args, s.result) for s in src.scopes] == [("module", "m", None, [], None), ("function", "f", "m", ["a", "b"], "r")]
    assert [(u.module, u.only, u.renames) for u in src.uses] == [("other", [("x", "x"), ("y", "z")], []), ("third", None, [("w", "v")])]
    d = {n.name: (d.type, d.scope, d.owner, d.parameter, d.save, n.line) for d in src.declarations for n in d.names}
    assert d["mass"] == ("real", "m", "t", False, False, 7) and d["speed"][2] == "t" and d["n"][3] and d["b"][5] == 13 and d["s"][4]
    assert ("m", "t") in src.shown and "m" in src.private and ("f", "blk") in src.commons
    assert [s.kind for s in src.statements] == ["call", "assign"]


def test_what_cannot_be_read_is_a_region():
    src = fortran.read("program p\n a = b +* c\n x = (1\n y = 2\nend program")
    assert [e[0] for e in src.errors] == [2, 3] and len(src.statements) == 1


@pytest.mark.parametrize("line,at", [("x = 1 ! c", 6), ("s = '!' ! c", 8), ("s = '!'", None), ("s = 'open ! c", None), ("! c", 0), ("no comment", None), ("s = \"it's\" !", 11)])
def test_comment_start(line, at):
    assert comments.comment_start(line) == at


def test_annotations():
    text = """!> @unit{kg}
real :: a
real :: b  !< @unit{m/s}  more
real :: c  ! @unit{K}
! prose about @unit{nothing}
x = y
! @unit{s}
real :: d
real :: e  !< @unit{m} @unit{s}
real :: f  !< @unit{}
real :: g  !< @unit{m
z = 1  !< @unit_assume{K : because}
z = 2  !< @unit_assume{K}
w = t + 1  !< @unit_affine_conversion{degC -> K}
"""
    got = comments.scan(text, declared=frozenset({2, 3, 4, 8, 9, 10, 11}))
    assert [(x.kind, x.line, x.unit) for x in got.annotations] == [("PRE", 1, "kg"), ("POST", 3, "m/s"), ("POST", 4, "K"), ("PRE", 7, "s")]
    assert [(i[0], i[1]) for i in got.issues] == [("U001", 9), ("U001", 9), ("U001", 10), ("U001", 11), ("U001", 13)]
    assert (got.assumes[0].first, got.assumes[0].second) == ("K", "because") and (got.conversions[0].first, got.conversions[0].second) == ("degC", "K")


def test_patterns_and_dead_ranges():
    two = (Pattern("@unit{"), Pattern("[", "]"))
    got = comments.scan("a = 1 !< @unit{kg} [m]\nb = 1 !< [s]\nc = 1 !< \\f$ [x] \\f$ [K]\n", two, (Pattern("\\f$", "\\f$"),))
    assert [x.unit for x in got.annotations] == ["kg", "s", "K"] and [i[0] for i in got.issues] == ["U021"]


def test_preprocessor_and_line_map():
    from mensura.sources.preprocess import expand, needed

    text = '#define N 3\n#ifdef OLD\na = 1\n#elif defined(NEW) && N > 2\na = N\n#else\na = 2\n#endif\n#include "c.h"\nb = 1\n'
    assert expand(text, {"NEW": ""}, lambda n: "c = N\nd = 1\n" if n == "c.h" else None) == ("a = 3\nc = 3\nd = 1\nb = 1\n", [5, 9, 9, 10])
    assert expand(text, {"OLD": ""})[0] == "a = 1\nb = 1\n" and expand(text)[0] == "a = 2\nb = 1\n"
    assert needed("x.F90", text, {"A": ""}, False) and not needed("x.f90", text, {"A": ""}, False) and not needed("x.F90", "a = 1", {"A": ""}, True)
