"""The whole check over small sources, by expected findings."""

import json
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from mensura.plans import check as C
from mensura.plans import lookup, report
from mensura.settings import Settings, load
from mensura.shared import keeper

GEO = """module geo
contains
  function thrust(flow, exit_speed) result(newtons)
    real, intent(in) :: flow        !< @unit{kg/s}
    real, intent(in) :: exit_speed  !< @unit{m/s}
    real :: newtons                 !< @unit{N}
    newtons = flow * exit_speed
  end function
  subroutine throttle(setting, loss)
    real, intent(inout) :: setting  !< @unit{kg/s}
    real, intent(in) :: loss        !< @unit{1}
    setting = setting - setting * loss
  end subroutine
  function same(x) result(y)
    real, intent(in) :: x   !< @unit{'a}
    real :: y               !< @unit{'a}
    y = x
  end function
  function forced(x) result(y)
    real, intent(in) :: x   !< @unit{'a}
    real :: y               !< @unit{'a}
    real :: k               !< @unit{kg}
    y = x + k
  end function
  function both(p, q) result(y)
    real, intent(in) :: p   !< @unit{'a}
    real, intent(in) :: q   !< @unit{'a}
    real :: y               !< @unit{'a}
    y = p + q
  end function
end module
"""
MAIN = """program main
  use geo
  use nowhere
  real :: s = 1.0    !< @unit{m}
  real :: a          !< @unit{m^2}
  real :: burn       !< @unit{kg/s}
  real :: jet        !< @unit{m/s}
  real :: push       !< @unit{N}
  real :: kg1        !< @unit{kg}
  real :: p          !< @unit{Pa}
  real :: h          !< @unit{hPa}
  real :: c          !< @unit{degC}
  real :: k          !< @unit{K}
  real :: bad        !< @unit{furlong}
  real :: v          !< @unit{'b}
  real :: none
  type ball
    real :: m  !< @unit{kg}
  end type
  type(ball) :: b
  !> @unit{m}

  real :: x1, &      !< @unit{m}
          x2
  integer :: i
  push = thrust(burn, jet)
  kg1 = thrust(burn, jet)
  call throttle(burn, 0.5)
  call throttle(burn, loss=kg1)
  b%m = s
  p = h
  k = c
  k = c + 273.15     !< @unit_affine_conversion{degC -> K}
  k = c - 273.15     !< @unit_affine_conversion{degC -> K}
  k = k + 1.0
  k = k + 0.0
  k = s ** i
  p = exp(log(p))
  p = log(p)
  k = sin(k)
  k = max(k, p)
  none = s
  k = same(k)
  p = same(k)
  k = same(c)
  p = both(p, k)
  p = s              !< @unit_assume{Pa : measured}
  a = s ** 2
  a = sqrt(s) ** 4
  p = s +* 2
end program
"""


@pytest.fixture(scope="module")
def checked(spark):
    sources = spark.createDataFrame([("geo.f90", GEO), ("main.f90", MAIN)], "path string, text string")
    return C.check(sources, Settings(scale=True))


def test_findings(checked):
    line = {t.strip(): i for i, t in enumerate(MAIN.splitlines(), 1)}
    got = {(r["path"], r["sl"], r["code"]) for r in checked.diagnostics.collect()}
    m = lambda text, code: ("main.f90", line[text], code)
    want = {
        ("geo.f90", GEO[: GEO.index("y = x + k")].count("\n") + 1, "H023"), m("kg1 = thrust(burn, jet)", "H001"), m("call throttle(burn, loss=kg1)", "H004"), m("b%m = s", "H001"), m("p = h", "S001"), m("k = c", "S002"),
        m("k = c - 273.15     !< @unit_affine_conversion{degC -> K}", "S003"), m("k = k + 1.0", "H010"), m("k = s ** i", "H001"), m("p = log(p)", "H010"),
        m("k = sin(k)", "H003"), m("k = sin(k)", "H001"), m("k = max(k, p)", "H002"), m("real :: none", "U005"), m("p = same(k)", "H001"), m("k = same(c)", "H022"),
        m("p = both(p, k)", "H020"), m("p = s              !< @unit_assume{Pa : measured}", "U020"), m("p = s +* 2", "P001"), m("use nowhere", "U007"),
        m("real :: bad        !< @unit{furlong}", "U002"), m("real :: v          !< @unit{'b}", "H021"), m("!> @unit{m}", "U006"), ("main.f90", line["real :: x1, &      !< @unit{m}"], "U025"),
    }
    assert got == want


def test_scale_is_opt_in_and_severities_are_set(spark):
    sources = spark.createDataFrame([("geo.f90", GEO), ("main.f90", MAIN)], "path string, text string")
    d = C.check(sources, Settings(severities={"U005": "off", "D1.5": "info"}, external=("NoWhere",))).diagnostics.collect()
    codes = {r["code"] for r in d}
    assert not codes & {"S001", "S002", "U005", "U007"} and {r["severity"] for r in d if r["rule"] == "D1.5"} == {"info"}


def test_coverage_and_summary(checked):
    rows = {r["path"]: r for r in C.coverage_figures(checked).collect()}
    assert set(rows) == {None, "geo.f90", "main.f90"} and rows[None]["total"] == rows["geo.f90"]["total"] + rows["main.f90"]["total"]
    g = rows["geo.f90"]
    assert g["fire"] == 1 and g["ok"] + g["warn"] + g["fire"] + g["unparsed"] + g["out"] == g["total"]
    assert "geo.f90: 1 H, 0 U" in report.summary_lines(checked)
    told = json.loads("".join(report.coverage_json(checked)))
    assert told["total"]["total"] == rows[None]["total"] and {f["path"] for f in told["files"]} == {"geo.f90", "main.f90"}
    lines = list(report.diagnostics_lines(checked, trace=True))
    assert report.exit_code(checked) == 1 and len(lines) == checked.diagnostics.count() and any("[D1.5]" in x for x in lines)
    assert {(r["code"], r["n"]) for r in report.histogram(checked).collect()} >= {("U020", 1), ("H022", 1)}


def test_interactions(checked):
    points, clashes = report.interactions(checked, "KG1")
    kinds = [r["kind"] for r in points.collect()]
    assert kinds == ["declares", "contributes", "requires"] and {r["unit"] for r in clashes.collect()} == {"kg*m/s^2", "1"}
    assert any("X001" in x for x in report.interactions_lines(checked, "kg1"))


def test_lookups(checked):
    assert [(r["path"], r["line"]) for r in lookup.definitions(checked, "THRUST", "main.f90").collect()] == [("geo.f90", 3)]
    assert lookup.definitions(checked, "kg1", "geo.f90").count() == 0
    assert "hPa" in lookup.completions("h", "real :: x !< @unit{h", 20) and lookup.completions("h", "x = '@unit{h", 12) == []
    env = C.environment([{"unit_text": "kg", "owner": None, "scope": None, "name": "a", "line": 1, "col": 0}, {"unit_text": "m", "owner": None, "scope": None, "name": "b", "line": 1, "col": 0}], [], [], Settings())
    tree = lookup.expression_tree("real :: a, b\na = a + b\n", 2, env)
    assert [(t["text"], t["own"], t["row"]) for t in tree] == [("a", "green", "green"), ("+", "red", "red"), ("a", "green", "green"), ("b", "green", "green")]


def test_first_file_wins_and_copies_in_other_scopes_stand_apart(spark):
    a = "subroutine s\n real :: w !< @unit{m/s}\n real :: v !< @unit{m/s}\n w = v\nend subroutine\n"
    b = "subroutine r\n real :: w !< @unit{kg}\n real :: v !< @unit{kg}\n w = v\nend subroutine\n"
    assert C.check(spark.createDataFrame([("a.f90", a), ("b.f90", b)], "path string, text string")).diagnostics.count() == 0


def test_names_passed_on_through_modules(spark):
    base = "module base\n real :: g !< @unit{m}\n real :: h !< @unit{kg}\n real, private :: own !< @unit{s}\nend module\n"
    user = "program user_{0}\n use {0}\n real :: x !< @unit{{s}}\n real :: y !< @unit{{s}}\n x = g\n y = h\nend program\n"
    modules = {f"m{i}": f" use {'base' if i == 0 else f'm{i - 1}'}\n" for i in range(12)}
    modules |= {
        "renamed": " use base, only: g => h\n", "closed": " use base\n private\n public :: h\n", "hides": " use base\n private :: h\n",
        # what a module declares wins, with a unit or without; modules may use one another
        "shadow": " use base\n use circle\n real :: g !< @unit{s}\n real :: h\n", "circle": " use shadow\n",
    }
    files = {"base.f90": base} | {f"{n}.f90": f"module {n}\n{body}end module\n" for n, body in modules.items()}
    asked = {"base": {5, 6}, "m0": {5, 6}, "m11": {5, 6}, "renamed": {5}, "closed": {6}, "hides": {5}, "circle": set()}
    files |= {f"user_{n}.f90": user.format(n) for n in asked}
    checked = C.check(spark.createDataFrame(list(files.items()), "path string, text string"))
    got = {(r["path"], r["sl"], r["code"]) for r in checked.diagnostics.where("code <> 'U005'").collect()}
    assert got == {(f"user_{n}.f90", line, "H001") for n, lines in asked.items() for line in lines}
    checked.close()


FLAGS = """program flags
#include "decls.inc"
#ifdef METRIC
  real :: x  !< @unit{m}
#else
  real :: x  !< @unit{kg}
#endif
  real :: y  !< @unit{m}
  x = y
  y = LENGTH_OF
end program
"""


def test_preprocessed_sources(spark):
    headers = spark.createDataFrame([("decls.inc", "  implicit none\n#include \"more/inner.inc\"\n"), ("more/inner.inc", "  real :: inner  !< @unit{s}\n")], "name string, text string")
    sources = spark.createDataFrame([("flags.F90", FLAGS), ("plain.f90", FLAGS)], "path string, text string")
    checked = C.check(sources, Settings(defines={"LENGTH_OF": "inner"}), headers=headers)
    mine = lambda df: df.where("path = 'flags.F90'").collect()
    # lines are those of the file; what is included is known; a branch that doesn't hold isn't read
    assert sorted((r["sl"], r["code"]) for r in mine(checked.diagnostics)) == [(9, "H001"), (10, "H001")]
    assert {(r["name"], r["line"]) for r in mine(checked.units)} == {("inner", 2), ("x", 6), ("y", 8)}
    assert [r["number"] for r in mine(checked.facts.where("fact = 'file'"))] == [11]
    edited = spark.createDataFrame([("flags.F90", FLAGS, True), ("f.F90", FLAGS, False)], "path string, text string, edited boolean")
    got = {r["path"]: r for r in C.preprocessed(edited, Settings(defines={"METRIC": "1"}), headers, keeper(spark)).collect()}
    assert got["flags.F90"]["came"] is None and got["f.F90"]["came"] == [1, 2, 2, 4, 8, 9, 10, 11] and "@unit{kg}" not in got["f.F90"]["text"]


def test_conflicts_of_scale(spark):
    text = "program s\n real :: p !< @unit{Pa}\n real :: h !< @unit{hPa}\n p = h\nend program\n"
    points = C.check(spark.createDataFrame([("s.f90", text)], "path string, text string"), Settings(scale=True)).points
    assert C.conflicts(points).count() == 0
    assert [(r["name"], r["line"], r["factor"], r["reference_factor"]) for r in C.conflicts(points, scale=True).orderBy("name", "line").collect()] == [("h", 4, "1", "100"), ("p", 4, "100", "1")]


def test_panels_and_actions(spark):
    text = "program s\n real :: p !< @unit{m}\n real :: q\n real :: bad !< @unit{m**2}\n q = p\nend program\n"
    checked = C.check(spark.createDataFrame([("s.f90", text)], "path string, text string"))
    assert [(r["name"], r["unit_text"]) for r in lookup.panel(checked, "s.f90").collect()] == [("p", "m"), ("q", None), ("bad", "m**2")]
    assert [(r["line"], r["label"]) for r in lookup.inlays(checked, "s.f90", 5, 5).collect()] == [(5, "[m]")]
    assert [r["insert"] for r in lookup.code_actions(checked, "s.f90", 3).collect()] == ["!< @unit{m}"]
    assert [r["insert"] for r in lookup.code_actions(checked, "s.f90", 4).collect()] == ["m^2"]
    assert lookup.imports_panel(checked, "s.f90").count() == 0


def test_command_line(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "src").mkdir()
    (tmp_path / "lib" / "base.f90").write_text("module base\n real :: g !< @unit{m}\nend module\n")
    (tmp_path / "lib" / "other.f90").write_text("module other\n real :: z !< @unit{furlong}\nend module\n")
    (tmp_path / "src" / "a.f90").write_text("program a\n use base\n real :: x !< @unit{s}\n x = g\nend program\n")
    run = lambda *args: subprocess.run([sys.executable, "-m", "mensura", *args], capture_output=True, text=True, cwd=tmp_path, timeout=300)
    assert run("check", "nowhere").returncode == 2 and run("check", "--quiet", str(tmp_path / "lib" / "nothing")).returncode == 2
    got = run("check", "--workspace", "lib", "--cache", str(tmp_path / "cache"), "--timings", "src")
    assert got.returncode == 1 and "H001" in got.stdout and "furlong" not in got.stdout and "U007" not in got.stdout and "H001 error 1" in got.stderr
    assert run("init", "-t", "climate").returncode == 0 and load(tmp_path / "mensura.toml").read("sverdrup").factor == 10**6
    assert run("init").returncode == 2 and run("init", "--force", "-t", "none").returncode == 1
    (tmp_path / "mensura.toml").write_text("scale = [")
    assert run("check", "src").returncode == 2


def test_settings(tmp_path):
    f = tmp_path / "mensura.toml"
    f.write_text('scale = true\n[units.derived]\nknot = {dim = "L*T^-1", factor = "463/900"}\n[lexer]\nimplicit_product = true\n[severity]\nU005 = "off"\n')
    s = load(f)
    assert s.problem is None and s.scale and s.read("kg knot").factor * 900 == 463 and s.severities == {"U005": "off"}
    f.write_text('[patterns]\nunit = [["[", "]"]]\nassume = [{open = "as<", close = ">", sep = ";"}]\ndead = [{open = "[", close = "]", regex = "[0-9]+"}]\n')
    s = load(f)
    notes = s.comments("real :: x  !< [m]\nreal :: y  !< [12]\nx = y  !< as<kg ; so it is>\n", frozenset())
    assert [(a.line, a.unit) for a in notes.annotations] == [(1, "m")] and [(a.line, a.first, a.second) for a in notes.assumes] == [(3, "kg", "so it is")]
    f.write_text('[patterns]\ndead = [{open = "(", regex = "("}]\n')
    assert load(f).problem
    f.write_text("scale = [")
    assert load(f).problem and load(None).problem is None


def test_kept_findings_are_those_of_a_fresh_check(spark, tmp_path):
    cache, rows = str(tmp_path / "cache"), [("geo.f90", GEO), ("main.f90", MAIN)]
    found = lambda rows, cache=None: sorted(map(str, C.check(spark.createDataFrame(rows, "path string, text string"), Settings(scale=True), cache).diagnostics.collect()))
    assert found(rows, cache) == found(rows)
    typed = lambda: spark.read.parquet(cache).where("what = 'typed'").count()
    assert typed() == 2 and found(rows, cache) == found(rows) and typed() == 2
    other = [("geo.f90", GEO.replace("@unit{N}", "@unit{J}")), ("main.f90", MAIN)]  # changes what main gets, too
    assert found(other, cache) == found(other) and typed() == 4


def broadcast_by_path(spark, monkeypatch, frame):
    """Joins by path that would go through the driver, in the plans of all that a check writes and of what ``frame`` makes of
    it; the tables here are small enough that Spark would broadcast any of them."""
    plans = []
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()

    class Watched:
        def __init__(self, session):
            self.keep = keeper(session)

        def __call__(self, df):
            plans.append(shown(df))
            return self.keep(df)

        def __getattr__(self, name):
            return getattr(self.keep, name)

    monkeypatch.setattr(C, "keeper", Watched)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    checked = C.check(spark.createDataFrame([("geo.f90", GEO), ("main.f90", MAIN)], "path string, text string"))
    made = frame(checked)
    plans.append(shown(made))
    assert made.count() and len(plans) > 5
    checked.close()
    return [x for p in plans for x in re.findall(r"Broadcast\w*Join \[[^\]]*\b(?:path|p)#.*", p)]


def test_findings_of_all_files_stay_out_of_the_driver(spark, monkeypatch):
    assert broadcast_by_path(spark, monkeypatch, lambda c: c.diagnostics) == []


def test_histogram_and_conflicts_stay_out_of_the_driver(spark, monkeypatch):
    both = lambda c: report.histogram(c).select("code").unionByName(C.conflicts(c.points).select(F.col("name").alias("code")))
    assert broadcast_by_path(spark, monkeypatch, both) == []


def test_findings_have_small_plans(spark):
    """The joins that attach units are done once, not in each kind of finding."""
    checked = C.check(spark.createDataFrame([("geo.f90", GEO), ("main.f90", MAIN)], "path string, text string"))
    plan = report.histogram(checked)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 20
    checked.close()
