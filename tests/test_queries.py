"""Every query with SQL against DuckDB, the others for what they give; streams against tables; sources from files."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mensura.operators import attach, cache, captures, imports
from mensura.plans import driver, unit_queries
from mensura.shared import keeper
from mensura.sources import comments
from mensura.sources.files import glob_expression, outermost, read_headers, read_sources, with_overrides
from mensura.streaming import edits

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


ALL, SQL = driver.QUERIES | unit_queries.QUERIES, driver.ORACLES | unit_queries.ORACLES


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = ALL[name](spark, SF), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda ds: sorted(tuple(repr(d[c]) for c in cols) for d in ds)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(want.columns, r, strict=True)) for r in want.fetchall())


def test_two_claims_of_one_line(spark, duck, tmp_path):
    """Claims of one line: the first in the table is kept, whatever its value; null claims are none, null lines come last."""
    rows = "(1, 7, 1, 'R'), (1, 7, 1, 'A'), (2, 7, 1, 'A'), (2, 7, 1, 'R'), (3, 5, 1, NULL), (3, 5, 2, 'R'), (3, 6, 1, 'A'), (4, NULL, 1, 'A'), (4, 9, 1, 'R'), (5, 1, NULL, 'A'), (5, 1, 2, 'N')"
    duck.sql(f"COPY (FROM (VALUES {rows}) AS t(l_partkey, l_orderkey, l_linenumber, l_returnflag)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    want = sorted(duck.sql(SQL["q22_two_claims"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'")).fetchall())
    got = ALL["q22_two_claims"](spark, f"file://{tmp_path}").select("l_partkey", "kept", "n_claims").collect()
    assert sorted(map(tuple, got)) == want == [(1, "R", 2), (2, "A", 2), (3, "R", 2), (4, "R", 2), (5, "N", 2)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_parts():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q14_coverage' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_lines_and_markers(spark):
    df = spark.createDataFrame([(1, "a\r\nb\x0cc\n"), (2, ""), (3, None), (4, "x !< m\n\n")], "id long, text string")
    assert [(r["id"], r["line"], r["content"]) for r in captures.lines(df).orderBy("id", "line").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, "x !< m"), (4, 2, "")]
    m = spark.createDataFrame([("x !< a",), ("!> b",), ("!! c",), ("! d",), ("'!<'",)], "t string").select(captures.marker(F.col("t"))).collect()
    assert [r[0] for r in m] == ["POST", "PRE", "PRE", None, None]


def test_long_lines(spark):
    """Lines of a million characters: quoted, bare, with a comment at their end, in expressions and in Python."""
    rows = [(1, "x" * 1_000_000 + "! c"), (2, "'a'" * 300_000 + "! c"), (3, "'!' " * 250_000), (4, "'" + "!" * 1_000_000), (5, "b" * 20_000 + '"!"!')]
    got = {r["id"]: r["at"] for r in spark.createDataFrame(rows, "id int, line string").select("id", captures.comment_start(F.col("line")).alias("at")).collect()}
    assert got == {1: 1_000_000, 2: 900_000, 3: None, 4: None, 5: 20_003}
    assert {i: comments.comment_start(t) for i, t in rows} == got


def test_long_texts_with_many_captures(spark):
    n = 20_000
    row = spark.createDataFrame([("é<p>a</p>" * n + "<b><p>x</p></b>",)], "t string").select(captures.capture_spans(F.col("t"), "<p>", "</p>").alias("p"), captures.capture_spans(F.col("t"), "<b>", "</b>").alias("b"))
    got = row.select("p", captures.outside(F.col("p"), F.col("b")).alias("live")).first()
    assert [(x["start"], x["end"], x["body"]) for x in got["p"][:3]] == [(1, 9, "a"), (10, 18, "a"), (19, 27, "a")] and len(got["p"]) == n + 1
    assert got["live"] == got["p"][:-1]


def test_chains_of_any_length(spark):
    keep = keeper(spark)
    n = 100
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a int, b int")
    got = {(r["a"], r["b"]): r["depth"] for r in imports.closure(edges, keep).collect()}
    assert got == {(i, j): j - i for i in range(n + 1) for j in range(i + 1, n + 1)}
    assert imports.reachable(edges, spark.createDataFrame([(95,)], "node int"), keep).count() == 6
    keep.close()


def test_load_order_with_cycles(spark):
    keep = keeper(spark)
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("w", "x"), ("d", "gone")], "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in "abcdwxy"], "node string")
    assert [r["node"] for r in imports.load_order(edges, nodes, keep).orderBy("place").collect()] == ["a", "d", "b", "c", "w", "x", "y"]


def test_globs_and_roots(spark, tmp_path):
    match = lambda pattern, path: re.search(glob_expression(pattern), path) is not None
    assert match("old*", "/r/older/a.f90") and not match("old", "/r/older/a.f90") and match("src/**/x.f90", "/r/src/a/b/x.f90") and match("src/**/x.f90", "/r/src/x.f90")
    assert match("m[0-3].f90", "/r/m2.f90") and not match("m[!0-3].f90", "/r/m2.f90") and match("a+b.f90", "/r/a+b.f90") and not match("*.f90", "/r/a.F90")
    assert outermost(["/a/b", "/a", "/a/", "/ab", "x"]) == ["/a", "/ab", "x"]
    (tmp_path / "inc" / "sub").mkdir(parents=True)
    (tmp_path / "inc" / "sub" / "a.inc").write_text("one")
    (tmp_path / "inc2" / "sub").mkdir(parents=True)
    (tmp_path / "inc2" / "sub" / "a.inc").write_text("two")
    assert [(r["name"], r["text"]) for r in read_headers(spark, [f"{tmp_path}/inc", f"{tmp_path}/inc2/"]).collect()] == [("sub/a.inc", "one")]


def test_closure_and_levels_with_a_cycle(spark):
    keep = keeper(spark)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "a int, b int")
    got = {(r["a"], r["b"]): r["depth"] for r in imports.closure(e, keep).collect()}
    assert got[4, 3] == 3 and got[1, 3] == 2 and (1, 1) not in got
    lv = {r["node"]: r["level"] for r in imports.levels(e, spark.createDataFrame([(i,) for i in range(1, 7)], "node int"), keep).collect()}
    assert lv == {1: None, 2: None, 3: None, 4: None, 5: 1, 6: 0}


def test_innermost_and_prune(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50), ("g", 5)], "path string, pos int")
    ranges = spark.createDataFrame([("f", 0, 20, "outer"), ("f", 4, 8, "inner")], "path string, start int, end int, name string")
    assert {(r["path"], r["pos"], r["name"]) for r in attach.innermost(points, ranges, ["path"], "pos", "name").collect()} == {("f", 5, "inner"), ("f", 50, None), ("g", 5, None)}
    rows = spark.createDataFrame([(i, 10) for i in range(100)], "age long, size long")
    assert sorted(r["age"] for r in cache.prune(rows, "age", "size", 250, width=16).collect()) == list(range(75, 100))


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.f90").write_text("é")
    (tmp_path / "sub" / "b.F90").write_bytes(b"\xe9")
    (tmp_path / "c.txt").write_text("no")
    src = read_sources(spark, [str(tmp_path)])
    assert sorted(r["text"] for r in src.collect()) == ["é", "é"]
    assert read_sources(spark, [str(tmp_path)], ["sub"]).count() == 1
    path = next(r["path"] for r in src.collect() if r["path"].endswith("a.f90"))
    new = with_overrides(src, spark.createDataFrame([(path, "new"), ("z.f90", "more")], "path string, text string"))
    assert sorted(r["text"] for r in new.collect()) == ["more", "new", "é"]


def test_edit_streams(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [("u", 1, at(0), "a"), ("u", 2, at(200), "b"), ("u", 3, at(5000), "c"), ("w", 5, at(100), "x"), ("w", 4, at(300), "old")]
    schema = "uri string, version long, ts timestamp, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = {(r["uri"], r["version"], r["text"], r["n_edits"]) for r in edits.debounced(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert batch == {("u", 2, "b", 2), ("u", 3, "c", 1), ("w", 5, "x", 2)}
    shown = {(r["uri"], r["edge"], r["version"]) for r in edits.throttled(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert shown == {("u", "leading", 1), ("u", "trailing", 2), ("u", "leading", 3), ("w", "leading", 5), ("w", "leading", 4)}
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = edits.superseding(stream).writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["uri"], r["version"], r["text"]) for r in spark.table("newest").collect()} == {("u", 3, "c"), ("w", 5, "x")}
