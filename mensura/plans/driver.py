"""Queries of the operators over the star schema, each with the SQL that gives the same rows.

The tables carry no units, so the queries claim some by fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import with_parsed
from ..operators import attach, cache, captures, catalog, coverage, imports, merge
from ..shared import keeper
from ..streaming import edits
from ..units.catalog import DERIVED, PREFIXES
from . import lookup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


big = lambda c: F.col(c).cast("long")


# ---- texts


@query(
    "q01_lines",
    "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, "
    "CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS BIGINT) AS longest FROM documents",
)
def q01(spark, d):
    parts = F.split("text", "\n", -1)
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("n_lines"), F.array_max(F.transform(parts, F.length)).cast("long").alias("longest"))


_COMMENT_SQL = r"""^((?:[^!''"]|''[^'']*''|"[^"]*")*)!"""


@query(
    "q02_comment_columns",
    f"""SELECT CAST(length(regexp_extract(line, '{_COMMENT_SQL}', 1)) AS BIGINT) AS start, count(*) AS n FROM
    (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, '!') AND regexp_matches(line, '{_COMMENT_SQL}') GROUP BY 1""",
)
def q02(spark, d):
    line = table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return line.select(captures.comment_start(F.col("line")).cast("long").alias("start")).where("start is not null").groupBy("start").agg(F.count("*").alias("n"))


@query(
    "q03_captures",
    """SELECT page_id, CAST(len(m) AS BIGINT) AS n, md5(array_to_string(m, '|')) AS bodies
    FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS m FROM pages)""",
)
def q03(spark, d):
    m = captures.captures(F.col("html"), "<p>", "</p>")
    return table(spark, d, "pages").select("page_id", m.alias("m")).select("page_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join("m", "|").cast("binary")).alias("bodies"))


@query(
    "q04_pattern_priority",
    """WITH c AS (SELECT page_id, 0 AS rank, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS v FROM pages WHERE regexp_matches(html, '(?s)<title>.*?</title>')
      UNION ALL SELECT page_id, 1, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) FROM pages WHERE regexp_matches(html, '(?s)<h1>.*?</h1>')
      UNION ALL SELECT page_id, 2, regexp_extract(html, '(?s)<li>(.*?)</li>', 1) FROM pages WHERE regexp_matches(html, '(?s)<li>.*?</li>'))
    SELECT page_id, arg_min(v, rank) AS winner, CAST(count(DISTINCT v) - 1 AS BIGINT) AS n_conflicts FROM c GROUP BY 1""",
)
def q04(spark, d):
    tags = [("<title>", "</title>"), ("<h1>", "</h1>"), ("<li>", "</li>")]
    first = [F.struct(F.lit(i).alias("rank"), F.get(captures.captures(F.col("html"), a, b), F.lit(0)).alias("v")) for i, (a, b) in enumerate(tags)]
    rows = table(spark, d, "pages").select("page_id", F.explode(F.array(*first)).alias("c")).select("page_id", "c.rank", "c.v").where("v is not null")
    return captures.by_priority(rows, ["page_id"], "rank", "v").select("page_id", "winner", big("n_conflicts").alias("n_conflicts"))


@query(
    "q05_dead_ranges",
    """WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?s)<p>.*?</p>') AS hits, regexp_split_to_array(html, '(?s)<p>.*?</p>') AS gaps FROM pages),
    s AS (SELECT page_id, html, i, hits[i] AS hit,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a
      FROM p, range(1, 10000) AS r(i) WHERE i <= len(hits)),
    q AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:script|table)>.*?</(?:script|table)>') AS hits, regexp_split_to_array(html, '(?s)<(?:script|table)>.*?</(?:script|table)>') AS gaps FROM pages),
    dead AS (SELECT page_id, j, hits[j] AS hit,
      list_sum(list_transform(gaps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j-1], lambda x: length(x))), 0) AS a
      FROM q, range(1, 10000) AS r(j) WHERE j <= len(hits))
    SELECT p.page_id, CAST(count(s.i) AS BIGINT) AS n_live, CAST(coalesce(sum(s.a), 0) AS BIGINT) AS sum_start FROM pages p
    LEFT JOIN (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.page_id = s.page_id AND s.a < dead.a + length(dead.hit) AND dead.a < s.a + length(s.hit))) s
    ON s.page_id = p.page_id GROUP BY 1""",
)
def q05(spark, d):
    html = F.col("html")
    dead = F.array_sort(F.concat(captures.capture_spans(html, "<script>", "</script>"), captures.capture_spans(html, "<table>", "</table>")))
    live = captures.outside(captures.capture_spans(html, "<p>", "</p>"), F.col("dead"))
    out = table(spark, d, "pages").withColumn("dead", dead).select("page_id", live.alias("live"))
    return out.select("page_id", F.size("live").cast("long").alias("n_live"), F.aggregate("live", F.lit(0).cast("long"), lambda a, x: a + x["start"]).alias("sum_start"))


# ---- the catalogue

OTHER_NAMES = sorted({n for row in DERIVED for n in row[5].split()} - {row[0] for row in DERIVED})
_VALUES = ", ".join(f"('{n}', '{dim}', {float(__import__('fractions').Fraction(f))!r}, {float(o)!r})" for n, dim, f, o, _, _ in DERIVED)
_SLOT = lambda s: f"coalesce(list_sum(list_transform(list_filter(string_split(dim, '*'), lambda x: string_split(x, '^')[1] = '{s}'), lambda x: coalesce(TRY_CAST(string_split(x, '^')[2] AS BIGINT), 1))), 0)"
_CAT = f"(SELECT unit, factor, off, [{', '.join(map(_SLOT, ('M', 'L', 'T', 'Theta', 'I', 'N', 'J')))}] AS v FROM (VALUES {_VALUES}) AS c(unit, dim, factor, off))"


@query("q06_catalogue", f"SELECT unit, array_to_string(v, ',') AS dims, CAST(factor AS DOUBLE) AS factor_value, CAST(off AS DOUBLE) AS offset_value FROM {_CAT}")
def q06(spark, d):
    names = [r[0] for r in DERIVED]
    c = catalog.catalog_frame(spark).where(F.col("unit").isin(*names))
    return c.select("unit", F.array_join(F.col("dim").cast("array<string>"), ",").alias("dims"), "factor_value", "offset_value")


@query(
    "q07_normalised_by_dimension",
    f"""SELECT dims, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2)) * factor_i) AS DOUBLE) AS total FROM
    (SELECT l_returnflag, l_quantity, CASE l_linenumber % 4 WHEN 0 THEN 't' WHEN 1 THEN 'ha' WHEN 2 THEN 'min' ELSE 'bar' END AS unit FROM lineitem) l
    JOIN (SELECT unit, array_to_string(v, ',') AS dims, CAST(factor AS BIGINT) AS factor_i FROM {_CAT} WHERE factor >= 1) c USING (unit) GROUP BY 1, 2""",
)
def q07(spark, d):
    claim = F.element_at(F.array(*map(F.lit, ("t", "ha", "min", "bar"))), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", claim.alias("claim"))
    rows = catalog.resolve(rows, "claim", catalog.catalog_frame(spark))
    dims = F.array_join(F.col("dim").cast("array<string>"), ",").alias("dims")
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)") * F.col("factor_value").cast("long")).cast("double").alias("total")
    return rows.groupBy(dims, "l_returnflag").agg(F.count("*").alias("n"), total)


@query(
    "q08_scale_pairs",
    f"""WITH l AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'Pa' WHEN 1 THEN 'hPa' ELSE 'min' END AS unit FROM lineitem),
    u AS (SELECT DISTINCT l_orderkey, l.unit, array_to_string(v, ',') AS dims, factor FROM l JOIN {_CAT} c USING (unit))
    SELECT a.unit AS unit_a, b.unit AS unit_b, a.factor / b.factor AS ratio, count(*) AS n FROM u a JOIN u b
    ON a.l_orderkey = b.l_orderkey AND a.dims = b.dims AND a.unit < b.unit AND a.factor <> b.factor GROUP BY 1, 2, 3""",
)
def q08(spark, d):
    claim = F.element_at(F.array(*map(F.lit, ("Pa", "hPa", "min"))), F.col("l_linenumber") % 3 + 1)
    rows = table(spark, d, "lineitem").select("l_orderkey", claim.alias("claim"))
    return catalog.scale_pairs(rows, "l_orderkey", "claim", catalog.catalog_frame(spark))


_EVENT_UNIT = "CASE CAST(e.user_id % 3 AS INT) WHEN 0 THEN 'N' WHEN 1 THEN 'J' ELSE 'W' END"
_EXPECTED = "CASE e.event_type WHEN 'click' THEN 'J' WHEN 'view' THEN 'W' WHEN 'purchase' THEN 'N' ELSE 'Hz' END"


@query(
    "q09_dimension_faults",
    f"""SELECT e.event_type, {_EVENT_UNIT} AS claim, {_EXPECTED} AS expected, 'H001' AS code, count(*) AS n FROM events e
    JOIN {_CAT} a ON a.unit = {_EVENT_UNIT} JOIN {_CAT} b ON b.unit = {_EXPECTED} WHERE a.v <> b.v GROUP BY 1, 2, 3""",
)
def q09(spark, d):
    claim = F.element_at(F.array(*map(F.lit, "NJW")), (F.col("user_id") % 3 + 1).cast("int"))
    want = F.when(F.col("event_type") == "click", "J").when(F.col("event_type") == "view", "W").when(F.col("event_type") == "purchase", "N").otherwise("Hz")
    rows = table(spark, d, "events").select("event_type", claim.alias("claim"), want.alias("expected"))
    faults = catalog.dimension_faults(rows, "claim", "expected", catalog.catalog_frame(spark))
    return faults.groupBy("event_type", "claim", "expected").agg(F.first("code").alias("code"), F.count("*").alias("n"))


@query(
    "q10_verdicts",
    f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.v <> b.v THEN 'dim_mismatch' WHEN a.factor <> b.factor THEN 'scale_mismatch' WHEN a.off <> b.off THEN 'offset_mismatch' ELSE 'equal' END AS kind
    FROM events e JOIN {_CAT} a ON a.unit = CASE CAST(e.user_id % 3 AS INT) WHEN 0 THEN 'degC' WHEN 1 THEN 'bar' ELSE 'hPa' END
    JOIN {_CAT} b ON b.unit = CASE e.event_type WHEN 'click' THEN 'degC' WHEN 'view' THEN 'hPa' WHEN 'purchase' THEN 'lm' ELSE 'bar' END) GROUP BY 1""",
)
def q10(spark, d):
    c = catalog.catalog_frame(spark)
    claim = F.element_at(F.array(*map(F.lit, ("degC", "bar", "hPa"))), (F.col("user_id") % 3 + 1).cast("int"))
    kind = F.col("event_type")
    want = F.when(kind == "click", "degC").when(kind == "view", "hPa").when(kind == "purchase", "lm").otherwise("bar")
    rows = table(spark, d, "events").select(claim.alias("claim"), want.alias("expected"))
    rows = catalog.resolve(catalog.resolve(rows, "claim", c, "a_"), "expected", c, "b_")
    v = catalog.verdict(*[F.col(x) for x in ("a_dim", "a_factor_value", "a_offset_value", "b_dim", "b_factor_value", "b_offset_value")])
    return rows.groupBy(v.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "q11_affine_law",
    f"""SELECT CASE WHEN e.a = s.factor / t.factor AND e.b = (s.off - t.off) / t.factor THEN 'holds' ELSE 'S003' END AS verdict, count(*) AS n
    FROM (SELECT CAST(user_id % 4 + 1 AS DOUBLE) AS a, CASE WHEN event_type = 'click' THEN 273.15::DOUBLE ELSE 0.0 END AS b, CASE WHEN user_id % 5 = 0 THEN 'hPa' ELSE 'degC' END AS src,
      CASE WHEN user_id % 5 = 0 THEN 'Pa' ELSE 'K' END AS tgt FROM events) e
    JOIN (SELECT unit, factor, off FROM {_CAT}) s ON s.unit = e.src
    JOIN (SELECT unit, factor, off FROM {_CAT} UNION ALL VALUES ('K', 1.0, 0.0)) t ON t.unit = e.tgt GROUP BY 1""",
)
def q11(spark, d):
    # a stated conversion is a slope and a shift; from degC to K these are 1 and 273.15, from hPa to Pa 100 and 0
    slope, shift = (F.col("user_id") % 4 + 1).cast("double"), F.when(F.col("event_type") == "click", 273.15).otherwise(0.0)
    pressure = F.col("user_id") % 5 == 0
    rows = table(spark, d, "events").select(slope.alias("a"), shift.alias("b"), F.when(pressure, "hPa").otherwise("degC").alias("src"), F.when(pressure, "Pa").otherwise("K").alias("tgt"))
    c = catalog.catalog_frame(spark)
    rows = catalog.resolve(catalog.resolve(rows, "src", c, "s_"), "tgt", c, "t_")
    stated = [F.col(x) for x in ("a", "b", "s_factor_value", "s_offset_value", "t_factor_value", "t_offset_value")]
    return rows.groupBy(catalog.conversion_verdict(*stated).alias("verdict")).agg(F.count("*").alias("n"))


# ---- claims, tiers, summaries


@query(
    "q12_first_claim_conflicts",
    """SELECT user_id, count(*) FILTER (event_type <> ref) AS n_conflicts, min(ref) AS reference FROM
    (SELECT user_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref FROM events) GROUP BY 1""",
)
def q12(spark, d):
    # the first claim comes by a grouped minimum and a join, so no user's events have to be sorted in one task
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    first = merge.first_wins(e, ["user_id"], ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "reference")
    return e.join(first, "user_id").groupBy("user_id").agg(F.count_if(F.col("event_type") != F.col("reference")).alias("n_conflicts"), F.min("reference").alias("reference"))


_SPAN = "SELECT d.doc_id, d.source, CAST(d.n_chars % 17 AS BIGINT) AS a, CAST(d.n_chars % 17 + d.doc_id % 5 AS BIGINT) AS b, CASE WHEN l.toxic = 1 THEN 3 WHEN l.quality = 0 THEN 2 WHEN l.quality IS NULL THEN 1 ELSE 0 END AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _spans(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    tier = F.when(F.col("toxic") == 1, "red").when(F.col("quality") == 0, "yellow").when(F.col("quality").isNull(), "blue").otherwise("green")
    return j.select("doc_id", "source", (F.col("n_chars") % 17).alias("start"), (F.col("n_chars") % 17 + F.col("doc_id") % 5).alias("end"), tier.alias("tier"))


@query(
    "q13_worst_tier_by_line",
    f"SELECT source, line, ['green', 'blue', 'yellow', 'red'][max(r) + 1] AS tier FROM (SELECT source, r, unnest(range(a, b + 1)) AS line FROM ({_SPAN})) GROUP BY 1, 2",
)
def q13(spark, d):
    return coverage.worst_by_line(_spans(spark, d), ["source"])


@query(
    "q14_coverage",
    f"""SELECT source, count(*) FILTER (r = 0) AS ok, count(*) FILTER (r = 2) AS warn, count(*) FILTER (r = 3) AS fire, count(*) FILTER (r = 1) AS unparsed,
    CASE WHEN count(*) FILTER (r <> 1) = 0 THEN 0.0 ELSE round_even(count(*) FILTER (r = 0) / count(*) FILTER (r <> 1) * 100, 1) END AS pct
    FROM ({_SPAN}) GROUP BY GROUPING SETS ((source), ())""",
)
def q14(spark, d):
    return coverage.figures(_spans(spark, d), ["source"])


@query(
    "q15_summary",
    """SELECT user_id, count(*) FILTER (event_type IN ('error', 'purchase')) AS n_h, count(*) FILTER (event_type IN ('view', 'click')) AS n_u FROM events GROUP BY 1""",
)
def q15(spark, d):
    code = F.when(F.col("event_type").isin("error", "purchase"), "H001").when(F.col("event_type").isin("view", "click"), "U005").otherwise("S001")
    rows = table(spark, d, "events").select("user_id", code.alias("code"))
    return coverage.code_counts(rows, ["user_id"])


# ---- imports

_EDGES = "SELECT doc_id AS a, doc_id // 2 AS b FROM documents WHERE doc_id > 0"


@query(
    "q16_closure",
    f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT a, b, 1 AS depth FROM e UNION ALL SELECT r.a, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.b) SELECT a, b, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE a <> b GROUP BY 1, 2",
)
def q16(spark, d):
    edges = table(spark, d, "documents").where("doc_id > 0").select(F.col("doc_id").alias("a"), F.expr("doc_id div 2").alias("b"))
    return imports.closure(edges, keeper(spark)).select("a", "b", big("depth").alias("depth"))


@query(
    "q17_levels",
    f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS level UNION ALL SELECT e.a, r.level + 1 FROM r JOIN e ON e.b = r.node) SELECT node, CAST(max(level) AS BIGINT) AS level FROM r GROUP BY 1",
)
def q17(spark, d):
    docs = table(spark, d, "documents")
    edges = docs.where("doc_id > 0").select(F.col("doc_id").alias("a"), F.expr("doc_id div 2").alias("b"))
    return imports.levels(edges, docs.select(F.col("doc_id").alias("node")), keeper(spark)).select("node", big("level").alias("level"))


@query(
    "q18_unresolved",
    """SELECT o_custkey AS module, count(*) AS n FROM orders o WHERE o_custkey % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0) GROUP BY 1""",
)
def q18(spark, d):
    uses = table(spark, d, "orders").where("o_custkey % 10 <> 0").select(F.col("o_orderkey").alias("importer"), F.col("o_custkey").alias("module"), F.lit("x").alias("local"), F.lit("x").alias("remote"))
    exports = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("module"), F.lit("x").alias("name"))
    return imports.resolve(uses, exports)[1].groupBy("module").agg(F.count("*").alias("n"))


@query(
    "q19_used_unannotated",
    "SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1",
)
def q19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return attach.unannotated(docs, table(spark, d, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "q20_first_wins",
    "SELECT o_custkey, o_orderpriority AS unit, o_orderkey AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def q20(spark, d):
    rows = table(spark, d, "orders").withColumn("first_key", F.col("o_orderkey")).withColumnRenamed("o_orderpriority", "unit")
    return merge.first_wins(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["unit", "first_key"])


@query(
    "q21_local_over_import",
    """WITH l AS (SELECT DISTINCT c_nationkey AS scope, c_custkey % 50 AS name FROM customer), i AS (SELECT DISTINCT s_nationkey AS scope, s_suppkey % 50 AS name FROM supplier)
    SELECT scope, name, 'local' AS origin FROM l UNION ALL SELECT scope, name, 'import' FROM i WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.scope = i.scope AND l.name = i.name)""",
)
def q21(spark, d):
    local = table(spark, d, "customer").select(F.col("c_nationkey").alias("scope"), (F.col("c_custkey") % 50).alias("name")).distinct().withColumn("origin", F.lit("local"))
    got = table(spark, d, "supplier").select(F.col("s_nationkey").alias("scope"), (F.col("s_suppkey") % 50).alias("name")).distinct().withColumn("origin", F.lit("import"))
    return imports.with_locals(local, got, ["scope", "name"])


@query(
    "q22_two_claims",
    """SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS kept, count(DISTINCT l_returnflag) AS n_claims FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""",
)
def q22(spark, d):
    # some lines are there twice; of these the SQL takes the one that the table has first
    at = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "row_index")]
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", *at)
    return merge.disputed(rows, ["l_partkey"], "l_returnflag", ["l_orderkey", "l_linenumber", "_file_path", "_row_index"])


@query(
    "q23_interval_attach",
    """WITH r AS (SELECT user_id % 8 AS path, event_id // 500 AS name, min(event_id) AS a, max(event_id) + 1 + event_id // 500 % 3 * 400 AS b FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
    p AS (SELECT user_id % 8 AS path, event_id AS pos FROM events WHERE event_type = 'error')
    SELECT path, pos, (SELECT arg_min(r.name, (r.b - r.a) * 1000000 + r.a) FROM r WHERE r.path = p.path AND r.a <= p.pos AND p.pos < r.b) AS name FROM p""",
)
def q23(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("path"), "event_id", "event_type", F.expr("event_id div 500").alias("name"))
    ranges = e.where("event_type = 'signup'").groupBy("path", "name").agg(F.min("event_id").alias("start"), F.max("event_id").alias("last"))
    ranges = ranges.select("path", "name", "start", (F.col("last") + 1 + F.col("name") % 3 * 400).alias("end"))
    points = e.where("event_type = 'error'").select("path", F.col("event_id").alias("pos"))
    return attach.innermost(points, ranges, ["path"], "pos", "name")


@query(
    "q24_cache_hits",
    "SELECT source, count(*) AS n, count(*) FILTER (rn > 1) AS n_hits FROM (SELECT source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) GROUP BY 1",
)
def q24(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    # the cache holds what the first document of each content gave
    kept = merge.first_wins(keyed.withColumn("first", F.col("doc_id")), ["key"], ["doc_id"], ["first"])
    hits, _ = cache.split_by_cache(keyed, kept)
    return hits.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") > F.col("first")).alias("n_hits"))


@query(
    "q25_dirty_dependents",
    """SELECT d.doc_id, CASE WHEN m.doc_id IS NULL THEN 'absent' ELSE 'changed' END AS reason FROM documents d LEFT JOIN documents m ON m.doc_id = d.doc_id // 2 + 3
    WHERE m.doc_id IS NULL OR m.n_chars % 7 = 0""",
)
def q25(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    module = F.expr("doc_id div 2 + 3").alias("module")
    # a module's stored digest is its length, its present one differs for each seventh
    was = docs.select(F.col("doc_id").alias("module"), F.col("n_chars").cast("string").alias("digest"))
    stored = docs.select(F.col("doc_id").alias("dependent"), module).join(was, "module", "left")
    now = docs.select(F.col("doc_id").alias("module"), (F.col("n_chars") + F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0)).cast("string").alias("digest"))
    return cache.dirty(stored, now).select(F.col("dependent").alias("doc_id"), "reason")


@query(
    "q26_severities",
    """SELECT severity, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'hint' WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'info' ELSE 'warning' END WHEN 'signup' THEN 'warning' END AS severity FROM events)
    WHERE severity IS NOT NULL GROUP BY 1""",
)
def q26(spark, d):
    code = F.when(F.col("event_type") == "click", "H001").when(F.col("event_type") == "view", "U005").when(F.col("event_type") == "purchase", "H010").when(F.col("event_type") == "error", "U020").otherwise("S001")
    rule = F.when(F.col("user_id") % 2 == 0, "D1.5").otherwise("D1.6")
    default = F.when(F.col("event_type") == "click", "error").otherwise("warning")
    rows = table(spark, d, "events").select(code.alias("code"), F.when(code == "H010", rule).alias("rule"), default.alias("severity"))
    rules = spark.createDataFrame([("U005", "hint"), ("D1.5", "info"), ("U020", "off")], "marker string, severity string")
    return merge.overridden(rows, rules).groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "q27_capped",
    """SELECT doc_id, pinned FROM (SELECT doc_id, n_chars % 50 = 0 AS pinned, row_number() OVER (ORDER BY (n_chars % 50 = 0) DESC, doc_id DESC) AS rn FROM documents)
    WHERE rn <= greatest(40, (SELECT count(*) FROM documents WHERE n_chars % 50 = 0))""",
)
def q27(spark, d):
    return merge.capped(table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 50 == 0).alias("pinned")), "pinned", "doc_id", 40)


@query(
    "q28_definitions",
    """WITH s AS (SELECT lower(c_mktsegment) AS name, c_nationkey AS path, c_custkey AS line FROM customer)
    SELECT n.n_name AS asked, s.name, s.line FROM nation n JOIN s ON s.path = n.n_nationkey WHERE s.name LIKE 'b%' AND EXISTS (SELECT 1 FROM supplier v WHERE v.s_nationkey = s.path AND v.s_acctbal > 5000)""",
)
def q28(spark, d):
    sites = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("path"), F.col("c_custkey").alias("line"))
    visible = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("path"))
    asked = table(spark, d, "nation").select(F.col("n_name").alias("asked"), F.col("n_nationkey").alias("path"))
    found = lookup.in_reach(sites, F.when(F.lower("name").startswith("b"), F.lower("name")), visible)
    return found.join(asked, "path").select("asked", F.lower("name").alias("name"), "line")


@query(
    "q29_superscripts",
    """SELECT p_size, CASE p_size - 25 WHEN 0 THEN '1' WHEN 1 THEN 'm' ELSE 'm' || translate(CAST(p_size - 25 AS VARCHAR), '0123456789-', '⁰¹²³⁴⁵⁶⁷⁸⁹⁻') END AS shown, count(*) AS n FROM part GROUP BY 1, 2""",
)
def q29(spark, d):
    sizes = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).withColumn("text", F.concat(F.lit("m^("), F.col("p_size") - 25, F.lit(")")))
    return with_parsed(sizes, "text").select("p_size", F.col("parsed.shown").alias("shown"), "n")


@query(
    "q34_latest_version",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
)
def q34(spark, d):
    return merge.latest(table(spark, d, "events"), ["user_id"], "event_id", ["event_type"])


@query(
    "q36_debounced",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM s GROUP BY user_id, session""",
)
def q36(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("version"), "ts", F.col("event_type").alias("text"))
    # a session window holds an event that comes right at its end apart, the query's doesn't
    return edits.debounced(e, "6 hours 1 microsecond").select(F.col("uri").alias("user_id"), F.col("version").alias("event_id"), F.col("n_edits").alias("n"))


@query(
    "q51_throttled",
    """WITH w AS (SELECT user_id, date_trunc('day', ts) AS day, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1, 2)
    SELECT user_id, 'leading' AS edge, a AS event_id FROM w UNION ALL SELECT user_id, 'trailing', b FROM w WHERE a < b""",
)
def q51(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("version"), "ts", F.col("event_type").alias("text"))
    return edits.throttled(e, "1 day").select(F.col("uri").alias("user_id"), "edge", F.col("version").alias("event_id"))


@query(
    "q37_products",
    f"""SELECT a.unit AS a, b.unit AS b, array_to_string(list_transform(range(1, 8), lambda i: a.v[i] + b.v[i]), ',') AS product,
    array_to_string(list_transform(range(1, 8), lambda i: a.v[i] - b.v[i]), ',') AS quotient FROM {_CAT} a, {_CAT} b WHERE a.unit < 'H' AND b.unit > 'm'""",
)
def q37(spark, d):
    c = catalog.catalog_frame(spark).where(F.col("unit").isin(*[r[0] for r in DERIVED]))
    a = c.where("unit < 'H'").select(F.col("unit").alias("a"), F.col("dim").alias("x"))
    b = c.where("unit > 'm'").select(F.col("unit").alias("b"), F.col("dim").alias("y"))
    text = lambda dim: F.array_join(dim.cast("array<string>"), ",")
    # two catalogues, some forty rows each
    return a.crossJoin(F.broadcast(b)).select("a", "b", text(catalog.product(F.col("x"), F.col("y"))).alias("product"), text(catalog.product(F.col("x"), F.col("y"), -1)).alias("quotient"))


@query(
    "q38_prefix_collisions",
    f"""WITH p AS (SELECT unnest([{", ".join(f"'{p}'" for p in PREFIXES)}]) AS prefix), base AS (SELECT unnest(['m', 'g', 's', 'K', 'A', 'mol', 'cd', 'kg']) AS name),
    own AS (SELECT unit AS name FROM {_CAT} UNION SELECT unnest([{", ".join(f"'{n}'" for n in OTHER_NAMES)}]) UNION SELECT name FROM base WHERE name <> 'g'),
    made AS (SELECT prefix || unit AS name FROM p, (VALUES ('a'), ('m'), ('in'), ('t')) AS n(unit)),
    known AS (SELECT name FROM own UNION SELECT prefix || name FROM p, base WHERE name <> 'kg')
    SELECT name, count(*) AS n_ways FROM (SELECT name FROM made UNION ALL SELECT name FROM known) GROUP BY 1 HAVING count(*) > 1""",
)
def q38(spark, d):
    """Names made by more than one prefix, in a catalogue where years, inches and tonnes take prefixes."""
    p = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    n = spark.createDataFrame([(n,) for n in ("a", "m", "in", "t")], "unit string")
    return catalog.collisions(p, n, catalog.catalog_frame(spark).select(F.col("unit").alias("name")))


@query(
    "q39_module_digests",
    """SELECT c_nationkey AS module, sha256(count(*) || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) || ':' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT)) AS digest
    FROM (SELECT c_nationkey, sha256(c_custkey || ':' || c_mktsegment) AS h FROM customer) GROUP BY 1""",
)
def q39(spark, d):
    item = F.concat_ws(":", "c_custkey", "c_mktsegment")
    return cache.digests(table(spark, d, "customer").withColumnRenamed("c_nationkey", "module"), ["module"], item)


@query(
    "q40_cache_prune",
    """SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC) AS held FROM documents) WHERE held <= 500000""",
)
def q40(spark, d):
    """Newest first as long as the size limit holds; the running sum goes by ranges of ids, so that no task sees all rows."""
    return cache.prune(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 500_000).select("doc_id")


@query(
    "q41_pre_blocks",
    """WITH days AS (SELECT DISTINCT user_id AS path, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS line FROM events)
    SELECT path, line, max(line) OVER (PARTITION BY path, line - rn) AS block_end FROM (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS rn FROM days)""",
)
def q41(spark, d):
    """Runs of days in a row on which a user was seen."""
    day = F.datediff(F.col("ts"), F.lit("2000-01-01").cast("date")).cast("long")
    rows = table(spark, d, "events").select(F.col("user_id").alias("path"), day.alias("line")).distinct()
    return captures.islands(rows, ["path"], "line")


@query(
    "q45_shared_keys",
    """SELECT 'both' AS side, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT side, count(*) FROM (SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 'right', doc_id FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)) GROUP BY 1""",
)
def q45(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    both = merge.in_both(docs, labels, ["doc_id"]).select(F.lit("both").alias("side")).groupBy("side").agg(F.count("*").alias("n"))
    return both.unionByName(merge.in_one(docs, labels, ["doc_id"]).groupBy("side").agg(F.count("*").alias("n")))


@query(
    "q46_reach",
    f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT doc_id AS node FROM documents WHERE doc_id % 97 = 5 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r",
)
def q46(spark, d):
    """All that the start nodes (each ninety-seventh) reach; which nodes they are is the question, no row is left out."""
    docs = table(spark, d, "documents").select("doc_id")
    edges = docs.where("doc_id > 0").select(F.col("doc_id").alias("a"), F.expr("doc_id div 2").alias("b"))
    return imports.reachable(edges, docs.where("doc_id % 97 = 5").select(F.col("doc_id").alias("node")), keeper(spark))


@query(
    "q47_load_order",
    f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS level UNION ALL SELECT e.a, r.level + 1 FROM r JOIN e ON e.b = r.node),
    l AS (SELECT node, CAST(max(level) AS BIGINT) AS level FROM r GROUP BY 1) SELECT node, level, row_number() OVER (ORDER BY level, node) AS place FROM l""",
)
def q47(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    edges = docs.where("doc_id > 0").select(F.col("doc_id").alias("a"), F.expr("doc_id div 2").alias("b"))
    return imports.load_order(edges, docs.select(F.col("doc_id").alias("node")), keeper(spark)).select("node", big("level").alias("level"), big("place").alias("place"))


@query(
    "q48_passed_on",
    """WITH RECURSIVE m AS (SELECT o_orderkey AS module, o_orderkey // 2 AS up, o_orderkey % 3 = 0 AS closed, 'n' || (o_orderkey % 7) AS name, 'u' || (o_orderkey % 5) AS unit FROM orders),
    s AS (SELECT module, name, unit, module AS origin FROM m WHERE NOT closed
      UNION ALL SELECT m.module, s.name, s.unit, s.origin FROM s JOIN m ON m.up = s.module AND m.module <> m.up WHERE NOT m.closed AND m.name <> s.name),
    f AS (SELECT module, name, unit, origin, row_number() OVER (PARTITION BY module, name ORDER BY origin DESC) AS rn FROM s)
    SELECT module, name, unit, origin FROM f WHERE rn = 1""",
)
def q48(spark, d):
    """Order k is a module that uses order k div 2 and declares one name; each third offers nothing. The nearest module that
    offers a name is the one it comes from."""
    o = table(spark, d, "orders").select("o_orderkey")
    local = o.select(F.col("o_orderkey").alias("module"), F.concat(F.lit("n"), F.col("o_orderkey") % 7).alias("name"), F.concat(F.lit("u"), F.col("o_orderkey") % 5).alias("unit"))
    none = F.lit(None).cast("string")
    uses = o.select(F.col("o_orderkey").alias("importer"), F.expr("o_orderkey div 2").alias("module"), F.lit("all").alias("type"), none.alias("local"), none.alias("remote"), F.lit(1).alias("line"))
    closed = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("module"), none.alias("name"), F.lit("hidden").alias("type"))
    return imports.surfaces(local, uses.where("importer <> module"), closed, keeper(spark))
