"""Queries of the unit texts, the algebra and the checker, over values and sources made of the tables, with the SQL that gives
the same rows by other ways: expected values by rule, tables of the rules' outcomes, counts of what a source was made to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import combine_units, with_parsed
from ..operators.catalog import catalog_frame
from ..units.catalog import DERIVED, PREFIXES
from . import check as checking
from .driver import _CAT, big, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def values(rows: list[tuple], names: str) -> str:
    """Rows as SQL."""
    shown = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names}))"


#: Spellings that aren't read as they stand, and what each was meant to be.
MISSPELT = (
    ("kPa", None), ("kg m-3", "kg*m^-3"), ("m²", "m^2"), ("m**2", "m^2"), ("J.kg^-1", "J*kg^-1"), ("Pa^{2/3}", "Pa^(2/3)"), ("kg·m", "kg*m"), ("mol(C)", None), ("2", None), ("", None), ("kg*m", None),
)


@query(
    f"""SELECT p_partkey, s.text, s.text <> 'kg*m' AS wrong, s.suggestion FROM part JOIN {values([(i, *r) for i, r in enumerate(MISSPELT)], "i, text, suggestion")} s ON s.i = p_partkey % {len(MISSPELT)}"""
)
def q30_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(t) for t, _ in MISSPELT]), (F.col("p_partkey") % len(MISSPELT) + 1).cast("int"))
    parts = with_parsed(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text")
    return parts.select("p_partkey", "text", F.col("parsed.error").isNotNull().alias("wrong"), F.col("parsed.suggestion").alias("suggestion"))


_EXPONENTS = "SELECT p_partkey, p_partkey % 5 - 2 AS a, p_partkey // 5 % 7 - 3 AS b, p_size % 4 AS c, ['', 'k', 'm', 'M'][p_size % 4 + 1] AS prefix, [0, 3, -3, 6][p_size % 4 + 1] AS ten FROM part"


@query(
    f"""SELECT p_partkey, a || ',' || b || ',' || -c || ',0,0,0,0' AS dims, CASE WHEN ten * b < 0 THEN '1/1' || repeat('0', CAST(-ten * b AS INT)) ELSE '1' || repeat('0', CAST(ten * b AS INT)) END AS factor,
    CAST(0 AS BIGINT) AS n_variables FROM ({_EXPONENTS})"""
)
def q31_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts such as ``kg^2*km^(-3)/s^1`` for all parts; each distinct one is read once."""
    a, b, c = F.col("p_partkey") % 5 - 2, F.expr("p_partkey div 5") % 7 - 3, F.col("p_size") % 4
    prefix = F.element_at(F.array(*map(F.lit, ("", "k", "m", "M"))), (c + 1).cast("int"))
    text = F.concat(F.lit("kg^("), a, F.lit(")*"), prefix, F.lit("m^("), b, F.lit(")/s^"), c)
    parts = with_parsed(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text")
    return parts.select("p_partkey", F.array_join("parsed.dims", ",").alias("dims"), F.col("parsed.factor").alias("factor"), F.size("parsed.variables").cast("long").alias("n_variables"))


#: Units by what they are (U with a dimension, D without, L and E wrapped) and what their dimension, or that of
#: what they wrap, is called here.
OPERANDS = (
    ("1", "D", ""), ("Pa", "U", "p"), ("K", "U", "t"), ("m/s", "U", "v"), ("LOG(Pa)", "L", "p"), ("LOG(K)", "L", "t"), ("EXP(K)", "E", "t"), ("EXP(m)", "E", "l"), ("degC", "U", "t"), ("hPa", "U", "p"),
)
#: The algebra's outcomes, operand kinds and operators first, then what results, the fault, the rule. ``=`` and
#: ``!``: only for equal, only for different dimensions.
OUTCOMES = """
UU +- = U . R4.1    UU +- ! . D1.1 R4.1    UD +- * . D1.1 R4.1    DU +- * . D1.1 R4.1    DD +- * D . R4.1
UU * * U . R4.2     UU / = D . R4.2        UU / ! U . R4.2        UD */ * U . R4.2       DU */ * U . R4.2      DD */ * D . R4.2
LL + * L . R5.1     LL - = D . R5.2        LL - ! L . R5.2        LL */ * . D1.2 R5.6
LD +- * L . R5.3    DL +- * L . R5.3       LU +- * . D1.3 R5.10   UL +- * . D1.3 R5.10
LD */ * . D1.4 R5.5 DL * * . D1.4 R5.5     LU */ * . D1.2 R5.7    UL * * . D1.2 R5.7     UL / * . D1.2 R5.9    DL / * . D1.2 R5.9
EE * = E . R6.1     EE * ! . D1.1 R6.1     EE / = E . R6.2        EE / ! . D1.1 R6.2     EE +- * . D1.3 R6.5
ED */ * E . R6.3    DE */ * E . R6.3       EU */ * . D1.2 R6.7    UE */ * . D1.2 R6.7
EU +- * . D1.3 R6.6 UE +- * . D1.3 R6.6    ED +- * . D1.3 R6.6    DE +- * . D1.3 R6.6
LE */ * . D1.2 R7.1 EL */ * . D1.2 R7.1    LE +- * . D1.3 R6.6    EL +- * . D1.3 R6.6
UD ^ * U . R4.3     DD ^ * D . R4.3        LD ^ * . D1.2 R5.9     ED ^ * E . R6.4
UU ^ * . D1.7 R4.3  DU ^ * . D1.7 R4.3     LU ^ * . D1.7 R4.3     EU ^ * . D1.7 R4.3
UL ^ * . D1.7 R4.3  DL ^ * . D1.7 R4.3     LL ^ * . D1.7 R4.3     EL ^ * . D1.7 R4.3
UE ^ * . D1.7 R4.3  DE ^ * . D1.7 R4.3     LE ^ * . D1.7 R4.3     EE ^ * . D1.7 R4.3
"""
_CELLS = [OUTCOMES.split()[i : i + 6] for i in range(0, len(OUTCOMES.split()), 6)]
_MATRIX = values([(k[0], k[1], "**" if op == "^" else op, same, *(None if x == "." else x for x in (kind, fault)), rule) for k, ops, same, kind, fault, rule in _CELLS for op in ops], "ka, kb, op, same, kind, fault, rule")
_OPERANDS = values(list(OPERANDS), "unit, kind, dim")


@query(
    f"""SELECT m.op, a.unit AS a, b.unit AS b, m.kind, m.fault, m.rule FROM {_OPERANDS} a, {_OPERANDS} b, {_MATRIX} m
    WHERE m.ka = a.kind AND m.kb = b.kind AND (m.same = '*' OR (m.same = '=') = (a.dim = b.dim))"""
)
def q32_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator on every pair of operand kinds: what kind of unit results, the fault, the rule."""
    units = [u for u, _, _ in OPERANDS]
    u = spark.createDataFrame([(a, b, op) for a in units for b in units for op in ("+", "-", "*", "/", "**")], "a string, b string, op string")
    none = F.lit(None).cast("double")
    got = u.withColumn("got", combine_units("op", "a", "b", none, F.when(F.col("op") == "**", 2.0)))
    unit = F.col("got.unit")
    kind = F.when(unit == "1", "D").when(unit.startswith("LOG"), "L").when(unit.startswith("EXP"), "E").when(unit.isNotNull(), "U")
    return got.select("op", "a", "b", kind.alias("kind"), "got.fault", "got.rule")


#: Products of the claimed units, with the fault where there is none.
PRODUCTS = (
    ("kg", "m", "kg*m", None), ("kg", "K", "kg*K", None), ("kg", "1", "kg", None), ("kg", "EXP(K)", None, "D1.2"),
    ("hPa", "m", "kg/s^2", None), ("hPa", "K", "kg*K/(m*s^2)", None), ("hPa", "1", "kg/(m*s^2)", None), ("hPa", "EXP(K)", None, "D1.2"),
    ("LOG(Pa)", "m", None, "D1.2"), ("LOG(Pa)", "K", None, "D1.2"), ("LOG(Pa)", "1", None, "D1.4"), ("LOG(Pa)", "EXP(K)", None, "D1.2"),
    ("degC", "m", "m*K", None), ("degC", "K", "K^2", None), ("degC", "1", "K", None), ("degC", "EXP(K)", None, "D1.2"),
    ("m/s", "m", "m^2/s", None), ("m/s", "K", "m*K/s", None), ("m/s", "1", "m/s", None), ("m/s", "EXP(K)", None, "D1.2"),
)


@query(
    f"""SELECT p.a, p.b, count(*) AS n, any_value(p.unit) AS unit, any_value(p.fault) AS fault FROM lineitem
    JOIN {values(list(PRODUCTS), "a, b, unit, fault")} p ON p.a = ['kg', 'hPa', 'LOG(Pa)', 'degC', 'm/s'][l_linenumber % 5 + 1] AND p.b = ['m', 'K', '1', 'EXP(K)'][l_suppkey % 4 + 1] GROUP BY 1, 2"""
)
def q33_claimed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of line items' quantity times price over their claimed units, each pair typed once."""
    claim = F.element_at(F.array(*map(F.lit, ("kg", "hPa", "LOG(Pa)", "degC", "m/s"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, ("m", "K", "1", "EXP(K)"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    pairs = table(spark, sf_dir, "lineitem").groupBy(claim.alias("a"), other.alias("b")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    return pairs.withColumn("got", combine_units(F.lit("*"), "a", "b", none, none)).select("a", "b", "n", "got.unit", "got.fault")


# ---- programs made of the tables: a module for each region and nation, a program for each customer

#: Units by a number's remainder: of a nation's own variable, and of the one that it passes on from its region.
OWN, PASSED = ("m", "kg", "s"), ("Pa", "K")


def _pick(units: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, units)), (number % len(units) + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text). A customer's program gets ``g`` from its nation's module and ``h`` through it from the region's."""
    end = "end module\n"
    region = table(spark, sf_dir, "region").select(
        F.format_string("region%03d.f90", "r_regionkey").alias("path"),
        F.concat(F.format_string("module region%d\n  real :: h  !< @unit{", "r_regionkey"), _pick(PASSED, F.col("r_regionkey")), F.lit("}\n" + end)).alias("text"),
    )
    nation = table(spark, sf_dir, "nation").select(
        F.format_string("nation%03d.f90", "n_nationkey").alias("path"),
        F.concat(F.format_string("module nation%d\n  use region%d\n  real :: g  !< @unit{", "n_nationkey", "n_regionkey"), _pick(OWN, F.col("n_nationkey")), F.lit("}\n" + end)).alias("text"),
    )
    head = F.format_string("program customer%d\n  use nation%d\n", "c_custkey", "c_nationkey")
    own = F.concat(F.lit("  real :: x  !< @unit{"), _pick(OWN, F.col("c_custkey")), F.lit("}\n  real :: y  !< @unit{"), _pick(PASSED, F.col("c_custkey")), F.lit("}\n  real :: bare\n"))
    customer = table(spark, sf_dir, "customer").select(
        F.format_string("customer%09d.f90", "c_custkey").alias("path"), F.concat(head, own, F.lit("  x = g\n  y = h\n  bare = x\nend program\n")).alias("text")
    )
    return region.unionByName(nation).unionByName(customer)


_MADE = "SELECT printf('customer%09d.f90', c_custkey) AS path, c_custkey % 3 <> c_nationkey % 3 AS x_differs, c_custkey % 2 <> n_regionkey % 2 AS y_differs, * FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query(
    f"""WITH c AS ({_MADE}) SELECT path, 5 AS line, 'U005' AS code, 'warning' AS severity FROM c UNION ALL SELECT path, 6, 'H001', 'error' FROM c WHERE x_differs
    UNION ALL SELECT path, 7, 'H001', 'error' FROM c WHERE y_differs"""
)
def q35_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = checking.check(sources(spark, sf_dir)).diagnostics
    return d.select("path", F.col("sl").alias("line"), "code", "severity")


@query(
    f"""WITH c AS ({_MADE}) SELECT path, 'x' AS name, 6 AS line, ['m', 'kg', 's'][c_nationkey % 3 + 1] AS unit, ['m', 'kg', 's'][c_custkey % 3 + 1] AS reference FROM c WHERE x_differs
    UNION ALL SELECT path, 'y', 7, ['kg/(m*s^2)', 'K'][n_regionkey % 2 + 1], ['kg/(m*s^2)', 'K'][c_custkey % 2 + 1] FROM c WHERE y_differs"""
)
def q42_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clashes = checking.conflicts(checking.check(sources(spark, sf_dir)).points)
    return clashes.select("path", "name", "line", "unit", "reference")


# of a program's ten lines two declare a unit, three assign (red where units differ, else green), one declares without a unit
@query(
    f"""WITH c AS ({_MADE}), f AS (SELECT path, CAST(x_differs AS BIGINT) + CAST(y_differs AS BIGINT) AS fire FROM c)
    SELECT path, CAST(10 AS BIGINT) AS total, 2 + 3 - fire AS ok, CAST(1 AS BIGINT) AS warn, fire FROM f"""
)
def q43_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = checking.coverage_figures(checking.check(sources(spark, sf_dir)))
    return figures.where(F.col("path").startswith("customer")).select("path", big("total").alias("total"), "ok", "warn", "fire")


_BASE = values([("kg", 1), ("m", 2), ("s", 3), ("K", 4), ("A", 5), ("mol", 6), ("cd", 7)], "unit, slot")
_ALIASES = values([(n, row[0]) for row in DERIVED for n in row[5].split()], "unit, main")
_PREFIX = "(SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, CAST('1e{e}' AS DOUBLE))" for i, (p, e) in enumerate(PREFIXES.items(), 1)) + ") AS p(prefix, rank, factor))"


@query(
    f"""WITH own AS (SELECT unit, array_to_string(v, ',') AS dims, CAST(factor AS DOUBLE) AS f, CAST(off AS DOUBLE) AS o, 0 AS rank FROM {_CAT}
      UNION ALL SELECT a.unit, array_to_string(v, ','), CAST(factor AS DOUBLE), CAST(off AS DOUBLE), 0 FROM {_ALIASES} a JOIN {_CAT} c ON c.unit = a.main
      UNION ALL SELECT unit, array_to_string(list_transform(range(1, 8), lambda i: CASE WHEN i = slot THEN 1 ELSE 0 END), ','), 1.0, 0.0, 0 FROM {_BASE}),
    made AS (SELECT prefix || unit AS unit, array_to_string(list_transform(range(1, 8), lambda i: CASE WHEN i = slot THEN 1 ELSE 0 END), ',') AS dims, p.factor AS f, 0.0 AS o, p.rank FROM {_PREFIX} p, {_BASE} b),
    named AS (SELECT * FROM own UNION ALL SELECT * FROM made)
    SELECT unit, arg_min(dims, rank) AS dims, arg_min(f, rank) AS factor_value, arg_min(o, rank) AS offset_value, CAST(min(rank) AS INT) AS prefix_rank FROM named GROUP BY 1"""
)
def q44_catalogue_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_frame(spark).select("unit", F.array_join(F.col("dim").cast("array<string>"), ",").alias("dims"), "factor_value", "offset_value", "prefix_rank")


@query(
    f"""WITH c AS ({_MADE}), d AS (SELECT 'U005' AS code, 'warning' AS severity FROM c UNION ALL SELECT 'H001', 'error' FROM c WHERE x_differs UNION ALL SELECT 'H001', 'error' FROM c WHERE y_differs)
    SELECT code, severity, count(*) AS n FROM d GROUP BY 1, 2"""
)
def q49_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .report import histogram

    return histogram(checking.check(sources(spark, sf_dir)))


@query(
    f"""WITH c AS (SELECT c_custkey AS a, c_nationkey AS b FROM customer WHERE c_custkey % 10 = 7)
    SELECT printf('customer%09d.f90', a) AS path FROM c UNION SELECT printf('nation%03d.f90', b) FROM c UNION SELECT printf('region%03d.f90', n_regionkey) FROM nation JOIN c ON n_nationkey = c.b"""
)
def q50_workset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a check of some programs (each tenth) needs, found in the whole tree."""
    from .workset import workset

    tree = sources(spark, sf_dir)
    return workset(tree, tree.where(F.col("path").rlike(r"customer[0-9]*7\.f90")).select("path")).select("path")
