"""The unit catalogue as a table, and names, values and verdicts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..units import Catalog, default_catalog
from ..units.algebra import SLOTS

SCHEMA = "unit string, dim array<int>, factor string, factor_value double, offset_value double, kind string, prefix_rank int"


def catalog_frame(spark: SparkSession, catalog: Catalog | None = None) -> DataFrame:
    """A row per resolvable name. Of two ways to read a name the one of the lower rank holds: 0 for a name of its own,
    else one more than its prefix's place. The number of rows is that of the catalogue's names."""
    c = catalog or default_catalog()
    ranks = {n: 0 for n in {*c.base, *c.derived}}
    for i, p in enumerate(c.prefixes, 1):
        for n in c.prefixable:
            ranks.setdefault(p + n, i)
    rows = []
    for n, rank in sorted(ranks.items()):
        q = c.find(n)
        rows.append((n, [int(d.const) for d in q.dims], str(q.factor), float(q.factor), float(q.offset), c.kinds.get(n), rank))
    return spark.createDataFrame(rows, SCHEMA)


def resolve(df: DataFrame, name: str, catalog: DataFrame, prefix: str = "") -> DataFrame:
    """The rows with the catalogue's columns for the unit that ``name`` names (nulls if it is unknown). The catalogue has a
    few hundred rows, so it is broadcast."""
    own = catalog.select([F.col(c).alias(f"{prefix}{c}") for c in catalog.columns])
    return df.join(F.broadcast(own), F.col(name) == F.col(f"{prefix}unit"), "left").drop(f"{prefix}unit")


def to_base(value: Column, factor: Column, offset: Column) -> Column:
    """A value in base units."""
    return value * factor + offset


def verdict(dim_a: Column, factor_a: Column, offset_a: Column, dim_b: Column, factor_b: Column, offset_b: Column) -> Column:
    return (
        F.when(dim_a != dim_b, "dim_mismatch").when(factor_a != factor_b, "scale_mismatch").when(offset_a != offset_b, "offset_mismatch").otherwise("equal")
    )


def equal_dim(dim_a: Column, dim_b: Column) -> Column:
    return dim_a == dim_b


def equal_strict(dim_a: Column, factor_a: Column, offset_a: Column, dim_b: Column, factor_b: Column, offset_b: Column) -> Column:
    return (dim_a == dim_b) & (factor_a == factor_b) & (offset_a == offset_b)


def dimension_faults(rows: DataFrame, found: str, wanted: str, catalog: DataFrame) -> DataFrame:
    """The rows whose two units are known and differ in dimension, with ``code``."""
    both = resolve(resolve(rows, found, catalog, "_a_"), wanted, catalog, "_b_")
    out = both.where(~equal_dim(F.col("_a_dim"), F.col("_b_dim")))
    return out.select(*rows.columns, F.lit("H001").alias("code"))


def scale_pairs(rows: DataFrame, key: str, unit: str, catalog: DataFrame) -> DataFrame:
    """(unit_a, unit_b, ratio, n): pairs of units of one dimension but other factors that meet in a key, and how often. A key
    holds at most the catalogue's units, so they are held in one row and no rows of a key are joined."""
    known = resolve(rows.select(key, unit).distinct(), unit, catalog).where("dim is not null")
    held = known.groupBy(key).agg(F.collect_set(F.struct(F.col(unit).alias("unit"), "dim", F.col("factor_value").alias("f"))).alias("u"))
    pairs = held.select(F.explode("u").alias("a"), "u").select("a", F.explode("u").alias("b"))
    pairs = pairs.where(equal_dim(F.col("a.dim"), F.col("b.dim")) & (F.col("a.unit") < F.col("b.unit")) & (F.col("a.f") != F.col("b.f")))
    return pairs.groupBy(F.col("a.unit").alias("unit_a"), F.col("b.unit").alias("unit_b"), (F.col("a.f") / F.col("b.f")).alias("ratio")).agg(F.count("*").alias("n"))


def conversion_verdict(slope: Column, shift: Column, factor: Column, offset: Column, to_factor: Column, to_offset: Column) -> Column:
    """Whether ``x * slope + shift`` takes values of one unit to the other: slope = factor / to_factor and
    shift = (offset - to_offset) / to_factor."""
    return F.when((slope == factor / to_factor) & (shift == (offset - to_offset) / to_factor), "holds").otherwise("S003")


def collisions(prefixes: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, n_ways): names that can be read in more than one way, as prefix (prefix) and unit (unit) or as one that is known
    (name). The product of the prefixes, some twenty, and the few units that take them."""
    made = prefixes.crossJoin(F.broadcast(names)).select(F.concat("prefix", "unit").alias("name"))
    return made.unionByName(known.select("name")).groupBy("name").agg(F.count("*").alias("n_ways")).where("n_ways > 1")


def product(dim_a: Column, dim_b: Column, sign: int = 1) -> Column:
    """The dimension of a product or quotient."""
    return F.zip_with(dim_a, dim_b, lambda x, y: x + y * sign)


def spelled(dim: Column) -> Column:
    """A dimension as text: ``M.L^-1.T^-2``."""
    names = F.array(*map(F.lit, SLOTS))
    terms = F.zip_with(names, dim, lambda n, e: F.when(e == 0, "").when(e == 1, n).otherwise(F.concat(n, F.lit("^"), e.cast("string"))))
    return F.array_join(F.filter(terms, lambda t: t != ""), ".")
