"""The test tables as cells, bags, grids and scores, for the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabag.functions.expressions import vector


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Line items as cells of their supplier's bag; the label is whether the supplier's balance is at the median or above."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    med = s.agg(F.percentile("s_acctbal", F.lit(0.5)).alias("med"))
    s = s.crossJoin(F.broadcast(med)).select("s_suppkey", F.col("s_nationkey").alias("group_id"), (F.col("s_acctbal") >= F.col("med")).cast("int").alias("label"))
    li = table(spark, d, "lineitem")
    met = li.join(s, li.l_suppkey == s.s_suppkey)
    return met.select(
        F.col("l_suppkey").alias("bag_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"), "label", vector("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"),
        (F.col("l_orderkey") % 1000).cast("double").alias("x"), (F.col("l_partkey") % 1000).cast("double").alias("y"), "group_id",
    )


CELLS = """
med AS (SELECT quantile_cont(s_acctbal, 0.5) AS med FROM supplier),
cells AS (
  SELECT l_suppkey AS bag_id, l_orderkey * 10 + l_linenumber AS cell_id, (s_acctbal >= med)::INT AS label, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
         (l_orderkey % 1000)::DOUBLE AS x, (l_partkey % 1000)::DOUBLE AS y, s_nationkey AS group_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey, med
)"""

Z = """
st AS (SELECT avg(f0) m0, avg(f1) m1, avg(f2) m2, avg(f3) m3, stddev_pop(f0) s0, stddev_pop(f1) s1, stddev_pop(f2) s2, stddev_pop(f3) s3 FROM cells),
z AS (
  SELECT bag_id, cell_id, label, (f0 - m0) / CASE WHEN s0 < 1e-12 THEN 1 ELSE s0 END AS z0, (f1 - m1) / CASE WHEN s1 < 1e-12 THEN 1 ELSE s1 END AS z1,
         (f2 - m2) / CASE WHEN s2 < 1e-12 THEN 1 ELSE s2 END AS z2, (f3 - m3) / CASE WHEN s3 < 1e-12 THEN 1 ELSE s3 END AS z3 FROM cells, st
)"""


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cells of their nation's bag, for kernels over pairs of cells."""
    c = table(spark, d, "customer")
    features = F.array(F.col("c_acctbal") / 5000.0, (F.col("c_custkey") % 97).cast("double") / 97.0)
    return c.select(F.col("c_nationkey").cast("long").alias("bag_id"), F.col("c_custkey").alias("cell_id"), (F.col("c_nationkey") % 2).alias("label"), features.alias("features"))


PEOPLE = """
people AS (SELECT c_nationkey::BIGINT AS bag_id, c_custkey AS cell_id, (c_nationkey % 2)::INT AS label, c_acctbal / 5000.0::DOUBLE AS f0, (c_custkey % 97)::DOUBLE / 97.0::DOUBLE AS f1 FROM customer)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a grid of 40 columns with two bands; every seventh size is invalid."""
    p = table(spark, d, "part")
    r, c = F.floor(F.col("p_partkey") / 40).cast("int"), (F.col("p_partkey") % 40).cast("int")
    return p.select(r.alias("row"), c.alias("col"), (c + 0.5).cast("double").alias("x"), (-(r + 0.5)).cast("double").alias("y"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("bands"), (F.col("p_size") % 7 != 0).alias("valid"))


GRID = """
grid AS (
  SELECT (p_partkey // 40)::INT AS "row", (p_partkey % 40)::INT AS col, (p_partkey % 40)::DOUBLE + 0.5 AS x, -((p_partkey // 40)::DOUBLE + 0.5) AS y,
         p_size::DOUBLE AS b0, p_retailprice AS b1, p_size % 7 <> 0 AS valid FROM part
), ext AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM grid)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a score in [0, 1] that has ties, a second score and a label."""
    c = table(spark, d, "customer")
    s = F.bround((F.col("c_acctbal") + 1000.0) / 11000.0, 3)
    other = F.bround(s * 0.8 + (F.col("c_custkey") % 11).cast("double") / 55.0, 3)
    label = ((F.col("c_custkey") * 31 + F.floor(F.col("c_acctbal") / 1000)) % 5 < 2).cast("int")
    return c.select(F.col("c_custkey").alias("id"), label.alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("score"), other.alias("other"), (F.col("c_nationkey") % 4).alias("repeat"), F.col("c_mktsegment").alias("method"))


SCORED = """
scored AS (
  SELECT c_custkey AS id, ((c_custkey * 31 + floor(c_acctbal / 1000)::BIGINT) % 5 < 2)::INT AS label, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)) AS score,
         round_even(s * 0.8::DOUBLE + (c_custkey % 11)::DOUBLE / 55.0::DOUBLE, 3)::DOUBLE AS other, (c_nationkey % 4)::INT AS repeat, c_mktsegment AS method
  FROM (SELECT *, round_even((c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE, 3)::DOUBLE AS s FROM customer)
)"""


def sql_round(c: Column, digits: int = 6) -> Column:
    """round(c, digits) of doubles as DuckDB has it: the product with 10^digits to the nearest integer, halves away from 0. Spark's own
    rounds the shortest decimal, which differs where that ends in a 5 or the product isn't exact."""
    unit = F.lit(10.0**digits)
    there = F.round(c * unit) / unit
    return F.when(F.abs(there) < float("inf"), there).otherwise(c)  # the product may overflow


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded, and arrays of doubles too."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(F.col(name), digits) + F.lit(0.0)).alias(name))
        elif kind == "array<double>":
            out.append(F.transform(name, lambda v: F.round(v, digits) + F.lit(0.0)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
