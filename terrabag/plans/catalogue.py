"""Catalogue of the engine's queries with their DuckDB counterparts. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrabag.functions.expressions import hash_uniform, sigmoid
from terrabag.operators import bags, folds, grid as g, kernels as k, metrics as m, stats

from .views import CELLS, GRID, PEOPLE, SCORED, Z, cells, grid, people, rounded, scored, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, rounded to 6 digits, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """All queries, those that fit models too."""
    from . import model_queries, more_queries  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query; models whose fit has no SQL form have none."""
    queries()
    return dict(_SQL)


# ---- ingest and bags


def _audited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as a cell table: users are sites, types of event give labels, some of them invalid."""
    e = table(spark, d, "events")
    label = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", F.lit(None)).otherwise(0)
    rows = e.select("event_id", F.when(F.col("user_id") % 50 != 0, F.col("user_id")).alias("site"), label.alias("presence"), "value", (F.col("event_id") % 13).alias("x"), (F.col("event_id") % 7).alias("y"))
    return bags.audited_bags(rows, ["value"], "presence", "site", "x", "y", "event_id")


_AUDIT = """
WITH t AS (
  SELECT CASE WHEN user_id % 50 <> 0 THEN user_id::VARCHAR END AS id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN NULL ELSE 0 END AS lab,
         value, event_id % 13 AS x, event_id % 7 AS y, event_id FROM events
), r AS (
  SELECT *, CASE WHEN id IS NULL THEN 'missing_id' WHEN lab IS NULL OR lab NOT IN (0, 1) THEN 'invalid_label' END AS reason FROM t
), o AS (SELECT *, reason IS NULL AND value IS NOT NULL AND isfinite(value) AS ok FROM r),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lab, id, x, y ORDER BY event_id) AS rn FROM o WHERE ok) WHERE rn = 1),
sizes AS (SELECT lab, id, count(*) AS "rows", count(DISTINCT CASE WHEN ok THEN x * 100 + y END) AS n FROM o WHERE reason IS NULL GROUP BY ALL)"""


@query(_AUDIT + """
SELECT CASE WHEN lab = 1 THEN 'site-' ELSE 'background-' END || id AS bag_id, event_id AS cell_id, lab::INT AS label, round(value, 6) AS value, x::DOUBLE AS x, y::DOUBLE AS y
FROM first JOIN sizes USING (lab, id) WHERE n >= 3""")
def tabular_load_audit(spark, d):
    return _audited(spark, d)[0].select("bag_id", "cell_id", "label", F.element_at("features", 1).alias("value"), "x", "y")


@query(_AUDIT + """
SELECT id, reason, count(*) AS "rows", 0::BIGINT AS valid_unique_cells FROM o WHERE reason IS NOT NULL GROUP BY id, reason
UNION ALL SELECT id, 'fewer_than_min_unique_cells', "rows", n FROM sizes WHERE n < 3""")
def tabular_exclusions(spark, d):
    return _audited(spark, d)[1]


@query("SELECT * FROM (SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey * 10 + l_linenumber) = 1)")
def tabular_dedup_cells(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return bags.dedup_first(li, ["l_partkey", "l_shipdate"], "ord").drop("ord")


@query("WITH " + CELLS + "SELECT bag_id, cell_id FROM cells QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('7:' || bag_id || ':' || cell_id), cell_id) <= 120")
def bag_cap_md5(spark, d):
    return bags.cap(cells(spark, d).select("bag_id", "cell_id"), "bag_id", "cell_id", 120, 7)


@query("SELECT l_partkey AS bag_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def min_bag_filter(spark, d):
    return bags.at_least(table(spark, d, "lineitem").select(F.col("l_partkey").alias("bag_id")), "bag_id", 30).groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + CELLS + "SELECT bag_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM cells GROUP BY 1")
def site_centroids(spark, d):
    return stats.centroids(cells(spark, d))


@query("WITH " + CELLS + "SELECT bag_id, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS diameter FROM cells GROUP BY 1")
def bag_diameter(spark, d):
    return stats.bag_diameter(cells(spark, d))


_BOX = "WITH " + CELLS + """, b AS (SELECT min(x) a, max(x) b, min(y) c, max(y) e FROM cells WHERE label = 0),
box AS (SELECT a + 0.05 * (b - a) AS x0, b - 0.05 * (b - a) AS x1, c + 0.05 * (e - c) AS y0, e - 0.05 * (e - c) AS y1 FROM b),
kept AS (SELECT cells.* FROM cells, box WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""


@query(_BOX + "SELECT bag_id, cell_id FROM kept")
def bbox_restrict(spark, d):
    return stats.restrict_to_background(cells(spark, d), -0.05).select("bag_id", "cell_id")


@query(_BOX + """, b4 AS (SELECT count(*) n, count(DISTINCT CASE WHEN label = 1 THEN bag_id END) s FROM cells), af AS (SELECT count(*) n, count(DISTINCT CASE WHEN label = 1 THEN bag_id END) s FROM kept)
SELECT b4.n AS cells_before, b4.s AS sites_before, af.n AS cells_after, af.s AS sites_after, b4.n - af.n AS cells_dropped, b4.s - af.s AS sites_dropped FROM b4, af""")
def domain_info(spark, d):
    c = cells(spark, d)
    return stats.domain_info(c, stats.restrict_to_background(c, -0.05))


@query("WITH " + CELLS + """SELECT floor(('0x' || substr(md5('3:' || cell_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE * 24)::INT AS random_bag, count(*) AS n, round(avg(f0), 6) AS mean_0
FROM cells WHERE label = 0 GROUP BY 1""")
def random_background_bags(spark, d):
    r = bags.random_groups(cells(spark, d).filter("label = 0"), "cell_id", 24, 3)
    return r.groupBy("random_bag").agg(F.count(F.lit(1)).alias("n"), F.avg(F.element_at("features", 1)).alias("mean_0"))


def _seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), (F.col("p_partkey") * 37 % 1009).cast("double").alias("x"), (F.col("p_partkey") * 101 % 997).cast("double").alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("centre_id"), (F.col("s_suppkey") * 37 % 1009).cast("double").alias("x"), (F.col("s_suppkey") * 101 % 997).cast("double").alias("y"))
    return c, s


@query("""WITH c AS (SELECT p_partkey AS cell_id, p_partkey * 37 % 1009 AS x, p_partkey * 101 % 997 AS y FROM part), s AS (SELECT s_suppkey AS centre_id, s_suppkey * 37 % 1009 AS cx, s_suppkey * 101 % 997 AS cy FROM supplier)
SELECT centre_id, cell_id, ((x - cx) * (x - cx) + (y - cy) * (y - cy))::DOUBLE AS d2, row_number() OVER (PARTITION BY centre_id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), cell_id) AS rank FROM c, s QUALIFY rank <= 8""")
def knn_background_patch(spark, d):
    c, s = _seeds(spark, d)
    return g.nearest_cells(c, s, 8).select("centre_id", "cell_id", "d2", F.col("rank").cast("long").alias("rank"))


@query("WITH " + GRID + """, c AS (SELECT l_suppkey AS bag_id, l_orderkey * 10 + l_linenumber AS cell_id, (l_partkey // 40)::INT AS "row", (l_partkey % 40)::INT AS col FROM lineitem),
one AS (SELECT c.*, b0, b1 FROM c JOIN grid USING ("row", col) WHERE valid QUALIFY row_number() OVER (PARTITION BY bag_id, "row", col ORDER BY cell_id) = 1),
pick AS (SELECT *, count(*) OVER (PARTITION BY bag_id) AS n, row_number() OVER (PARTITION BY bag_id ORDER BY md5('5:' || bag_id || ':' || cell_id), cell_id) AS rn FROM one)
SELECT bag_id, cell_id, b0, round(b1, 6) AS b1 FROM pick WHERE rn <= 60 AND n >= 3""")
def align_to_grid(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("bag_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"), F.lit(1).alias("label"), F.floor(F.col("l_partkey") / 40).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"))
    a = g.align(li, grid(spark, d), 3, 60, 5)
    return a.select("bag_id", "cell_id", F.element_at("features", 1).alias("b0"), F.element_at("features", 2).alias("b1"))


@query("WITH " + GRID + """SELECT "row", col FROM grid WHERE valid AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity >= 49 AND l_partkey // 40 = grid."row" AND l_partkey % 40 = grid.col)""")
def occupied_anti_join(spark, d):
    taken = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.floor(F.col("l_partkey") / 40).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"))
    return bags.anti(grid(spark, d).filter("valid").select("row", "col"), taken, ["row", "col"])


@query("WITH " + GRID + """SELECT "row", col, md5('11:' || "row" || ':' || col) AS priority FROM grid WHERE valid ORDER BY priority LIMIT 50""")
def anchor_reservoir(spark, d):
    return g.anchors(grid(spark, d), 50, 11)


@query("WITH " + CELLS + """SELECT bag_id, copy, count(*) AS n FROM (
  SELECT bag_id, 0 AS copy FROM cells UNION ALL
  SELECT bag_id, 1 FROM (SELECT bag_id, row_number() OVER (PARTITION BY bag_id ORDER BY md5('9:' || bag_id || ':' || cell_id), cell_id) rn, count(*) OVER (PARTITION BY bag_id) n FROM cells) WHERE rn <= greatest(1, ceil(n * 0.25::DOUBLE))) GROUP BY ALL""")
def duplicate_cells(spark, d):
    return bags.duplicate_selected(cells(spark, d), 0.25, 9).groupBy("bag_id", "copy").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + CELLS + """, c AS (SELECT bag_id, avg(x) cx, avg(y) cy FROM cells GROUP BY 1), o AS (SELECT min(cx) ox, min(cy) oy FROM c)
SELECT bag_id, floor((cx - ox) / 20)::BIGINT || ':' || floor((cy - oy) / 20)::BIGINT AS spatial_group FROM c, o""")
def spatial_block_groups(spark, d):
    return stats.spatial_groups(cells(spark, d), 20.0)


@query("""SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'site' ELSE 'background' END || '-' || lpad((row_number() OVER (PARTITION BY s_acctbal >= 5000 ORDER BY s_suppkey) - 1)::VARCHAR, 5, '0') AS bag_name FROM supplier""")
def bag_relabel(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") >= 5000).cast("int").alias("label"))
    return bags.relabel(s, "s_suppkey").select("s_suppkey", "bag_name")


@query("WITH " + CELLS + """SELECT count(*) - count(f0 + f1 + f2 + f3) AS not_finite, 0::BIGINT AS wrong_width, count(*) FILTER (label NOT IN (0, 1)) AS bad_label, count(*) FILTER (bag_id IS NULL) AS no_id,
(SELECT count(*) FROM (SELECT bag_id FROM cells GROUP BY 1 HAVING count(DISTINCT label) > 1)) AS mixed_labels FROM cells""")
def dataset_violations(spark, d):
    return bags.violations(cells(spark, d).withColumn("bag_id", F.col("bag_id").cast("string")), 4)


@query("WITH " + CELLS + "SELECT label, count(DISTINCT bag_id) AS bags, count(*) AS cells FROM cells GROUP BY 1")
def label_histogram(spark, d):
    return cells(spark, d).groupBy("label").agg(F.countDistinct("bag_id").alias("bags"), F.count(F.lit(1)).alias("cells"))


@query("WITH " + CELLS + ", n AS (SELECT count(*) AS n FROM cells GROUP BY bag_id) SELECT count(*) AS bags, min(n) AS min_n, quantile_cont(n, 0.5)::DOUBLE AS median_n, max(n) AS max_n, round(avg(n), 6) AS mean_n FROM n")
def bag_size_distribution(spark, d):
    return stats.size_distribution(cells(spark, d))


@query("WITH " + CELLS + ", a AS (SELECT DISTINCT bag_id FROM cells WHERE label = 1), b AS (SELECT DISTINCT bag_id FROM cells WHERE f0 > 49) SELECT bag_id, 'both' AS side FROM (SELECT bag_id FROM a INTERSECT SELECT bag_id FROM b) UNION ALL SELECT bag_id, 'left' FROM (SELECT bag_id FROM a EXCEPT SELECT bag_id FROM b)")
def bag_set_operations(spark, d):
    c = cells(spark, d)
    a, b = c.filter("label = 1").select("bag_id").distinct(), c.filter(F.element_at("features", 1) > 49).select("bag_id").distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("left")))


# ---- statistics and kernels


@query("WITH " + CELLS + "," + Z + "SELECT bag_id, cell_id, round(z0, 6) + 0 AS z0, round(z1, 6) + 0 AS z1, round(z2, 6) + 0 AS z2, round(z3, 6) + 0 AS z3 FROM z")
def zscore_cells(spark, d):
    return stats.zscore(cells(spark, d), 4).select("bag_id", "cell_id", *[F.element_at("features", i + 1).alias(f"z{i}") for i in range(4)])


@query("SELECT round(avg(s_acctbal), 6) AS mean_s_acctbal, round(stddev_samp(s_acctbal), 6) AS std_s_acctbal FROM supplier")
def sample_scaling(spark, d):
    return stats.column_scaling(table(spark, d, "supplier"), ["s_acctbal"], sample=True)


@query("WITH " + CELLS + "SELECT bag_id, round(avg(f0), 6) AS mean_0, round(avg(f1), 6) AS mean_1, round(avg(f2), 6) AS mean_2, round(avg(f3), 6) AS mean_3 FROM cells GROUP BY 1")
def bag_mean_vector(spark, d):
    return stats.bag_means(cells(spark, d), 4)


@query("WITH " + CELLS + "SELECT bag_id, round(avg(f0), 6) AS mean_0, round(avg(f1), 6) AS mean_1, round(stddev_pop(f0), 6) AS std_0, round(stddev_pop(f1), 6) AS std_1 FROM cells GROUP BY 1")
def bag_mean_std(spark, d):
    return stats.bag_means(cells(spark, d), 2, deviations=True)


@query("WITH " + CELLS + "SELECT bag_id, round(ln(1 + count(*)::DOUBLE), 6) AS log_n, round(ln(1 + sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2)), 6) AS log_extent FROM cells GROUP BY 1")
def bag_geometry(spark, d):
    return stats.bag_geometry(cells(spark, d))


@query("""SELECT a.vec_id AS i, b.vec_id AS j, round(exp(-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) ** 2)) / 2), 6) AS value
FROM embeddings a JOIN embeddings b ON a.vec_id <= b.vec_id""")
def rbf_gram(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("bag_id"), F.col("embedding").cast("array<double>").alias("features"))
    return k.gaussian_of(k.embedding_distances(v, column="features"), 1.0).select(F.col("bag_i").alias("i"), F.col("bag_j").alias("j"), "value")


_KME = "WITH " + PEOPLE + ", kme AS (SELECT a.bag_id AS bag_i, b.bag_id AS bag_j, avg(exp(-((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)) / 0.5::DOUBLE)) AS v FROM people a JOIN people b ON a.bag_id <= b.bag_id GROUP BY ALL)"


@query(_KME + "SELECT bag_i, bag_j, round(v, 6) AS value FROM kme")
def exact_kme_gram(spark, d):
    c = people(spark, d)
    return k.exact_gram(c, c, 0.5)


@query(_KME + "SELECT bag_i, bag_j, round_even(v, 3)::DOUBLE AS value FROM kme")
def exact_kme_gram_rounded(spark, d):
    c = people(spark, d)
    return k.exact_gram(c, c, 0.5, decimals=3)


_W = k.fourier_weights(2, 4, 0.5, 42)
_PHI = ", ".join(f"avg({fn}(f0 * {w[0]!r}::DOUBLE + f1 * {w[1]!r}::DOUBLE) * 0.5) AS p{i + 4 * (fn == 'sin')}" for fn in ("cos", "sin") for i, w in enumerate(_W.tolist()))
_EMB = "WITH " + PEOPLE + f", emb AS (SELECT bag_id, {_PHI} FROM people GROUP BY 1)"
_DOT = " + ".join(f"a.p{i} * b.p{i}" for i in range(8))


@query(_EMB + "SELECT bag_id, " + ", ".join(f"round(p{i}, 6) + 0 AS p{i}" for i in range(8)) + " FROM emb")
def rff_embedding(spark, d):
    return k.small_embeddings(people(spark, d), _W).select("bag_id", *[F.element_at("embedding", i + 1).alias(f"p{i}") for i in range(8)])


@query(_EMB + "SELECT bag_id, " + ", ".join(f"round(p{i}, 6) + 0 AS p{i}" for i in range(8)) + " FROM emb")
def rff_embedding_arrow(spark, d):
    return k.embeddings(people(spark, d), _W).select("bag_id", *[F.element_at("embedding", i + 1).alias(f"p{i}") for i in range(8)])


@query(_EMB + f"SELECT a.bag_id AS bag_i, b.bag_id AS bag_j, round({_DOT}, 6) AS value FROM emb a JOIN emb b ON a.bag_id <= b.bag_id")
def rff_gram(spark, d):
    return k.linear_gram(k.embeddings(people(spark, d), _W))


@query(_EMB + ", kme AS" + _KME.split(", kme AS")[1] + f""", r AS (SELECT a.bag_id AS bag_i, b.bag_id AS bag_j, {_DOT} AS v FROM emb a JOIN emb b ON a.bag_id <= b.bag_id),
h AS (SELECT bag_i, bag_j, kme.v AS exact, r.v AS approx FROM kme JOIN r USING (bag_i, bag_j)), f AS (SELECT * FROM h UNION ALL SELECT bag_j, bag_i, exact, approx FROM h WHERE bag_i < bag_j)
SELECT round(sqrt(sum((exact - approx) ** 2)) / sqrt(sum(exact ** 2)), 6) AS relative_error, round(max(abs(exact - approx)), 6) AS max_error, round(corr(CASE WHEN bag_i < bag_j THEN exact END, CASE WHEN bag_i < bag_j THEN approx END), 6) AS triangle_correlation FROM f""")
def gram_rff_vs_exact(spark, d):
    c = people(spark, d)
    exact = stats.mirror(k.exact_gram(c, c, 0.5), "value").withColumnRenamed("value", "exact")
    approx = stats.mirror(k.linear_gram(k.embeddings(c, _W)), "value").withColumnRenamed("value", "approx")
    return m.kernel_diagnostics(exact.join(approx, ["bag_i", "bag_j"]))


_T = k.unit_directions(2, 3, 42)
_PROJ = "WITH " + PEOPLE + ", proj AS (" + " UNION ALL ".join(f"SELECT bag_id, {i} AS proj, f0 * {t[0]!r}::DOUBLE + f1 * {t[1]!r}::DOUBLE AS v FROM people" for i, t in enumerate(_T.tolist())) + "), s AS (SELECT bag_id, proj, list(v ORDER BY v) AS v FROM proj GROUP BY ALL)"
_QUANT = _PROJ + """, q AS (
  SELECT bag_id, proj, j, v[lo + 1] * (1 - (p - lo)) + v[least(lo + 1, len(v) - 1) + 1] * (p - lo) AS q FROM (
    SELECT *, floor(p)::BIGINT AS lo FROM (SELECT bag_id, proj, v, j, greatest(0.0::DOUBLE, least(len(v) - 1.0::DOUBLE, (j + 0.5::DOUBLE) / 8 * len(v) - 0.5::DOUBLE)) AS p FROM s, range(8) r(j))))"""


@query(_QUANT + "SELECT bag_id, proj::INT AS proj, j::INT AS j, round(q, 6) + 0 AS q FROM q")
def sw_quantile_embedding(spark, d):
    return k.quantile_embeddings(people(spark, d), _T, 8).select("bag_id", "proj", F.posexplode("q").alias("j", "q"))


_QD = _QUANT + ", dist AS (SELECT a.bag_id AS bag_i, b.bag_id AS bag_j, sqrt(avg((a.q - b.q) ** 2)) AS v FROM q a JOIN q b USING (proj, j) WHERE a.bag_id <= b.bag_id GROUP BY ALL)"


@query(_QD + "SELECT bag_i, bag_j, round(v, 6) AS value FROM dist")
def sw2_distance(spark, d):
    return k.quantile_distances(k.quantile_embeddings(people(spark, d), _T, 8))


@query(_QD + "SELECT bag_i, bag_j, round(exp(-v * v / 0.5::DOUBLE), 6) AS value FROM dist")
def sw_kernel(spark, d):
    return k.gaussian_of(k.quantile_distances(k.quantile_embeddings(people(spark, d), _T, 8)), 0.5)


def _read(v: str, n: str) -> str:
    p = f"CASE WHEN {n} > 1 THEN j::DOUBLE / ({n} - 1) * (len({v}) - 1) ELSE 0 END"
    lo = f"floor({p})::BIGINT"
    return f"({v}[{lo} + 1] * (1 - ({p} - {lo})) + {v}[least({lo} + 1, len({v}) - 1) + 1] * ({p} - {lo}))"


@query(_PROJ + f""", pairs AS (SELECT a.bag_id AS bag_i, b.bag_id AS bag_j, a.proj, a.v AS av, b.v AS bv, greatest(len(a.v), len(b.v)) AS n FROM s a JOIN s b ON a.proj = b.proj AND a.bag_id <= b.bag_id),
w AS (SELECT bag_i, bag_j, proj, avg(abs({_read("av", "n")} - {_read("bv", "n")})) AS w1 FROM (SELECT *, unnest(range(n)) AS j FROM pairs) GROUP BY ALL)
SELECT bag_i, bag_j, round(avg(w1), 6) AS value FROM w GROUP BY ALL""")
def sw1_distance(spark, d):
    return k.sliced_wasserstein(k.projections(people(spark, d), _T), p=1)


@query(_PROJ + f""", n AS (SELECT bag_id, max(len(v)) AS n FROM s GROUP BY 1), t AS (SELECT n // 25 AS bucket, max(n) AS t FROM n GROUP BY 1),
r AS (SELECT bag_id, proj, v, t FROM s JOIN n USING (bag_id) JOIN t ON n.n // 25 = t.bucket),
x AS (SELECT bag_id, proj, list({_read("v", "t")} ORDER BY j) AS v FROM (SELECT *, unnest(range(t)) AS j FROM r) GROUP BY ALL),
pairs AS (SELECT a.bag_id AS bag_i, b.bag_id AS bag_j, a.proj, a.v AS av, b.v AS bv, greatest(len(a.v), len(b.v)) AS n FROM x a JOIN x b ON a.proj = b.proj AND a.bag_id <= b.bag_id),
w AS (SELECT bag_i, bag_j, proj, avg(({_read("av", "n")} - {_read("bv", "n")}) ** 2) AS w2 FROM (SELECT *, unnest(range(n)) AS j FROM pairs) GROUP BY ALL)
SELECT bag_i, bag_j, round(sqrt(avg(w2)), 6) AS value FROM w GROUP BY ALL""")
def sw_bucketed(spark, d):
    return k.sliced_wasserstein(k.bucketed(k.projections(people(spark, d), _T), 25))


@query(_QD + "SELECT round(quantile_cont(v, 0.5), 6) AS sigma FROM dist WHERE bag_i < bag_j")
def sigma_percentile(spark, d):
    return k.distance_percentile(k.quantile_distances(k.quantile_embeddings(people(spark, d), _T, 8)))


_U = "('0x' || substr(md5('4:{0}:' || t), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE"


@query("WITH " + PEOPLE + """, c AS (SELECT f0, f1, row_number() OVER (ORDER BY md5('4:' || bag_id || ':' || cell_id), bag_id, cell_id) - 1 AS i FROM people QUALIFY i < 2048), n AS (SELECT count(*) AS n FROM c),
t AS (SELECT n, unnest(range(least(8192, 4 * n))) AS t FROM n), ij AS (SELECT floor(""" + _U.format("a") + " * n)::BIGINT AS i, floor(" + _U.format("b") + """ * n)::BIGINT AS j FROM t),
d AS (SELECT sqrt((a.f0 - b.f0) ** 2 + (a.f1 - b.f1) ** 2) AS d FROM ij JOIN c a ON ij.i = a.i JOIN c b ON ij.j = b.i)
SELECT round(coalesce(quantile_cont(d, 0.5), 1), 6) AS sigma FROM d WHERE d > 0""")
def median_cell_distance(spark, d):
    return k.median_cell_distance(people(spark, d), 4)


# ---- grid and focal windows

_REFLECT = """, o AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j)), seen AS (
  SELECT c."row", c.col, CASE WHEN c."row" + i < 0 THEN -(c."row" + i) WHEN c."row" + i >= h THEN 2 * (h - 1) - (c."row" + i) ELSE c."row" + i END AS r,
         CASE WHEN c.col + j < 0 THEN -(c.col + j) WHEN c.col + j >= w THEN 2 * (w - 1) - (c.col + j) ELSE c.col + j END AS k FROM grid c, o, ext)"""


def _extent(gr: DataFrame) -> tuple[int, int]:
    r = gr.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first()
    return int(r.h), int(r.w)


@query("WITH " + GRID + _REFLECT + """SELECT seen."row", seen.col, round(avg(CASE WHEN g.valid THEN g.b0 END), 6) AS focal FROM seen JOIN grid g ON g."row" = r AND g.col = k GROUP BY ALL""")
def focal_mean_reflect(spark, d):
    gr = grid(spark, d)
    return g.focal_mean(gr.withColumn("value", F.element_at("bands", 1)), "value", 5, *_extent(gr))


_BETA = (0.8, -0.5, 0.3, 0.1)
_CELL = "cos(b0 / 20) * 0.8 - 0.5 * sin(b0 / 20) + 0.3 * cos(b1 / 500) + 0.1 * sin(b1 / 500)"


def _cell_score() -> F.Column:
    a, b = F.element_at("bands", 1) / 20.0, F.element_at("bands", 2) / 500.0
    return F.cos(a) * _BETA[0] + _BETA[1] * F.sin(a) + _BETA[2] * F.cos(b) + _BETA[3] * F.sin(b)


@query("WITH " + GRID + _REFLECT + f"""SELECT seen."row", seen.col, round(1 / (1 + exp(-avg(CASE WHEN g.valid THEN {_CELL} END))), 6) AS suitability FROM seen JOIN grid g ON g."row" = r AND g.col = k GROUP BY ALL""")
def focal_linear_collapse(spark, d):
    gr = grid(spark, d).withColumn("value", _cell_score())
    f = g.focal_mean(gr, "value", 5, *_extent(gr))
    return f.select("row", "col", sigmoid("focal").alias("suitability"))


@query("WITH " + GRID + """, a AS (SELECT "row", col FROM grid WHERE "row" % 4 = 0 AND col % 4 = 0 AND valid), o AS (SELECT i, j FROM range(-1, 2) p(i), range(-1, 2) q(j))
SELECT a."row", a.col, count(*) AS n, round(avg(b0), 6) AS mean_0 FROM a, o JOIN grid g ON g."row" = a."row" + i AND g.col = a.col + j WHERE g.valid GROUP BY ALL HAVING count(*) >= 3""")
def strided_map_bags(spark, d):
    return g.strided_bags(grid(spark, d), 4, 3).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.avg(F.element_at("bands", 1)).alias("mean_0"))


@query("WITH " + GRID + """SELECT "row", col, b0, round(b1, 6) AS b1, valid FROM grid WHERE "row" BETWEEN 1 AND 3 AND col BETWEEN 5 AND 11""")
def window_extract(spark, d):
    return g.window(grid(spark, d), 1, 5, 3, 7).select("row", "col", F.element_at("bands", 1).alias("b0"), F.element_at("bands", 2).alias("b1"), "valid")


@query("WITH " + GRID + """SELECT ("row" // 16)::INT AS tile_row, (col // 16)::INT AS tile_col, min("row") AS row_off, min(col) AS col_off, max("row") - min("row") + 1 AS height, max(col) - min(col) + 1 AS width, count(*) FILTER (valid) AS valid_cells FROM grid GROUP BY ALL""")
def grid_blocks(spark, d):
    return g.blocks(grid(spark, d), 16)


@query("WITH " + GRID + """SELECT 1 AS site_id, "row", col FROM grid WHERE valid AND x BETWEEN 2 AND 20 AND y BETWEEN -4 AND -1""")
def polygon_cover(spark, d):
    ring = spark.sql("SELECT 1 AS site_id, transform(array(named_struct('x', 2D, 'y', -4D), named_struct('x', 20D, 'y', -4D), named_struct('x', 20D, 'y', -1D), named_struct('x', 2D, 'y', -1D), named_struct('x', 2D, 'y', -4D)), p -> p) AS ring")
    return g.cover(grid(spark, d), ring).select("site_id", "row", "col")


@query("WITH " + GRID + """, p AS (SELECT s_suppkey AS point_id, (s_suppkey // 40)::INT AS "row", (s_suppkey % 40)::INT AS col FROM supplier),
r AS (SELECT point_id, greatest(abs(g."row" - p."row"), abs(g.col - p.col)) AS ring FROM p JOIN grid g ON valid AND abs(g."row" - p."row") <= 4 AND abs(g.col - p.col) <= 4),
n AS (SELECT point_id, k AS radius, (SELECT count(*) FROM r WHERE r.point_id = q.point_id AND ring <= k) AS cells FROM (SELECT DISTINCT point_id FROM r) q, range(1, 5) t(k))
SELECT point_id, radius::INT AS radius, cells FROM n WHERE cells >= 12 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY radius) = 1""")
def point_growth(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), F.floor(F.col("s_suppkey") / 40).cast("int").alias("row"), (F.col("s_suppkey") % 40).cast("int").alias("col"))
    return g.grow_points(p, grid(spark, d), 12, 4)


@query("WITH " + GRID + """, p AS (SELECT s_suppkey AS point_id, ((s_suppkey * 7) // 40)::INT AS "row", ((s_suppkey * 7) % 40)::INT AS col FROM supplier)
SELECT point_id, b0, coalesce(valid, false) AS valid FROM p LEFT JOIN grid USING ("row", col)""")
def point_sampling(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), F.floor(F.col("s_suppkey") * 7 / 40).cast("int").alias("row"), (F.col("s_suppkey") * 7 % 40).cast("int").alias("col"))
    return g.sample_points(p, grid(spark, d)).select("point_id", F.element_at("bands", 1).alias("b0"), "valid")


@query()
def spatial_background_bags(spark, d):
    taken = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.floor(F.col("l_partkey") / 40).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"))
    return g.background_bags(grid(spark, d), taken, 10, 8, 3, 4)


@query("""WITH c AS (SELECT p_partkey AS cell_id, p_partkey * 37 % 1009 AS x, p_partkey * 101 % 997 AS y, cos(p_size / 10.0::DOUBLE) AS f FROM part), s AS (SELECT s_suppkey AS centre_id, s_suppkey * 37 % 1009 AS cx, s_suppkey * 101 % 997 AS cy FROM supplier),
k AS (SELECT centre_id, f FROM c, s QUALIFY row_number() OVER (PARTITION BY centre_id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), cell_id) <= 16)
SELECT centre_id, round(1 / (1 + exp(-avg(f))), 6) AS suitability FROM k GROUP BY 1""")
def xy_surface_knn(spark, d):
    c, s = _seeds(spark, d)
    f = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), F.cos(F.col("p_size") / 10.0).alias("f"))
    near = g.nearest_cells(c, s, 16).join(f, "cell_id")
    return near.groupBy("centre_id").agg(F.avg("f").alias("f")).select("centre_id", sigmoid("f").alias("suitability"))


# ---- metrics

_T5 = (0.25, 0.4, 0.5, 0.6, 0.75)
_QUADS = "WITH " + SCORED + """, q AS (SELECT t AS threshold, count(*) FILTER (score >= t AND label = 1)::DOUBLE AS tp, count(*) FILTER (score < t AND label = 0)::DOUBLE AS tn, count(*) FILTER (score >= t AND label = 0)::DOUBLE AS fp,
count(*) FILTER (score < t AND label = 1)::DOUBLE AS fn FROM scored, (VALUES (0.25::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.75::DOUBLE)) v(t) GROUP BY t)"""


@query(_QUADS + "SELECT threshold, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn FROM q")
def cm_quads(spark, d):
    return m.confusion(scored(spark, d), _T5)


@query(_QUADS + """, b AS (SELECT *, tp + tn + fp + fn AS n, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS se, CASE WHEN fp + tn = 0 THEN 0 ELSE tn / (fp + tn) END AS sp, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr,
CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS npv, CASE WHEN tn + fn = 0 THEN 0 ELSE fn / (tn + fn) END AS fom, CASE WHEN tp + fp = 0 THEN 0 ELSE fp / (tp + fp) END AS fdr FROM q),
c AS (SELECT *, (tp + fn) / n AS prev, (tp + tn) / n AS acc, (fp + fn) / n AS err, (tn + fp) / n AS other, (tp + fp) / n AS pm, (fn + tn) / n AS pm2, CASE WHEN abs(1 - sp) < 1e-10 THEN 0 ELSE se / (1 - sp) END AS lrp, CASE WHEN abs(sp) < 1e-10 THEN 0 ELSE (1 - se) / sp END AS lrn,
greatest(least(se, 1 - 1e-10), 1e-10) AS cse, greatest(least(1 - sp, 1 - 1e-10), 1e-10) AS csp FROM b),
e AS (SELECT *, CASE WHEN se = 0 THEN 0 ELSE 1 - (1 - sp) / se END AS kg, CASE WHEN se = 0 THEN 0 ELSE 1 - pm / se END AS kg2, CASE WHEN sp > 0 AND sp < 1 AND abs(lrn) >= 1e-10 THEN lrp / lrn ELSE 0 END AS dor, CASE WHEN abs(pm) < 1e-10 THEN 0 ELSE se / pm END AS ind2,
ln(cse / (1 - cse)) AS lse, ln(csp / (1 - csp)) AS lsp, se * CASE WHEN abs(other) < 1e-10 THEN 0 ELSE (se - (1 - sp)) / other END AS afk2, ((tp + fp) / n) * ((tp + fn) / n) + ((tn + fn) / n) * ((tn + fp) / n) AS pe FROM c),
f AS (SELECT threshold, """ + ", ".join(f"{v} AS {n}" for n, v in {
    "sensitivity": "se", "specificity": "sp", "prevalence": "prev", "accuracy": "acc", "err_rate": "err", "other": "other", "pm": "pm", "pm_prime": "pm2", "precision": "pr", "recall": "se", "tpr": "se", "tnr": "sp", "power": "se", "ppv": "pr", "npv": "npv", "fpr": "1 - sp", "fnr": "1 - se", "for_rate": "fom", "fdr": "fdr",
    "f_measure": "CASE WHEN pr + se = 0 THEN 0 ELSE 2 * pr * se / (pr + se) END", "geo_mean": "CASE WHEN tp > 0 AND tn > 0 THEN sqrt(tp * tn) ELSE 0 END", "mae": "err", "brier": "err", "rmse": "sqrt(err)", "lrp": "lrp", "indicative": "lrp", "log_lrp": "CASE WHEN lrp > 0 THEN log10(lrp) ELSE 0 END", "lrn": "lrn", "kg": "kg", "kg2": "kg2",
    "dor": "dor", "log_dor": "CASE WHEN dor > 0 THEN log10(dor) ELSE 0 END", "d": "lse - lsp", "s": "lse + lsp", "kappa": "CASE WHEN n = 0 THEN 0 WHEN pe = 1 THEN CASE WHEN acc = 1 THEN 1 ELSE 0 END ELSE (acc - pe) / (1 - pe) END", "opp_precision": "CASE WHEN se + sp = 0 THEN 0 ELSE acc - abs(sp - se) / (sp + se) END",
    "mcc": "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END", "informedness": "se + sp - 1", "markedness": "pr + npv - 1", "afk": "CASE WHEN afk2 < 0 THEN 0 ELSE sqrt(abs(afk2)) END", "indicative2": "ind2",
    "indicative_norm": "CASE WHEN abs(other) < 1e-10 THEN 0 ELSE lrp / other END", "indicative_norm2": "CASE WHEN abs(other) < 1e-10 THEN 0 ELSE ind2 / other END", "x1": "CASE WHEN abs(prev) < 1e-10 THEN 0 ELSE pr / prev END", "ppg": "CASE WHEN abs(prev) < 1e-10 THEN 0 ELSE pr / prev END", "x2": "CASE WHEN abs(prev) < 1e-10 THEN 0 ELSE fom / prev END",
    "npg": "CASE WHEN abs(prev) < 1e-10 THEN 0 ELSE fom / prev END", "x3": "CASE WHEN abs(other) < 1e-10 THEN 0 ELSE fdr / other END", "x4": "CASE WHEN abs(other) < 1e-10 THEN 0 ELSE npv / other END", "balance": "(kg + CASE WHEN sp > 0 THEN 1 - (1 - se) / sp ELSE 0 END) / 2",
    "balance2": "(CASE WHEN se > 0 THEN 1 - pm / se ELSE 0 END + CASE WHEN pm2 > 0 THEN 1 - (1 - se) / pm2 ELSE 0 END) / 2"}.items()) + """ FROM e)
SELECT threshold, round(COLUMNS(* EXCLUDE threshold)::DOUBLE, 6) + 0 FROM f""")
def metrics_51(spark, d):
    return m.metrics(m.confusion(scored(spark, d), _T5))


_BY = "WITH " + SCORED + ", g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1), s AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g), tot AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM g)"


@query(_BY + "SELECT round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc FROM s")
def roc_auc(spark, d):
    return m.roc_auc(scored(spark, d))


@query(_BY + "SELECT round(sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE, 6) AS average_precision FROM s")
def average_precision(spark, d):
    return m.average_precision(scored(spark, d))


@query(_BY + "SELECT score AS threshold, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM s, tot")
def roc_curve(spark, d):
    return m.roc_curve(scored(spark, d))


@query("WITH " + SCORED + """, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0::DOUBLE AS b FROM scored) SELECT round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark, d):
    return m.spearman(scored(spark, d), "score", "other")


_BOYCE = "WITH " + SCORED + """, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM scored), bb AS (
  SELECT len(list_filter(e[2:len(e) - 1], lambda v: v < score)) AS bin, count(*) FILTER (label = 1) AS presences, count(*) FILTER (label = 0) AS backgrounds, avg(score) AS centre FROM scored, e WHERE len(e) >= 4 GROUP BY 1),
tot AS (SELECT sum(presences)::DOUBLE AS p, sum(backgrounds)::DOUBLE AS n FROM bb), r AS (SELECT bb.*, CASE WHEN backgrounds > 0 THEN (presences / p) / (backgrounds / n) END AS ratio FROM bb, tot)"""
_RANKED = ", k AS (SELECT rank() OVER (ORDER BY centre) + (count(*) OVER (PARTITION BY centre) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0::DOUBLE AS b FROM r WHERE ratio IS NOT NULL)"


@query(_BOYCE + "SELECT bin::INT AS bin, presences, backgrounds, round(centre, 6) AS centre, round(ratio, 6) AS ratio FROM r")
def boyce_bins(spark, d):
    return m.boyce_bins(scored(spark, d))


@query(_BOYCE + _RANKED + "SELECT round(corr(a, b), 6) AS boyce FROM k")
def boyce_quantile(spark, d):
    return m.boyce_index(scored(spark, d))


@query("WITH " + SCORED + """, sp AS (SELECT min(score) lo, max(score) hi, count(*) FILTER (label = 1)::DOUBLE p, count(*) FILTER (label = 0)::DOUBLE n FROM scored),
w AS (SELECT p, n, lo + i * ((hi - lo) * 0.9::DOUBLE / 19.0::DOUBLE) AS s, lo + i * ((hi - lo) * 0.9::DOUBLE / 19.0::DOUBLE) + (hi - lo) * 0.1::DOUBLE AS e FROM sp, range(20) t(i)),
c AS (SELECT s, e, p, n, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM w JOIN scored ON score >= s AND score < e GROUP BY ALL), r AS (SELECT (s + e) / 2 AS centre, (a / p) / (b / n) AS ratio FROM c WHERE b > 0)""" + _RANKED + "SELECT round(corr(a, b), 6) AS cbi FROM k")
def boyce_continuous(spark, d):
    return m.continuous_boyce(scored(spark, d))


@query(_BOYCE + _RANKED + """, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1), s AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)
SELECT round((SELECT sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) FROM s), 6) AS auc, round((SELECT sum(pos::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / sum(pos)::DOUBLE FROM s), 6) AS pr_auc, round((SELECT corr(a, b) FROM k), 6) AS boyce,
round((SELECT avg(label) FROM scored WHERE score >= (SELECT quantile_cont(score, 0.95) FROM scored)) / (SELECT avg(label) FROM scored), 6) AS top_5_percent_lift, round((SELECT avg(score) FROM scored WHERE label = 1) - (SELECT avg(score) FROM scored WHERE label = 0), 6) AS score_separation""")
def pb_metrics(spark, d):
    return m.presence_background(scored(spark, d))


@query("WITH " + SCORED + "SELECT id, round(row_number() OVER w / (SELECT count(*) FROM scored)::DOUBLE, 6) AS area, round(sum(label) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) / (SELECT sum(label) FROM scored)::DOUBLE, 6) AS capture FROM scored WINDOW w AS (ORDER BY score DESC, id)")
def capture_curve(spark, d):
    return m.capture_curve(scored(spark, d), "id")


@query("WITH " + SCORED + """, a AS (SELECT a, (SELECT quantile_cont(score, 1 - a) FROM scored) AS t FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.33::DOUBLE)) v(a)),
c AS (SELECT a, t, sum(CASE WHEN score >= t THEN label ELSE 0 END)::DOUBLE / sum(label) AS capture FROM a, scored GROUP BY ALL)
SELECT a AS area, round(t, 6) AS threshold, round(capture, 6) AS capture, round(1 - a / nullif(capture, 0), 6) AS gain, round(nullif(capture, 0) / a, 6) AS lift FROM c""".replace("(SELECT quantile_cont(score, 1 - a) FROM scored)", "CASE a WHEN 0.05 THEN (SELECT quantile_cont(score, 0.95) FROM scored) WHEN 0.1 THEN (SELECT quantile_cont(score, 0.9) FROM scored) WHEN 0.2 THEN (SELECT quantile_cont(score, 0.8) FROM scored) ELSE (SELECT quantile_cont(score, 0.67) FROM scored) END"))
def capture_gain_table(spark, d):
    return m.capture_gain(scored(spark, d), [0.05, 0.1, 0.2, 0.33])


@query("WITH " + SCORED + "SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS observed FROM scored GROUP BY 1")
def reliability_curve(spark, d):
    return m.reliability(scored(spark, d))


@query(_BY + ", c AS (SELECT score AS t, tp, fp FROM s WHERE score > 0 AND score <> 1 UNION ALL SELECT 0, p, n FROM tot UNION ALL SELECT 1, count(*) FILTER (score >= 1 AND label = 1), count(*) FILTER (score >= 1 AND label = 0) FROM scored) SELECT t::DOUBLE AS threshold, round(tp / p - fp / n, 6) AS value FROM c, tot ORDER BY tp / p - fp / n DESC, t LIMIT 1")
def optimal_threshold(spark, d):
    return m.optimal_threshold(scored(spark, d))


@query("WITH " + SCORED + """, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS i, count(*) OVER () AS n FROM scored)
SELECT f::DOUBLE AS fraction, round(avg(label) / (SELECT avg(label) FROM scored), 6) AS lift FROM r, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(f) WHERE i <= greatest(1, ceil(f * n)) GROUP BY f""")
def cumulative_lift(spark, d):
    return m.cumulative_lift(scored(spark, d), "id", [0.05, 0.1, 0.25, 0.5, 1.0])


@query("WITH " + SCORED + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS ia, row_number() OVER (ORDER BY other DESC, id) AS ib, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0::DOUBLE AS rb, greatest(1, ceil(count(*) OVER () * 0.05::DOUBLE)) AS k FROM scored)
SELECT round(avg(abs(score - other)), 6) AS mae, round(corr(score, other), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(count(*) FILTER (ia <= k AND ib <= k) / max(k)::DOUBLE, 6) AS top_overlap FROM r""")
def score_agreement(spark, d):
    return m.score_agreement(scored(spark, d), "id", "score", "other")


_METHODS = "WITH " + SCORED + ", a AS (SELECT method, repeat, avg(score) AS v FROM scored GROUP BY ALL)"


@query(_METHODS + """, p AS (SELECT a.method, a.v - b.v AS d FROM a JOIN a b ON a.repeat = b.repeat AND b.method = 'BUILDING' WHERE a.method <> 'BUILDING')
SELECT method, count(d) AS pairs, round(avg(d), 6) AS mean_difference, round(stddev_samp(d) / sqrt(count(d)), 6) AS standard_error, round(avg(d) - 1.96 * (stddev_samp(d) / sqrt(count(d))), 6) AS ci_low, round(avg(d) + 1.96 * (stddev_samp(d) / sqrt(count(d))), 6) AS ci_high FROM p GROUP BY 1""")
def paired_differences(spark, d):
    a = scored(spark, d).groupBy("method", "repeat").agg(F.avg("score").alias("v"))
    return m.paired_differences(a, "BUILDING", ["repeat"], "v")


@query(_METHODS + f"SELECT method, count(v) AS n, round(avg(v), 6) AS mean, round(avg(v) - {m.student_t_quantile(0.975, 3)!r}::DOUBLE * stddev_samp(v) / sqrt(count(v)), 6) AS ci_low, round(avg(v) + {m.student_t_quantile(0.975, 3)!r}::DOUBLE * stddev_samp(v) / sqrt(count(v)), 6) AS ci_high FROM a GROUP BY 1")
def replicate_summary(spark, d):
    return m.replicate_summary(scored(spark, d).groupBy("method", "repeat").agg(F.avg("score").alias("v")), "v", "method", 4)


# ---- folds and result tables


def _bag_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("bag_id"), (F.col("s_acctbal") >= 5000).cast("int").alias("label"), F.col("s_nationkey").alias("group_id"))


_BAGS = "WITH bags AS (SELECT s_suppkey AS bag_id, (s_acctbal >= 5000)::INT AS label, s_nationkey AS group_id FROM supplier)"


@query(_BAGS + ", r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || bag_id), bag_id) AS rn FROM bags) SELECT bag_id, label, CASE WHEN rn <= CASE WHEN n > 1 THEN greatest(1, least(n - 1, round_even(n * 0.2::DOUBLE, 0))) ELSE 0 END THEN 'test' ELSE 'train' END AS role FROM r")
def train_test_split(spark, d):
    return bags.stratified_split(_bag_labels(spark, d).select("bag_id", "label"), 0.2, 42)


_PLAN = _BAGS + ", plan AS (SELECT repeat, ((row_number() OVER (PARTITION BY repeat, label ORDER BY md5((42 + repeat) || ':' || bag_id), bag_id) - 1) % 5)::INT AS fold, bag_id FROM bags, range(2) t(repeat))"


@query(_PLAN + "SELECT repeat::INT AS repeat, fold, bag_id FROM plan")
def stratified_folds(spark, d):
    return folds.fold_plan(_bag_labels(spark, d), 5, 2, 42)


@query(_PLAN + ", c AS (SELECT repeat, fold, count(DISTINCT label) AS k FROM plan JOIN bags USING (bag_id) GROUP BY ALL) SELECT repeat::INT AS repeat, count(DISTINCT bag_id) AS tested, count(*) - count(DISTINCT bag_id) AS repeated, (SELECT count(*) FROM c WHERE c.repeat = plan.repeat AND k < 2) AS one_class_folds FROM plan GROUP BY repeat")
def fold_coverage(spark, d):
    b = _bag_labels(spark, d)
    return folds.coverage(folds.fold_plan(b, 5, 2, 42), b)


@query(_BAGS + ", gr AS (SELECT group_id, row_number() OVER (ORDER BY count(*) DESC, md5('42:' || group_id)) - 1 AS r FROM bags GROUP BY 1) SELECT CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END::INT AS fold, bag_id, group_id FROM bags JOIN gr USING (group_id)")
def group_folds(spark, d):
    return folds.group_fold_plan(_bag_labels(spark, d), 5, 42)


@query(_BAGS + ", u AS (SELECT bag_id, ('0x' || substr(md5('42:' || bag_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u FROM bags) SELECT bag_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'holdout' ELSE 'train' END AS part FROM u")
def three_way_partition(spark, d):
    return bags.three_way(_bag_labels(spark, d).select("bag_id"), 0.2, 0.1, 42)


_FOLD_ROWS = "WITH " + SCORED + """, g AS (SELECT method, repeat, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY ALL), s AS (SELECT *, sum(pos) OVER (PARTITION BY method, repeat ORDER BY score DESC) AS tp FROM g),
a AS (SELECT method, repeat AS fold, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0) AS auc FROM s GROUP BY ALL), f AS (SELECT a.*, b.mean_score FROM a JOIN (SELECT method, repeat AS fold, avg(score) AS mean_score FROM scored GROUP BY ALL) b USING (method, fold))"""


def _fold_rows(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    auc = m.roc_auc(s, ["method", "repeat"])
    return auc.join(s.groupBy("method", "repeat").agg(F.avg("score").alias("mean_score")), ["method", "repeat"]).withColumnRenamed("repeat", "fold")


@query(_FOLD_ROWS + "SELECT method, fold, round(auc, 6) AS auc, round(mean_score, 6) AS mean_score FROM f")
def oof_pooled(spark, d):
    return _fold_rows(spark, d)


@query(_FOLD_ROWS + "SELECT method, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, round(avg(mean_score), 6) AS mean_mean_score, round(stddev_pop(mean_score), 6) AS std_mean_score, arg_max(fold, auc) AS best_fold FROM f GROUP BY 1")
def cv_aggregate(spark, d):
    return folds.aggregate_folds(_fold_rows(spark, d), ["auc", "mean_score"], ["method"])


@query(_FOLD_ROWS + "SELECT method, fold, 'auc' AS metric, round(auc, 6) AS value FROM f UNION ALL SELECT method, fold, 'mean_score', round(mean_score, 6) FROM f")
def melt_metrics(spark, d):
    return _fold_rows(spark, d).unpivot(["method", "fold"], ["auc", "mean_score"], "metric", "value")


@query(_FOLD_ROWS + "SELECT method, " + ", ".join(f"round(max(CASE WHEN fold = {i} THEN auc END), 6) AS fold_{i}" for i in range(4)) + " FROM f GROUP BY 1")
def pivot_auc(spark, d):
    p = _fold_rows(spark, d).groupBy("method").pivot("fold", [0, 1, 2, 3]).agg(F.max("auc"))
    return p.select("method", *[F.col(str(i)).alias(f"fold_{i}") for i in range(4)])


@query(_FOLD_ROWS + "SELECT method, count(*) AS folds, count(DISTINCT fold) AS distinct_folds, round(median(auc), 6) AS median_auc, round(stddev_samp(auc), 6) AS sd_auc, round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc, round(avg((auc IS NOT NULL)::INT), 6) AS available, count(*) FILTER (auc > 0.5) AS above_chance FROM f GROUP BY 1")
def case_condition_summary(spark, d):
    return _fold_rows(spark, d).groupBy("method").agg(
        F.count(F.lit(1)).alias("folds"), F.countDistinct("fold").alias("distinct_folds"), F.percentile("auc", F.lit(0.5)).alias("median_auc"), F.stddev_samp("auc").alias("sd_auc"), F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"),
        F.avg(F.col("auc").isNotNull().cast("int")).alias("available"), F.count_if(F.col("auc") > 0.5).alias("above_chance"),
    )
