"""Queries of builders, surfaces and evaluation, with their DuckDB counterparts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terrabag.operators import builders, classifier as c, evaluation as ev, folds, grid as g, prediction, solvers

from .catalogue import query
from .views import CELLS, GRID, SCORED, cells, grid, people, scored, sql_round, table

_U = "('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE"


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE WHEN event_id % 17 = 0 THEN NULL ELSE round(value, 6) END AS value FROM events) WHERE value IS NOT NULL AND NOT isnan(value)")
def drop_missing_rows(spark, d):
    v = F.when(F.col("event_id") % 11 == 0, float("inf")).when(F.col("event_id") % 13 == 0, float("nan")).when(F.col("event_id") % 17 == 0, None).otherwise(sql_round(F.col("value")))
    return builders.drop_missing(table(spark, d, "events").select("event_id", v.alias("value")), ["value"])


@query("SELECT s.s_suppkey AS bag_ord, s_name AS bag_id, p.i::INT AS position FROM (VALUES (7, 0), (3, 1), (7, 2), (9, 3)) p(k, i) JOIN supplier s ON s.s_suppkey = p.k")
def subset_by_position(spark, d):
    return builders.subset(table(spark, d, "supplier").select(F.col("s_suppkey").alias("bag_ord"), F.col("s_name").alias("bag_id")), [7, 3, 7, 9])


@query("SELECT DISTINCT c_custkey::VARCHAR AS site_id FROM customer WHERE c_nationkey % 2 = 1 AND c_custkey % 3 <> 0")
def positive_site_ids(spark, d):
    b = table(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "background_").otherwise("site_"), F.col("c_custkey").cast("string")).alias("bag_id"), (F.col("c_nationkey") % 2).alias("label"))
    return builders.site_ids(b.unionByName(b))


_XY = "p AS (SELECT p_partkey AS cell_id, p_partkey * 37 % 1009 AS x, p_partkey * 101 % 997 AS y FROM part), s AS (SELECT s_suppkey AS point_id, s_suppkey * 37 % 1009 AS x, s_suppkey * 101 % 997 AS y FROM supplier)"


def _places(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), (F.col("p_partkey") * 37 % 1009).alias("x"), (F.col("p_partkey") * 101 % 997).alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") * 37 % 1009).alias("x"), (F.col("s_suppkey") * 101 % 997).alias("y"))
    return p, s


@query("WITH " + _XY + " SELECT point_id, cell_id, p.x, p.y FROM p JOIN s ON (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 400")
def cells_within_buffer(spark, d):
    p, s = _places(spark, d)
    return builders.within(p, s, 20.0)


@query("WITH " + _XY + " SELECT cell_id, p.x, p.y FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 225)")
def points_with_exclusions(spark, d):
    p, s = _places(spark, d)
    return builders.outside(p, s, 15.0, "cell_id")


@query("WITH " + _XY + ", t AS (SELECT id AS point_id, " + _U.format("'5:x:' || id") + " * 1000 AS x, " + _U.format("'5:y:' || id") + " * 900 AS y FROM range(2000) r(id)) SELECT point_id, round(x, 6) AS x, round(y, 6) AS y FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE (t.x - s.x) ** 2 + (t.y - s.y) ** 2 <= 100) ORDER BY point_id LIMIT 200")
def random_background_points(spark, d):
    return builders.background_points(spark, (0.0, 0.0, 1000.0, 900.0), 200, 5, _places(spark, d)[1], 10.0)


@query("WITH " + CELLS + ", n AS (SELECT bag_id, cell_id, count(*) OVER (PARTITION BY bag_id) AS n, row_number() OVER (PARTITION BY bag_id ORDER BY md5('3:' || bag_id || ':' || cell_id), cell_id) AS rn FROM cells) SELECT bag_id, cell_id FROM n WHERE n >= 590 AND rn <= 40")
def bag_size_range(spark, d):
    return builders.within_sizes(cells(spark, d).select("bag_id", "cell_id"), 590, 40, 3)


_TABLE = """t AS (SELECT c_custkey AS cell_id, (c_nationkey % 3 = 0)::INT AS presence, c_nationkey AS siteno, c_acctbal AS f0, c_custkey % 7 AS f1 FROM customer),
sc AS (SELECT 'site_' || siteno AS bag_id, cell_id, count(*) OVER (PARTITION BY siteno) AS n FROM t WHERE presence = 1),
st AS (SELECT bag_id, cell_id FROM sc WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('42:' || bag_id || ':' || cell_id), cell_id) <= 40),
nb AS (SELECT greatest(2, count(DISTINCT bag_id)) AS k FROM st)"""


@query("WITH " + _TABLE + ", bc AS (SELECT 'background_' || floor(" + _U.format("'42:' || cell_id") + " * k)::BIGINT AS bag_id, cell_id FROM t, nb WHERE presence = 0), bn AS (SELECT *, count(*) OVER (PARTITION BY bag_id) AS n FROM bc), "
    "b AS (SELECT bag_id, cell_id FROM bn WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY md5('42:' || bag_id || ':' || cell_id), cell_id) <= 40) SELECT bag_id, cell_id, 1 AS label FROM st UNION ALL SELECT bag_id, cell_id, 0 FROM b")
def bags_from_table(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_nationkey") % 3 == 0).cast("int").alias("presence"), F.col("c_nationkey").alias("SITENO"), F.col("c_acctbal").alias("f0"), (F.col("c_custkey") % 7).alias("f1"))
    return builders.bags_from_table(t, ["f0", "f1"], bag_cap=40).select("bag_id", "cell_id", "label")


@query()
def matched_background_bags(spark, d):
    taken = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.floor(F.col("l_partkey") / 40).cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"))
    sizes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bag_id"), (F.col("s_suppkey") % 9 + 3).alias("n")).filter("bag_id <= 10")
    return builders.matched_background(grid(spark, d), taken, sizes, sizes.count(), 3, exact=True).select("bag_id", "cell_id", "row", "col")


@query("WITH " + GRID + ', z AS (SELECT "row", col, CASE WHEN b0 = 7 THEN 7 ELSE (b0 - 25) / 14 END AS z0, (b1 - 1400) / 300 AS z1 FROM grid) SELECT "row", col, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM z')
def scaled_grid(spark, d):
    s = builders.standardised(grid(spark, d), [25.0, 1400.0], [14.0, 300.0], nodata=7.0)
    return s.select("row", "col", F.element_at("bands", 1).alias("z0"), F.element_at("bands", 2).alias("z1"))


# ---- surfaces of a model with fixed coefficients

_W = [[0.5, -0.25], [0.1, 0.4]]
_BETA = [0.8, -0.5, 0.3, 0.6]


def _fixed_model(spark) -> c.DistributionClassifier:
    model = c.DistributionClassifier(c.ModelSpec.m1(2), scale_features=False)
    model.width, model.sigma_, model.weights = 2, 1.0, np.array(_W)
    model.result = solvers.FitResult(np.array(_BETA), True, 1, 0.0)
    return model


def _score_sql(a: str, b: str) -> str:
    dots = [f"({a} * {w[0]!r}::DOUBLE + {b} * {w[1]!r}::DOUBLE)" for w in _W]
    return "sqrt(0.5::DOUBLE) * (" + " + ".join([f"cos({z}) * {_BETA[i]!r}::DOUBLE" for i, z in enumerate(dots)] + [f"sin({z}) * {_BETA[2 + i]!r}::DOUBLE" for i, z in enumerate(dots)]) + ")"


@query("WITH " + GRID + ', s AS (SELECT "row", col, valid, ' + _score_sql("b0 / 10", "b1 / 1000") + """ AS score FROM grid), o AS (SELECT g."row" AS r, g.col AS c, CASE WHEN g."row" + i < 0 THEN -(g."row" + i) WHEN g."row" + i >= h THEN 2 * (h - 1) - (g."row" + i) ELSE g."row" + i END AS "row",
CASE WHEN g.col + j < 0 THEN -(g.col + j) WHEN g.col + j >= w THEN 2 * (w - 1) - (g.col + j) ELSE g.col + j END AS col FROM grid g, ext, range(-1, 2) a(i), range(-1, 2) b(j)),
m AS (SELECT r, c, avg(score) AS eta FROM o JOIN s USING ("row", col) WHERE valid GROUP BY ALL) SELECT g."row", g.col, round(1 / (1 + exp(-eta)), 6) AS suitability FROM grid g LEFT JOIN m ON g."row" = r AND g.col = c""")
def focal_prediction(spark, d):
    held = grid(spark, d).withColumn("bands", F.array(F.element_at("bands", 1) / 10, F.element_at("bands", 2) / 1000))
    h, w = held.agg(F.max("row") + 1, F.max("col") + 1).first()
    out = prediction.predict_grid(_fixed_model(spark), held, 3, h, w)
    return held.select("row", "col").join(out, ["row", "col"], "left")


@query("WITH " + _XY + ", f AS (SELECT p_partkey AS cell_id, p_size / 10.0::DOUBLE AS a, p_retailprice / 1000.0::DOUBLE AS b FROM part), n AS (SELECT point_id AS centre_id, " + _score_sql("a", "b") + " AS score FROM p JOIN f USING (cell_id), s QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY (p.x - s.x) ** 2 + (p.y - s.y) ** 2, cell_id) <= 16) SELECT centre_id, round(1 / (1 + exp(-avg(score))), 6) AS suitability FROM n GROUP BY 1")
def model_xy_surface(spark, d):
    p, s = _places(spark, d)
    f = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), F.array((F.col("p_size") / 10.0).cast("double"), F.col("p_retailprice") / 1000.0).alias("features"))
    return prediction.predict_surface(_fixed_model(spark), s.withColumnRenamed("point_id", "centre_id"), p.join(f, "cell_id"), 16)


def _focal(spark, d, spec):
    """A model fitted on bags of the grid's own cells, and its surface of windows of 3 cells a side."""
    held = grid(spark, d)
    train = g.strided_bags(held, 5, 3).select((F.col("row").cast("long") * 40 + F.col("col")).alias("bag_id"), F.monotonically_increasing_id().alias("cell_id"), (F.col("row") % 2).alias("label"), F.col("bands").alias("features"))
    h, w = held.agg(F.max("row") + 1, F.max("col") + 1).first()
    return prediction.predict_grid(c.DistributionClassifier(spec).fit(train), held, 3, h, w)


@query()
def focal_mean_embedding(spark, d):
    return _focal(spark, d, c.ModelSpec.m2(16))


@query()
def focal_wasserstein(spark, d):
    return _focal(spark, d, c.ModelSpec.m3(8, 8))


# ---- evaluation


@query("WITH " + SCORED + ", n AS (SELECT greatest(1, round_even(0.05 * count(*), 0)) AS k, avg(label) AS p FROM scored), t AS (SELECT label FROM scored, n QUALIFY row_number() OVER (ORDER BY score DESC, id) <= k) SELECT round(avg(label) / any_value(p), 6) AS lift FROM t, n")
def bag_lift(spark, d):
    return ev.bag_lift(scored(spark, d), "id")


@query("WITH " + SCORED + ", g AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY 1), r AS (SELECT threshold, sum(p) OVER w / (SELECT sum(label) FROM scored)::DOUBLE AS tpr, sum(n) OVER w / (SELECT sum(1 - label) FROM scored)::DOUBLE AS fpr FROM g WINDOW w AS (ORDER BY threshold DESC)) SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr - fpr, 6) AS youden FROM r ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1")
def youden_threshold(spark, d):
    return ev.youden(scored(spark, d))


@query("WITH " + SCORED + " SELECT round(corr(score, other), 6) AS correlation FROM scored")
def safe_correlation(spark, d):
    return ev.safe_correlation(scored(spark, d), "score", "other")


@query("WITH " + SCORED + ", q AS (SELECT repeat AS fold, count(*) FILTER (score >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (score < 0.5 AND label = 0)::DOUBLE AS tn, count(*) FILTER (score >= 0.5 AND label = 0)::DOUBLE AS fp, count(*) FILTER (score < 0.5 AND label = 1)::DOUBLE AS fn FROM scored GROUP BY 1) "
    "SELECT fold, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS sensitivity, round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM q")
def metrics_by_fold(spark, d):
    return ev.fold_metrics(scored(spark, d).withColumnRenamed("repeat", "fold")).select("fold", "sensitivity", "specificity", "accuracy")


_PLAN = """l AS (SELECT c_nationkey::BIGINT AS bag_id, (c_nationkey % 2)::INT AS label FROM customer GROUP BY ALL), pl AS (SELECT bag_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || bag_id), bag_id) - 1) % 5)::INT AS fold FROM l)"""


@query("WITH " + _PLAN + ", r AS (SELECT a.f AS fold, (fold = a.f) AS test, count(DISTINCT label) AS k FROM pl, range(5) a(f) GROUP BY ALL) SELECT 0 AS repeat, fold::INT AS fold FROM r GROUP BY fold HAVING count(*) FILTER (k = 2) = 2")
def two_sided_folds(spark, d):
    labelled = people(spark, d).groupBy("bag_id").agg(F.max("label").alias("label"))
    return ev.two_sided(folds.fold_plan(labelled, 5, 1, 42), labelled, 5)


@query("SELECT c_mktsegment AS method, count(*) AS pairs, round(avg(c_acctbal) / 10000, 6) AS mean_difference, round(min(c_acctbal) / 1e6 + 0.001, 6) AS ci_low FROM customer GROUP BY 1 HAVING count(*) >= 2 AND avg(c_acctbal) / 10000 > 0.02 AND min(c_acctbal) / 1e6 + 0.001 > 0")
def robust_gains(spark, d):
    r = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("method")).agg(F.count(F.lit(1)).alias("pairs"), (F.avg("c_acctbal") / 10000).alias("mean_difference"), (F.min("c_acctbal") / 1e6 + 0.001).alias("ci_low"))
    return ev.robust_gains(r)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS status FROM supplier")
def branch_status(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", ev.first_of([(F.col("s_acctbal") < 0, "debt"), (F.col("s_acctbal") < 5000, "low")], "high").alias("status"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def checked_merges(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    one = ev.checked_merge(table(spark, d, "customer"), n, ["c_nationkey"])
    return ev.checked_merge(one, table(spark, d, "region"), ["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("SELECT s_suppkey AS k, s_acctbal AS a, NULL::BIGINT AS b FROM supplier UNION ALL SELECT c_custkey, NULL, c_nationkey::BIGINT FROM customer")
def outer_union(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("a"))
    return ev.union_all([s, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("b"))])


@query("WITH o AS (SELECT n_nationkey AS bag_id, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS place FROM nation) SELECT a.place AS i, b.place AS j, (a.bag_id * 100 + b.bag_id)::DOUBLE AS value FROM o a, o b WHERE a.bag_id <= b.bag_id")
def reordered_matrix(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("bag_id"), F.col("n_regionkey").alias("cluster"))
    m = n.select(F.col("bag_id").alias("bag_i")).join(n.select(F.col("bag_id").alias("bag_j")), F.col("bag_i") <= F.col("bag_j")).withColumn("value", (F.col("bag_i") * 100 + F.col("bag_j")).cast("double"))
    out = ev.reordered(m, n)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value")


@query()
def heldout_m1(spark, d):
    return ev.heldout(c.DistributionClassifier(c.ModelSpec.m1(16)), people(spark, d))[0]


@query()
def model_invariances(spark, d):
    x = people(spark, d)
    return ev.invariances(c.DistributionClassifier(c.ModelSpec.m1(16)).fit(x), x).filter("transformation != 'duplicate_selected'")
