"""Bags from tables, points, shapes and rasters. What is random is ordered by md5 of seed and id."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabag.functions.expressions import hash_key, hash_uniform
from terrabag.storage import materialize

from . import grid as g
from .bags import cap


# ---- rows and bags


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose given columns are neither null nor NaN; infinities stay."""
    kinds, ok = dict(df.dtypes), F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
    return df.filter(ok)


def subset(bags: DataFrame, positions: Sequence[int], order: str = "bag_ord") -> DataFrame:
    """The bags at the given positions, with `position`, their place in the list; a position asked for twice comes twice."""
    asked = bags.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(positions)], f"`{order}` long, position int")
    return bags.join(F.broadcast(asked), order)  # as long as the caller's list


def site_ids(bags: DataFrame, prefix: str = "site_") -> DataFrame:
    """(site_id): ids of positive bags without their prefix, each once."""
    return bags.filter((F.col("label") == 1) & F.col("bag_id").startswith(prefix)).select(F.substring("bag_id", F.lit(len(prefix) + 1), F.length("bag_id")).alias("site_id")).distinct()


def within_sizes(cells: DataFrame, low: int, high: int, seed: int) -> DataFrame:
    """Bags of `low` cells or more, cut to `high` random ones."""
    n = F.count(F.lit(1)).over(Window.partitionBy("bag_id"))
    return cap(cells.withColumn("__n", n).filter(F.col("__n") >= low).drop("__n"), "bag_id", "cell_id", high, seed)


def bags_from_table(rows: DataFrame, features: Sequence[str], presence: str = "presence", site: str = "SITENO", cell: str = "cell_id", background: str = "random", xy: tuple[str, str] = ("x", "y"), n_background: int | None = None, background_size: int | None = None, bag_cap: int = 120, min_bag: int = 3, seed: int = 42) -> DataFrame:
    """Cells (bag_id, cell_id, label, features) of site bags and background bags.

    Rows with a null or NaN in what is needed go, infinities stay. A site's presence rows are a bag site_<id>, cut to bag_cap random
    cells; bags under min_bag go. background 'random': absence rows are dealt at random into n_background bags (as many as there are
    site bags, 2 at least), cut likewise. 'spatial': patches of the nearest absence rows around random ones; background_size of them,
    the median site size if not given, at most bag_cap; raises if there are fewer absence rows than that or than min_bag.
    """
    if background not in ("random", "spatial"):
        raise ValueError("background must be 'random' or 'spatial'")
    vector = F.array(*[F.col(f).cast("double") for f in features]).alias("features")
    sites = drop_missing(rows, [presence, site, *features]).filter(F.col(presence) == 1)
    sites = sites.select(F.concat(F.lit("site_"), F.col(site).cast("string")).alias("bag_id"), F.col(cell).alias("cell_id"), F.lit(1).alias("label"), vector)
    sites = within_sizes(sites, min_bag, bag_cap, seed)
    sizes = sites.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("bags"), F.percentile("n", F.lit(0.5)).alias("median")).first()
    n = n_background or max(2, sizes.bags)
    if background == "random":
        held = drop_missing(rows, [*features, presence]).filter(F.col(presence) == 0).select(F.col(cell).alias("cell_id"), vector)
        held = held.withColumn("bag_id", F.concat(F.lit("background_"), F.floor(hash_uniform(seed, "cell_id") * n).cast("string"))).withColumn("label", F.lit(0))
        return sites.unionByName(within_sizes(held, min_bag, bag_cap, seed))
    size = min(int(background_size or sizes.median or bag_cap), bag_cap)
    held = drop_missing(rows, [*xy, *features, presence]).filter(F.col(presence) == 0).select(F.col(cell).alias("cell_id"), F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y"), vector)
    if held.limit(max(min_bag, size)).count() < max(min_bag, size):
        raise ValueError("not enough background cells for spatial bags")
    seeds = held.withColumn("__k", hash_key(seed, "cell_id")).orderBy("__k", "cell_id").limit(n).select(F.col("cell_id").alias("centre_id"), "x", "y")
    near = g.nearest_cells(held, seeds, size).join(held.select("cell_id", "features"), "cell_id")
    near = near.select(F.concat(F.lit("background_"), F.col("centre_id").cast("string")).alias("bag_id"), "cell_id", F.lit(0).alias("label"), "features")
    return sites.unionByName(near if size >= min_bag else near.limit(0))


def site_table(rows: DataFrame, features: Sequence[str], presence: str = "presence", site: str = "SITENO", n_sites: int | None = None, test_share: float = 0.2, background_share: float = 1.0, cell: str = "cell_id", seed: int = 42) -> DataFrame:
    """Cells (bag_id, cell_id, label, features, part) in the older format of site tables.

    Features are z-scored over all rows (sample deviation). n_sites random sites are kept; test_share of them are the test part, whose
    rows are bags of their own. As many background rows as background_share of the site rows are drawn and dealt into as many bags as
    there are training sites.
    """
    from .stats import column_scaling

    scale = column_scaling(rows, list(features), sample=True).first()
    vector = F.array(*[(F.col(f).cast("double") - scale[f"mean_{f}"]) / scale[f"std_{f}"] for f in features]).alias("features")
    held = rows.select(F.col(presence).cast("int").alias("label"), F.col(site).cast("string").alias("site"), F.col(cell).alias("cell_id"), vector)
    ids = held.filter("label = 1").select("site").distinct().withColumn("__k", hash_key(seed, "site"))
    ids = ids.orderBy("__k", "site").limit(n_sites) if n_sites else ids
    ids = ids.select("site", F.when(hash_uniform(seed + 1, "site") < test_share, "test").otherwise("train").alias("part"))
    sites = held.filter("label = 1").join(ids, "site")
    size = sites.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("part") == "train", F.col("site"))).alias("bags")).first()
    wanted, bags_ = max(1, round(size.n * background_share)), max(1, size.bags)
    back = held.filter("label = 0").withColumn("__k", hash_key(seed, "cell_id")).orderBy("__k", "cell_id").limit(wanted)
    back = back.withColumn("part", F.when(hash_uniform(seed + 1, "cell_id") < test_share, "test").otherwise("train")).withColumn("site", F.concat(F.lit("background_"), F.floor(hash_uniform(seed + 2, "cell_id") * bags_).cast("string")))
    every = sites.select("label", "site", "cell_id", "features", "part").unionByName(back.select("label", "site", "cell_id", "features", "part"))
    alone = F.concat_ws("_", F.lit("test"), "site", F.col("cell_id").cast("string"))
    return every.select(F.when(F.col("part") == "test", alone).otherwise(F.col("site")).alias("bag_id"), "cell_id", "label", "features", "part")


# ---- points and shapes


def within(cells: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """cells with point_id of every point (point_id, x, y) at a distance of `reach` at most; an equi-join on square buckets."""
    met = g._met(cells, points.select(F.col("point_id").alias("centre_id"), "x", "y"), max(reach, 1e-9), 1)
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    return met.filter(d2 <= F.lit(float(reach) ** 2)).withColumnRenamed("centre_id", "point_id").select("point_id", *cells.columns)


def outside(points: DataFrame, exclusions: DataFrame, reach: float, key: str = "point_id") -> DataFrame:
    """Points that aren't within `reach` of any exclusion (x, y). Buffers are discs."""
    far = exclusions.select(F.monotonically_increasing_id().alias("point_id"), "x", "y")
    hit = within(points.select(F.col(key).alias("__key"), "x", "y"), far, reach).select("__key").distinct()
    return points.join(hit, F.col(key) == F.col("__key"), "left_anti")


def cells_in_buffers(cells: DataFrame, points: DataFrame, reach: float, n: int, seed: int) -> DataFrame:
    """n random cells within `reach` of each point; raises if a point has fewer."""
    got = within(cells, points, reach)
    short = points.select("point_id").join(got.groupBy("point_id").count(), "point_id", "left").filter(F.coalesce("count", F.lit(0)) < n).select("point_id").take(1)
    if short:
        raise ValueError(f"fewer than {n} cells around point {short[0][0]!r}")
    return cap(got, "point_id", "cell_id", n, seed)


def background_points(spark, box: tuple[float, float, float, float], n: int, seed: int, exclusions: DataFrame | None = None, reach: float = 0.0, attempts: int = 10) -> DataFrame:
    """(point_id, x, y): the first n of attempts * n uniform draws in the box (x0, y0, x1, y1) that no exclusion reaches; fewer if they run
    out, as the number of draws is the operator's own limit."""
    x0, y0, x1, y1 = box
    drawn = spark.range(n * attempts).select(F.col("id").alias("point_id"), (hash_uniform(seed, F.lit("x"), "id") * (x1 - x0) + x0).alias("x"), (hash_uniform(seed, F.lit("y"), "id") * (y1 - y0) + y0).alias("y"))
    return (drawn if exclusions is None else outside(drawn, exclusions, reach)).orderBy("point_id").limit(n)


def points_in_sites(sites: DataFrame, n: int, seed: int, attempts: int = 100) -> DataFrame:
    """(site_id, i, x, y): n points in each polygon (site_id, ring): uniform draws in its box that fall inside, and where too few do, places
    of a regular lattice over the box that lie inside, in order, over again if need be."""
    px, py = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = sites.select("site_id", "ring", F.array_min(px).alias("x0"), F.array_max(px).alias("x1"), F.array_min(py).alias("y0"), F.array_max(py).alias("y1"))
    draw = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(n * attempts - 1))).alias("t"))
    u = lambda tag: hash_uniform(seed, F.lit(tag), "site_id", "t")
    draw = draw.select("site_id", "ring", F.col("t"), (F.col("x0") + u("x") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + u("y") * (F.col("y1") - F.col("y0"))).alias("y"))
    side = max(2, math.ceil(math.sqrt(4 * n)))
    cell = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("t"))
    cell = cell.select("site_id", "ring", (F.lit(n * attempts) + F.col("t")).alias("t"), (F.col("x0") + (F.col("t") % side + 0.5) / side * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + (F.floor(F.col("t") / side) + 0.5) / side * (F.col("y1") - F.col("y0"))).alias("y"))
    inside = draw.unionByName(cell).filter(g.in_ring("x", "y", "ring"))
    got = inside.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("p"))  # n * attempts and the lattice at most
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.element_at("p", (i % F.size("p")) + 1).alias("p")))
    return got.select("site_id", F.explode(places).alias("o")).select("site_id", "o.i", "o.p.x", "o.p.y")


def distributions_at_points(grid: DataFrame, points: DataFrame, n: int, seed: int, label: int, first_radius: int = 4) -> DataFrame:
    """Cells (bag_id, cell_id, label, features, row, col): n cells of the least square around each point (point_id, row, col) with n valid
    cells; with replacement where the whole grid has fewer, and no bag where it has none."""
    grown = g.grow_points(points, grid, n, first_radius)
    reach = grown.join(points, "point_id")
    step = lambda c: F.explode(F.sequence(F.col(c) - F.col("radius"), F.col(c) + F.col("radius")))
    near = reach.select("point_id", "cells", "radius", step("row").alias("r"), "col").select("point_id", "cells", "r", step("col").alias("c"))
    held = grid.filter("valid").select(F.col("row").alias("r"), F.col("col").alias("c"), "bands")
    pick = F.row_number().over(Window.partitionBy("point_id").orderBy(hash_key(seed, "point_id", "r", "c"), "r", "c")) - 1
    ranked = near.join(held, ["r", "c"]).withColumn("i", pick).filter(F.col("i") < n)
    again = F.when(F.col("cells") < n, F.sequence(F.col("i").cast("long"), F.lit(n - 1).cast("long"), F.col("cells"))).otherwise(F.array(F.col("i").cast("long")))
    out = ranked.select("point_id", F.explode(again).alias("cell_id"), F.col("bands").alias("features"), F.col("r").alias("row"), F.col("c").alias("col"))
    return out.select(F.concat(F.lit("location_"), F.col("point_id").cast("string")).alias("bag_id"), "cell_id", F.lit(label).alias("label"), "features", "row", "col")


def geometry_cells(grid: DataFrame, sites: DataFrame, window: int | None = None, reach: float | None = None) -> DataFrame:
    """(site_id, row, col, bands) of the valid cells of each site (site_id, geom_type, x, y, ring; points with row and col too).

    A polygon has the cells whose centre it covers. A point has those of a window of `window` cells a side around its own, cut at the edges,
    or those within `reach`; without either that raises, and so does a site without any valid cell.
    """
    points, polygons = sites.filter("geom_type = 'Point'"), sites.filter("geom_type != 'Point'")
    if window is None and reach is None and not points.isEmpty():
        raise ValueError("a point needs a window or a reach")
    out = g.cover(grid, polygons.select("site_id", "ring"))
    if window is not None:
        step = lambda c: F.explode(F.sequence(F.col(c) - window // 2, F.col(c) - window // 2 + window - 1))
        asked = points.select("site_id", step("row").alias("row"), "col").select("site_id", "row", step("col").alias("col"))
        out = out.unionByName(asked.join(grid.filter("valid").select("row", "col", "bands"), ["row", "col"]).select("site_id", "row", "col", "bands"))
    elif reach is not None:
        hit = within(grid.filter("valid").select("row", "col", "bands", "x", "y"), points.select(F.col("site_id").alias("point_id"), "x", "y"), reach)
        out = out.unionByName(hit.select(F.col("point_id").alias("site_id"), "row", "col", "bands"))
    empty = sites.select("site_id").join(out.select("site_id").distinct(), "site_id", "left_anti").take(1)
    if empty:
        raise ValueError(f"site {empty[0][0]!r} has no valid cells")
    return out


# ---- background of the sites' sizes


def matched_background(grid: DataFrame, occupied: DataFrame, sizes: DataFrame, n: int, seed: int, exact: bool = False, bag_cap: int = 120) -> DataFrame:
    """Cells (bag_id, cell_id, label, features, row, col) of n background bags whose sizes follow those of the sites (bag_id, n).

    Sizes are drawn from the site sizes, cut to bag_cap, with replacement, or with `exact` as a permutation of them, which needs as many
    bags as sites. The bags are the nearest free cells around random free anchors: never occupied ones (row, col), but bags may overlap.
    Raises if there are too few anchors or free cells.
    """
    free = grid.filter("valid").join(occupied.select("row", "col").distinct(), ["row", "col"], "left_anti")
    site = sizes.select("bag_id", F.least("n", F.lit(bag_cap)).alias("n"))
    count = site.count()
    if exact and n != count:
        raise ValueError(f"exact sizes need as many background bags as there are sites: {count}, not {n}")
    number = lambda df, *by: df.withColumn("i", F.row_number().over(Window.orderBy(*by)) - 1)  # noqa: E731  one row a bag
    if exact:
        want = number(site, hash_key(seed, "bag_id"), "bag_id").select("i", F.col("n").alias("size"))
    else:
        draws = grid.sparkSession.range(n).select(F.col("id").cast("int").alias("slot"), F.floor(hash_uniform(seed, F.lit("size"), "id") * count).cast("int").alias("i"))
        want = draws.join(number(site, "bag_id"), "i").select(F.col("slot").alias("i"), F.col("n").alias("size"))
    placed = number(g.anchors(free.withColumn("valid", F.lit(True)), n, seed), "priority", "row", "col")
    placed = materialize(placed.join(want, "i").select(F.format_string("background-%05d", "i").alias("centre_id"), F.col("col").alias("x"), F.col("row").alias("y"), "size"), "anchors")
    most = placed.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).first()
    if most.n < n or free.limit(most.size).count() < most.size:
        raise RuntimeError(f"only {most.n} of {n} background bags fit, or too few free cells for the largest")
    near = g.nearest_cells(free.select(F.struct("row", "col").alias("cell_id"), F.col("col").alias("x"), F.col("row").alias("y")), placed.select("centre_id", "x", "y"), most.size)
    near = near.join(placed.select("centre_id", "size"), "centre_id").filter(F.col("rank") <= F.col("size"))
    return near.select(F.col("centre_id").alias("bag_id"), F.col("rank").cast("long").alias("cell_id"), F.lit(0).alias("label"), "cell_id.row", "cell_id.col").join(free.select("row", "col", F.col("bands").alias("features")), ["row", "col"])


def common_focal_bags(grid: DataFrame, sites: DataFrame, windows: Sequence[int], n_background: int, seed: int) -> DataFrame:
    """Cells (window, bag_id, label, row, col, features) of square windows of each size around the same site centres (bag_id, row, col) and the
    same background centres.

    A centre counts only if its largest window lies in the grid and is all valid. Background windows of the largest size meet neither the
    sites' nor each other's: candidates are taken in random order, n_background of them. Raises on a shortage.
    """
    size = max(windows)
    full = g.focal_cells(grid.filter("valid"), grid, size).filter("valid").groupBy("row", "col").count().filter(F.col("count") == size * size).select("row", "col")
    held = sites.select("bag_id", "row", "col").join(full, ["row", "col"])
    taken = [(r.row, r.col) for r in held.select("row", "col").collect()]  # one centre a site
    order = full.withColumn("k", hash_key(seed, "row", "col")).orderBy("k", "row", "col")
    apart = lambda p, q: max(abs(p[0] - q[0]), abs(p[1] - q[1])) >= size
    found: list[tuple[int, int]] = []
    for r in order.select("row", "col").toLocalIterator():  # stops when it has enough
        if all(apart((r.row, r.col), q) for q in (*taken, *found)):
            found.append((r.row, r.col))
            if len(found) == n_background:
                break
    if len(found) < n_background:
        raise RuntimeError(f"only {len(found)} of {n_background} background windows fit")
    back = grid.sparkSession.createDataFrame([(f"background-{i:05d}", a, b) for i, (a, b) in enumerate(found)], "bag_id string, row int, col int")
    centres = held.select("bag_id", "row", "col", F.lit(1).alias("label")).unionByName(back.withColumn("label", F.lit(0)))
    out = None
    for w in windows:
        one = _with_places(centres, grid, w).select(F.lit(w).alias("window"), "bag_id", "label", "row", "col", "features")
        out = one if out is None else out.unionByName(one)
    return out


def _with_places(centres: DataFrame, grid: DataFrame, size: int) -> DataFrame:
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in g.offsets(size)])).alias("o")
    c = centres.select("bag_id", "label", "row", "col", at).select("bag_id", "label", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    return c.join(grid.select("row", "col", F.col("bands").alias("features")), ["row", "col"])


def standardised(grid: DataFrame, means: Sequence[float], scales: Sequence[float], nodata: float | None = None) -> DataFrame:
    """grid with z-scored bands; values that are nodata stay as they are."""
    if len(means) != len(scales):
        raise ValueError("one mean and one scale a band")
    table = lambda v: F.array(*[F.lit(float(x)) for x in v])

    def scale(b: Column, i: Column) -> Column:
        z = (b - F.element_at(table(means), i + 1)) / F.element_at(table(scales), i + 1)
        return z if nodata is None else F.when(b == F.lit(float(nodata)), b).otherwise(z)

    return grid.withColumn("bands", F.transform("bands", scale))
