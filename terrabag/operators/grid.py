"""Gridded covariates: cells with bands, windows, focal joins, sampling at points, background bags.

grid has row, col, x, y, bands array<double>, valid; tiles are row div B and col div B, so that a window prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabag.functions.expressions import finite, hash_key, in_ring, reflect
from terrabag.storage import materialize


def valid_cell(bands: str = "bands", nodata: float | None = None) -> Column:
    """Whether all bands are finite and none is the nodata value."""
    ok = F.forall(bands, finite)
    return ok if nodata is None else ok & F.forall(bands, lambda b: b != nodata)


def with_tiles(grid: DataFrame, block: int = 512) -> DataFrame:
    """grid with tile_row and tile_col."""
    return grid.withColumn("tile_row", F.floor(F.col("row") / block).cast("int")).withColumn("tile_col", F.floor(F.col("col") / block).cast("int"))


def window(grid: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """Cells of a rectangle; literal bounds reach the scan."""
    return grid.filter(F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1))


def blocks(grid: DataFrame, size: int = 512) -> DataFrame:
    """Extent and valid cells of each block of the grid."""
    g = with_tiles(grid, size)
    return g.groupBy("tile_row", "tile_col").agg(F.min("row").alias("row_off"), F.min("col").alias("col_off"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), F.count_if("valid").alias("valid_cells"))


def sample_points(points: DataFrame, grid: DataFrame) -> DataFrame:
    """points (with row, col) with the bands of their cell; valid is false outside the grid and on invalid cells."""
    g = grid.select("row", "col", "bands", "valid")
    return points.join(g, ["row", "col"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def offsets(size: int) -> list[tuple[int, int]]:
    half = size // 2
    return [(i, j) for i in range(-half, size - half) for j in range(-half, size - half)]


def focal_cells(centres: DataFrame, grid: DataFrame, size: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """(row, col, bands, valid) of every cell in the window around each centre.

    With height and width, windows are mirrored at the edges; otherwise cut off. The offsets are size^2 literals, so the join with the
    grid is an equi-join on (row, col), whatever the size of the grid.
    """
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets(size)])).alias("o")
    c = centres.select("row", "col", at)
    r, k = F.col("row") + F.col("o.i"), F.col("col") + F.col("o.j")
    if height is not None:
        r, k = reflect(r, height), reflect(k, width)
    c = c.select(F.col("row").alias("crow"), F.col("col").alias("ccol"), r.cast("int").alias("row"), k.cast("int").alias("col"))
    # Neither side is bounded, and a grid's files are so small for its cells that Spark would broadcast it.
    return c.join(grid.select("row", "col", "bands", "valid").hint("merge"), ["row", "col"]).select(F.col("crow").alias("row"), F.col("ccol").alias("col"), "bands", "valid")


def focal_mean(grid: DataFrame, value: str, size: int, height: int, width: int) -> DataFrame:
    """Mean of a value over the mirrored window of every cell, valid cells counting only; null without valid cells."""
    # A cell sends its value to the centres that see it, itself or mirrored; map-side sums leave about one row a centre to shuffle.
    span = F.array(*[F.lit(i) for i in range(-(size // 2), size - size // 2)])

    def seen_from(c: str, n: int) -> Column:
        images = F.array(F.col(c), F.when(F.col(c) > 0, -F.col(c)), F.when(F.col(c) < n - 1, 2 * (n - 1) - F.col(c)))
        centres = F.flatten(F.transform(images, lambda u: F.transform(span, lambda i: u - i)))
        return F.explode(F.filter(centres, lambda r: (r >= 0) & (r < n))).alias(c)

    sent = grid.select("row", "col", F.when(F.col("valid"), F.col(value)).alias("__v"))
    sent = sent.select(seen_from("row", height), "col", "__v").select("row", seen_from("col", width), "__v")
    means = sent.groupBy("row", "col").agg(F.avg("__v").alias("focal"))
    return means.join(grid.select("row", "col").hint("merge"), ["row", "col"], "left_semi")


def strided_bags(grid: DataFrame, stride: int, size: int, min_cells: int = 3) -> DataFrame:
    """Cells of windows, cut off at the edges, around every stride-th valid cell; windows under min_cells valid cells go."""
    anchors = grid.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0) & F.col("valid"))
    cells = focal_cells(anchors, grid, size).filter("valid")
    enough = cells.groupBy("row", "col").count().filter(F.col("count") >= min_cells).select("row", "col")
    return cells.join(enough, ["row", "col"], "left_semi")


def cover(grid: DataFrame, polygons: DataFrame) -> DataFrame:
    """(site_id, row, col, bands) of valid cells whose centre lies in a polygon (site_id, ring); candidates come from each ring's box."""
    box = polygons.select("site_id", "ring", F.array_min(F.transform("ring", lambda p: p["x"])).alias("x0"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("x1"), F.array_min(F.transform("ring", lambda p: p["y"])).alias("y0"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("y1"))
    met = grid.filter("valid").join(box, F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return met.filter(in_ring("x", "y", "ring")).select("site_id", "row", "col", "bands")


def _met(cells: DataFrame, centres: DataFrame, bucket: float, rings: int) -> DataFrame:
    """cells with centre_id, cx and cy of every centre in whose square bucket, or `rings` buckets around it, they lie."""
    key = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    span = range(-rings, rings + 1)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in span for j in span])).alias("o")
    c = centres.select("centre_id", F.col("x").alias("cx"), F.col("y").alias("cy"), key("x").alias("bx"), key("y").alias("by"), at)
    c = c.select("centre_id", "cx", "cy", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    return cells.select("*", key("x").alias("bx"), key("y").alias("by")).join(c, ["bx", "by"])


def _widen(cells: DataFrame, centres: DataFrame, bucket: float, rings: int, near) -> DataFrame:
    """near(met, reach, last) of all centres: rows that it marks as open are sought again in buckets of twice the width, until none is
    open or `last` tells that the buckets hold all cells. It gets all cells within `reach` of a centre, and some beyond."""
    place = lambda df: df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    both = place(cells).unionByName(place(centres)).filter(finite(F.col("x")) & finite(F.col("y")))
    x, y = both.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    out, span = None, max(x or 0, y or 0)
    while True:
        last = bucket * rings > span
        got = materialize(near(_met(cells, centres, bucket, rings), bucket * rings, last), "near")  # else plans grow with every round
        done = (got if last else got.filter("not open")).drop("open")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        gone = done.select(F.col("centre_id").alias("__gone")).distinct()
        centres = materialize(centres.join(gone, F.col("centre_id").eqNullSafe(F.col("__gone")), "left_anti"), "centres")
        if centres.isEmpty():
            return out
        bucket *= 2


def grow_points(points: DataFrame, grid: DataFrame, n: int, first_radius: int) -> DataFrame:
    """point_id, radius and cells: the least square ring around each point (point_id, row, col) that holds n valid cells, from radius 1 on.

    The search starts with rings up to first_radius and widens. If the whole grid has fewer than n valid cells, the ring reaches the grid's
    edges; points go only if it has none.
    """
    row0, row1, col0, col1 = grid.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()

    def near(met: DataFrame, reach: float, last: bool) -> DataFrame:
        ring = F.greatest(F.lit(1), F.abs(F.col("x") - F.col("cx")), F.abs(F.col("y") - F.col("cy"))).cast("int")
        by = met.withColumn("ring", ring).filter(F.col("ring") <= reach).groupBy("centre_id", "cx", "cy", "ring").agg(F.count(F.lit(1)).alias("k"))
        run = by.withColumn("cells", F.sum("k").over(Window.partitionBy("centre_id").orderBy("ring")))
        enough = F.col("cells") >= n
        got = run.groupBy("centre_id", "cx", "cy").agg(F.min(F.when(enough, F.col("ring"))).alias("radius"), F.min(F.when(enough, F.col("cells"))).alias("cells"), F.max("cells").alias("all"))
        edge = F.greatest(F.lit(1), F.col("cx") - F.lit(col0), F.lit(col1) - F.col("cx"), F.col("cy") - F.lit(row0), F.lit(row1) - F.col("cy")).cast("int")
        return got.select("centre_id", F.coalesce("radius", edge).alias("radius"), F.coalesce("cells", "all").alias("cells"), F.col("radius").isNull().alias("open"))

    centres = points.select(F.col("point_id").alias("centre_id"), F.col("col").alias("x"), F.col("row").alias("y"))
    grown = _widen(grid.filter("valid").select(F.col("col").alias("x"), F.col("row").alias("y")), centres, first_radius, 1, near)
    return grown.select(F.col("centre_id").alias("point_id"), "radius", "cells")


def anchors(grid: DataFrame, n: int, seed: int) -> DataFrame:
    """n random valid cells by md5 key, in the order of the key."""
    return grid.filter("valid").withColumn("priority", hash_key(seed, "row", "col")).orderBy("priority", "row", "col").limit(n).select("row", "col", "priority")


def nearest_cells(cells: DataFrame, centres: DataFrame, k: int, bucket: float | None = None, rings: int = 1) -> DataFrame:
    """(centre_id, cell_id, d2, rank): the k nearest cells of each centre, ties by cell_id; fewer only if there are fewer cells.

    Both sides meet in an equi-join on square buckets of width `bucket`, `rings` around a centre's own; centres whose k-th distance these
    don't cover meet cells again in buckets of twice the width. Without a width, a bucket is as wide as holds k cells on the average.
    """
    if bucket is None:
        one = cells.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).cast("double").alias("w"), (F.max("y") - F.min("y")).cast("double").alias("h")).first()
        side = max(one.w or 0.0, one.h or 0.0, 1e-9)
        bucket = max((max(one.w or 0.0, side / 1000) * max(one.h or 0.0, side / 1000) * k / max(one.n, 1)) ** 0.5, side / 1e6)

    def near(met: DataFrame, reach: float, last: bool) -> DataFrame:
        d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
        rank = F.row_number().over(Window.partitionBy("centre_id").orderBy("d2", "cell_id"))
        got = met.select("centre_id", "cell_id", d2.alias("d2")).withColumn("rank", rank).filter(F.col("rank") <= k)
        of = Window.partitionBy("centre_id")
        return got.withColumn("open", (F.count(F.lit(1)).over(of) < k) | (F.max("d2").over(of) >= F.lit(float(reach) ** 2)))

    return _widen(cells.select("cell_id", "x", "y"), centres.select("centre_id", "x", "y"), bucket, rings, near)


def align(cells: DataFrame, grid: DataFrame, min_cells: int, cap: int, seed: int) -> DataFrame:
    """Bags with grid values instead of their own: the first cell of a bag in each grid cell, capped at random, bags under min_cells gone."""
    hit = cells.select("bag_id", "cell_id", "label", "row", "col").join(grid.filter("valid").select("row", "col", "bands"), ["row", "col"])
    first = F.row_number().over(Window.partitionBy("bag_id", "row", "col").orderBy("cell_id"))
    one = hit.withColumn("__rn", first).filter("__rn = 1").drop("__rn")
    pick = F.row_number().over(Window.partitionBy("bag_id").orderBy(hash_key(seed, "bag_id", "cell_id"), "cell_id"))
    one = one.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("bag_id"))).withColumn("__rn", pick)
    return one.filter((F.col("__rn") <= cap) & (F.col("__n") >= min_cells)).select("bag_id", "cell_id", "label", "row", "col", F.col("bands").alias("features"))


def background_bags(grid: DataFrame, occupied: DataFrame, n: int, size: int, seed: int, radius: int) -> DataFrame:
    """n background bags of `size` cells: random free anchors with their nearest free cells, in the order of the anchors.

    The search starts within `radius` and widens, so an anchor is passed over only if the grid has fewer free cells than `size`; bags may
    overlap each other, never the occupied cells (row, col).
    """
    free = grid.filter("valid").join(occupied.select("row", "col").distinct(), ["row", "col"], "left_anti")
    a = anchors(free.withColumn("valid", F.lit(True)), 25 * n, seed)
    points = a.select(F.col("priority").alias("centre_id"), F.col("col").alias("x"), F.col("row").alias("y"))
    cells = free.select(F.struct("row", "col").alias("cell_id"), F.col("col").alias("x"), F.col("row").alias("y"))
    near = nearest_cells(cells, points, size, radius + 1).select(F.col("centre_id").alias("point_id"), "cell_id.row", "cell_id.col")
    full = near.groupBy("point_id").count().filter(F.col("count") == size).orderBy("point_id").limit(n)
    full = full.select("point_id", F.format_string("background-%05d", F.row_number().over(Window.orderBy("point_id")) - 1).alias("bag_id"))
    return near.join(F.broadcast(full), "point_id").join(free.select("row", "col", "bands"), ["row", "col"]).select("bag_id", "row", "col", F.col("bands").alias("features"))
