"""Bags of cells: audited loading, dedup, caps, splits and transforms. Order comes from ids and md5 keys, never from row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabag.functions.expressions import all_finite, finite, hash_key, hash_uniform


def audited_bags(rows: DataFrame, features: Sequence[str], label: str, bag: str, x: str, y: str, order: str, labels: Sequence[int] | None = None, min_unique: int = 3) -> tuple[DataFrame, DataFrame]:
    """(cells, exclusions) of a table with one row a cell.

    Rows without id or with a label that isn't 0 or 1 are excluded, then rows with a feature or coordinate that isn't finite; of rows
    with equal (label, id, x, y) the first by `order` stays; bags with fewer than `min_unique` cells are excluded. exclusions has id,
    reason, rows and valid_unique_cells.
    """
    t = rows.select(F.col(bag).cast("string").alias("id"), F.col(label).cast("double").alias("lab"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(order).alias("ord"), F.array(*[F.col(f).cast("double") for f in features]).alias("features"))
    if labels is not None:
        t = t.filter(F.col("lab").isin([float(v) for v in labels]))
    reason = F.when(F.col("id").isNull(), "missing_id").when(F.col("lab").isNull() | ~F.col("lab").isin(0.0, 1.0), "invalid_label")
    t = t.withColumn("reason", reason).withColumn("ok", F.coalesce(all_finite("features") & finite("x") & finite("y"), F.lit(False)) & F.col("reason").isNull())
    bad = t.filter(F.col("reason").isNotNull()).groupBy("id", "reason").agg(F.count(F.lit(1)).alias("rows")).withColumn("valid_unique_cells", F.lit(0).cast("long"))
    first = F.row_number().over(Window.partitionBy("lab", "id", "x", "y").orderBy("ord"))
    kept = t.filter("ok").withColumn("rn", first).filter("rn = 1")
    sizes = t.filter("reason is null").groupBy("lab", "id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(F.col("ok"), F.struct("x", "y"))).alias("valid_unique_cells"))
    small = sizes.filter(F.col("valid_unique_cells") < min_unique).select("id", F.lit("fewer_than_min_unique_cells").alias("reason"), "rows", "valid_unique_cells")
    good = sizes.filter(F.col("valid_unique_cells") >= min_unique).select("lab", "id")
    name = F.concat(F.when(F.col("lab") == 1, "site-").otherwise("background-"), F.col("id"))
    cells = kept.join(good, ["lab", "id"]).select(name.alias("bag_id"), F.col("ord").alias("cell_id"), F.col("lab").cast("int").alias("label"), "features", "x", "y")
    return cells, bad.unionByName(small)


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row by `order` for each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__rn = 1").drop("__rn")


def cap(df: DataFrame, group: str, item: str, k: int, seed: int) -> DataFrame:
    """k random rows of each group without replacement, by md5 of seed, group and item."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_key(seed, group, item), item))
    return df.withColumn("__rn", rank).filter(F.col("__rn") <= k).drop("__rn")


def at_least(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of groups that have n rows or more."""
    return df.join(df.groupBy(group).count().filter(F.col("count") >= n).select(group), group, "left_semi")


def random_groups(df: DataFrame, item: str, groups: int, seed: int) -> DataFrame:
    """df with random_bag, one of `groups` numbers hashed from the item."""
    return df.withColumn("random_bag", F.floor(hash_uniform(seed, item) * groups).cast("int"))


def reservoir(df: DataFrame, item: str, n: int, seed: int) -> DataFrame:
    """n random rows by md5 key, in the order of the key."""
    return df.withColumn("priority", hash_key(seed, item)).orderBy("priority", item).limit(n)


def duplicate_all(cells: DataFrame, times: int) -> DataFrame:
    """Every cell `times` times, numbered by copy."""
    return cells.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def duplicate_selected(cells: DataFrame, fraction: float, seed: int) -> DataFrame:
    """cells and once more max(1, ceil(n fraction)) random ones of each bag; copy is 0 or 1."""
    w = Window.partitionBy("bag_id")
    chosen = cells.withColumn("__rn", F.row_number().over(w.orderBy(hash_key(seed, "bag_id", "cell_id"), "cell_id"))).withColumn("__k", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * F.lit(fraction))))
    more = chosen.filter("__rn <= __k").drop("__rn", "__k").withColumn("copy", F.lit(1))
    return cells.withColumn("copy", F.lit(0)).unionByName(more)


def relabel(df: DataFrame, order: str, label: str = "label") -> DataFrame:
    """df with bag_name site-00000 or background-00000, numbered by `order` within each label."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1
    return df.withColumn("bag_name", F.format_string("%s-%05d", F.when(F.col(label) == 1, "site").otherwise("background"), n))


def nested(cells: DataFrame) -> DataFrame:
    """One row a bag with its cells as arrays, in the order of cell_id; a bag is as large as what one task can hold."""
    items = F.array_sort(F.collect_list(F.struct("cell_id", "features", "x", "y")))
    bags = cells.groupBy("bag_id").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n_samples"), items.alias("items"))
    return bags.select("bag_id", "label", "n_samples", F.transform("items", lambda i: i["features"]).alias("samples"), F.transform("items", lambda i: F.struct(i["x"].alias("x"), i["y"].alias("y"))).alias("coordinates"))


def violations(cells: DataFrame, d: int) -> DataFrame:
    """One row of counts that must all be 0: cells that aren't finite, wrong widths, labels other than 0 and 1, empty ids, mixed labels."""
    mixed = cells.groupBy("bag_id").agg(F.countDistinct("label").alias("k")).agg(F.count_if(F.col("k") > 1).alias("mixed_labels"))
    return cells.agg(
        F.count_if(~F.coalesce(all_finite("features"), F.lit(False))).alias("not_finite"), F.count_if(F.size("features") != d).alias("wrong_width"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_label"), F.count_if(F.coalesce(F.col("bag_id"), F.lit("")) == "").alias("no_id"),
    ).crossJoin(mixed)


def stratified_split(bags: DataFrame, fraction: float, seed: int, stratify: bool = True, at_least_one: bool = False) -> DataFrame:
    """bags (bag_id, label) with role 'test' for a random part and 'train' for the rest.

    Stratified: round(n fraction) of each label, half to even, kept within [1, n - 1] where n > 1 and 0 otherwise; at_least_one: not less
    than 1 whatever n. Otherwise floor(n fraction) of all.
    """
    by = ["label"] if stratify else []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    if at_least_one:
        k = F.greatest(F.lit(1), F.bround(n * fraction))
    elif stratify:
        k = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.bround(n * fraction)))).otherwise(0)
    else:
        k = F.floor(n * F.lit(fraction))
    rank = F.row_number().over(w.orderBy(hash_key(seed, "bag_id"), "bag_id"))
    return bags.withColumn("role", F.when(rank <= k, "test").otherwise("train"))


def three_way(bags: DataFrame, test: float, holdout: float, seed: int) -> DataFrame:
    """bags with part 'test', 'holdout' or 'train' by one hashed number each."""
    u = hash_uniform(seed, "bag_id")
    return bags.withColumn("part", F.when(u < test, "test").when(u < test + holdout, "holdout").otherwise("train"))


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left whose key isn't in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
