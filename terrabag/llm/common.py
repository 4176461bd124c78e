"""Shared helpers: tables in the shared folder, null-safe ids, joins that survive hot keys, text chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrabag.storage import materialize, shared_dir  # noqa: F401  for the operators

#: Stands for a null doc_id inside the operators; it sorts before every other id and comes back as null.
NULL_ID = -(2**63)
#: A key is hot when it holds more than this share of the rows. At most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 2000
#: Rows that no key is hot with, however few the others are.
MIN_HOT = 64
#: Keys of eight bytes that every executor may hold: some 30 MB as a hash table.
BROADCAST_KEYS = 1_000_000

#: Rows of whole texts that a Python worker is sent at a time. Spark's own default counts small rows: at 3 kB a text its batches take
#: 30 MB, several times over, in the JVM's buffers and in each worker.
BATCH_ROWS, DEFAULT_ROWS = 1_000, 10_000
ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def free(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, in whatever case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = "_" + name
    return name


def small_batches(spark: SparkSession) -> None:
    """Has the session send BATCH_ROWS rows to Python workers at a time, unless it has a setting of its own."""
    if int(spark.conf.get(ROWS_KEY)) == DEFAULT_ROWS:
        spark.conf.set(ROWS_KEY, BATCH_ROWS)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, text) of every row: null ids become NULL_ID, null texts become empty. Other columns are not read."""
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def public_id(col: str | Column) -> Column:
    """The id as callers know it: NULL_ID back to null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col != F.lit(NULL_ID), col)


def ascii_lower(col: str | Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def join_hot(rows: DataFrame, stats: DataFrame, key: str, weight: str, total: int, keep_unmatched: bool = False, shuffle: bool = False) -> DataFrame:
    """rows with the columns of stats, which has one row for each key and its number of rows in `weight`.

    Keys with more than HOT_SHARE of the `total` rows are at most 1 / HOT_SHARE, so they are broadcast whatever the size of the
    data; all others meet in a join in which no key can fill a task. Unmatched rows go, or keep nulls on request. `shuffle`: the others
    are shuffled even while Spark would broadcast them, for tables of lines, which grow with the data up to where a broadcast no longer
    fits; one plan at all sizes keeps what is tested small the same as what runs large.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = stats.filter(F.col(weight) > limit)
    cold = stats.filter(F.col(weight) <= limit)
    cold = cold.hint("merge") if shuffle else cold
    first = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left" if keep_unmatched else "inner")
    return first.unionByName(rest.select(*first.columns))


def join_dealt(rows: DataFrame, stats: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows with the columns of stats, which has one row for each key and its number of rows in `weight`; unmatched rows go.

    For narrow rows, which are all shuffled. Keys with more than HOT_SHARE of the `total` rows are dealt over parts by a hash of the row,
    and their row of stats is repeated for each part. The driver gets hashes of those keys, at most 1 / HOT_SHARE; nothing is broadcast,
    and rows go through one join whether keys are hot or not.
    """
    limit, part = max(MIN_HOT, total * HOT_SHARE), free("part", [*rows.columns, *stats.columns])
    hot = stats.filter(F.col(weight) > limit).select(F.xxhash64(key), F.ceil(F.log2(F.col(weight) / limit)).cast("int")).collect()
    # The hash 0 is always listed: with an empty list Spark would drop the parts from the plan.
    levels: dict[int, list[int]] = {1: [0]}
    for h, level in hot:
        levels.setdefault(max(1, level), []).append(h)
    among = lambda hashes: f"xxhash64(`{key}`) IN ({', '.join(f'{h}L' for h in hashes)})"
    dealt = F.expr(among([h for hashes in levels.values() for h in hashes]))
    parts = F.expr("CASE " + " ".join(f"WHEN {among(hashes)} THEN {2**level}" for level, hashes in sorted(levels.items())) + " ELSE 1 END")
    more = stats.filter(dealt).withColumn(part, F.explode(F.sequence(F.lit(1), parts - 1)))
    asked = stats.withColumn(part, F.lit(0)).unionByName(more)
    own = F.when(dealt, F.pmod(F.xxhash64(*rows.columns), parts)).otherwise(F.lit(0)).cast("int")
    return rows.withColumn(part, own).join(asked, [key, part]).drop(part)


def semi_join_hot(rows: DataFrame, stats: DataFrame, key: str, weight: str, total: int, salts: int = 64) -> DataFrame:
    """rows whose key is in stats, which has one row for each key, a long, and its number of rows in `weight`; rows are read once.

    Up to BROADCAST_KEYS keys are broadcast, after they have been counted. Beyond, both sides are shuffled; keys with more than HOT_SHARE of the `total` rows, of which there are at most 1 / HOT_SHARE, are dealt over `salts` parts each.
    """
    if stats.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(stats.select(key)), key, "left_semi")
    part, many = free("salt", [*rows.columns, key]), free("many", [*rows.columns, key])
    hot = F.col(weight) > max(1.0, total * HOT_SHARE)
    asked = stats.select(key, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias(part))
    flags = F.broadcast(stats.filter(hot).select(key, F.lit(True).alias(many)))
    dealt = rows.join(flags, key, "left").withColumn(part, F.when(F.col(many), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    return dealt.join(asked, [key, part], "left_semi").select(*rows.columns)


def utf8(values: list) -> list[bytes]:
    """Texts as UTF-8."""
    return [x.encode("utf-8") for x in values]


def blocks(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to `limit` at most, or that hold one item."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            out.append((start, i))
            start, held = i, 0
        held += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
