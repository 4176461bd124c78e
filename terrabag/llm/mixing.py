"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is its source's target repetition rate; the variable comes
from inverting the distribution at a number hashed from seed and doc_id. Copies are then shuffled globally by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, join_hot, materialize

#: Means above this are split into equal parts, each drawn on its own.
PART = 64.0
#: Steps of the inverted distribution; the chance of more at a mean of PART is under 1e-15.
STEPS = 160
_NO_SOURCE = "\x00"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _distribution(mean: Column) -> Column:
    """P(X <= k) of a Poisson variable for k from 0 on."""
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda s: s["c"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """(source, rows, rate): the mean number of copies of a source's documents.

    A source's share of the result's characters is its weight over the sum of weights; without weights, a weight is the square root of
    the source's characters. Weights hold for sources present; a source that they don't name has weight 0. The total volume stays.
    """
    sizes = docs.groupBy(F.coalesce(docs[source_col].cast("string"), F.lit(_NO_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(F.coalesce(docs[size_col].cast("long"), F.lit(0)), F.lit(1))).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("w", F.sqrt("size"))
    else:
        spark = docs.sparkSession
        named = spark.createDataFrame([(_NO_SOURCE if k is None else k, float(v)) for k, v in weights.items()], "source string, w double")
        weighed = sizes.join(named, "source", "left").fillna(0.0, ["w"])
    weighed = materialize(weighed, "sources")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("w").alias("w")).first()
    return weighed.select("source", "rows", (F.col("w") / F.lit(float(total["w"] or 1.0)) * F.lit(float(total["size"] or 0.0)) / F.col("size")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """The columns of docs and mix_copy: each document once for every copy drawn, in a globally shuffled order.

    A null source is a source of its own; a null or non-positive size counts as one character; a null doc_id hashes as an empty string.
    Empty and very long texts are rows like others, their sizes come from size_col. Rows that repeat a doc_id draw the same number, and
    so do equal hashes. An empty table gives an empty result. Columns of any name are kept, but for mix_copy, which is replaced.
    """
    columns = [c for c in docs.columns if c != "mix_copy"]
    source, rows, parts, cdf, key, times = (free(n, docs.columns) for n in ("mix_source", "mix_rows", "mix_parts", "mix_cdf", "mix_key", "mix_times"))
    rates = source_rates(docs, weights, source_col, size_col)
    split = F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1))
    table = materialize(rates.withColumn("parts", split).select(F.col("source").alias(source), F.col("rows").alias(rows), F.col("parts").alias(parts), _distribution(F.col("rate") / F.col("parts")).alias(cdf)), "rates")
    total = table.agg(F.sum(rows)).first()[0] or 1
    keyed = docs.select(*[docs[c] for c in columns], F.coalesce(docs[source_col].cast("string"), F.lit(_NO_SOURCE)).alias(source), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias(key))
    met = join_hot(keyed, table, source, rows, total)
    # One number a part, made before it is looked up in the distribution.
    drawn = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(F.lit(str(seed)), F.col(key), j.cast("string")))
    copies = F.aggregate(drawn, F.lit(0).cast("long"), lambda n, u: n + F.size(F.filter(F.col(cdf), lambda c: c <= u)).cast("long"))
    counted = met.withColumn(times, copies).filter(F.col(times) > 0).select(*columns, key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias("mix_copy"))
    order = F.xxhash64(F.lit(seed), F.col(key), F.col("mix_copy"))
    return counted.withColumn(key, order).repartition(F.col(key)).sortWithinPartitions(key).select(*columns, "mix_copy")
