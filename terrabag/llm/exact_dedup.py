"""Exact dedup by a Golomb-coded exchange of fingerprints.

Each partition sends the sorted distinct fingerprints of its texts, Golomb-Rice coded, to the owners of fingerprint ranges. Owners
answer with one bit a fingerprint: seen twice or not. Only rows whose bit is set are suspects; their texts are shuffled and compared
byte for byte with one representative of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import HOT_SHARE, ascii_lower, materialize, public_id, texts

#: Fingerprints that one owner handles, about; the number of owners follows the number of rows.
PER_OWNER = 1_000_000
#: Rows that are compared with one copy of their representative.
PER_COPY = 256


def owners_for(rows: int) -> int:
    """A power of two, 64 at least; it grows with the rows, so an owner's share doesn't."""
    n = 64
    while n * PER_OWNER < rows:
        n *= 2
    return n


def runs_by_owner(fp: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(owner, sorted distinct fingerprints, seen twice here) for a partition's fingerprints."""
    values, counts = np.unique(fp, return_counts=True)
    owner = (values >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for v, c in zip(np.split(values, cuts), np.split(counts, cuts), strict=True):
        if len(v):
            yield int(v[0] >> np.uint64(64 - bits)), v, c > 1


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)


def _sender(bits: int):
    def send(table: pa.Table) -> pa.Table:
        """All rows of one partition, so that its answer fits its run."""
        pid = table.column("pid")[0].as_py()
        rows = [(pid, o, golomb.encode(v), np.packbits(twice).tobytes()) for o, v, twice in runs_by_owner(_unsigned(table.column("fp")), bits)]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("pid", "owner", "run", "twice"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    return send


def answer_runs(table: pa.Table) -> pa.Table:
    """One owner: merge the runs of all senders and give each sender a bitmap over its own run."""
    runs = [golomb.decode(x) for x in table.column("run").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(r)].astype(bool) for x, r in zip(table.column("twice").to_pylist(), runs, strict=True)]
    merged = np.concatenate(runs)
    values, where, counts = np.unique(merged, return_inverse=True, return_counts=True)
    dup = counts > 1
    dup[where[np.concatenate(twice)]] = True
    flags, cuts = dup[where], np.cumsum([len(r) for r in runs])[:-1]
    return pa.table({"pid": table.column("pid"), "owner": table.column("owner"), "bitmap": pa.array([np.packbits(x).tobytes() for x in np.split(flags, cuts)], pa.binary())})


def _receiver(bits: int):
    def receive(rows: pa.Table, answers: pa.Table) -> pa.Table:
        fp = _unsigned(rows.column("fp"))
        said = dict(zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist(), strict=True))
        values, flags = [], []
        for owner, v, _ in runs_by_owner(fp, bits):
            values.append(v)
            flags.append(np.unpackbits(np.frombuffer(said[owner], np.uint8))[: len(v)].astype(bool))
        if not values:
            return pa.table({"did": rows.column("did"), "sha": rows.column("sha"), "dup": pa.array([], pa.bool_())})
        dup = np.concatenate(flags)[np.searchsorted(np.concatenate(values), fp)]
        return pa.table({"did": rows.column("did"), "sha": rows.column("sha"), "dup": pa.array(dup)})

    return receive


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group. The row with
    the largest doc_id stays; a null doc_id is the smallest and comes back as null. Rows that repeat a doc_id are all returned, and
    those with the largest id of their group are all kept. Very long texts are compared whole. An empty table gives an
    empty result. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    norm = texts(docs, id_col, text_col).select("did", ascii_lower("text").alias("norm"))
    prints = materialize(norm.select(F.shiftright(F.monotonically_increasing_id(), 33).alias("pid"), "did", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")), "op10-prints")
    total = prints.count()
    bits = owners_for(total).bit_length() - 1
    runs = prints.select("pid", "fp").groupBy("pid").applyInArrow(_sender(bits), "pid long, owner long, run binary, twice binary")
    bitmaps = runs.groupBy("owner").applyInArrow(answer_runs, "pid long, owner long, bitmap binary")
    flagged = materialize(prints.groupBy("pid").cogroup(bitmaps.groupBy("pid")).applyInArrow(_receiver(bits), "did long, sha binary, dup boolean"), "op10-flags")

    hexed = F.lower(F.hex("sha"))
    single = flagged.filter(~F.col("dup")).select(public_id("did").alias("doc_id"), public_id("did").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed.alias("text_sha256"))

    suspects = flagged.filter("dup").select("did", "sha")
    groups = materialize(suspects.groupBy("sha").agg(F.max("did").alias("keep"), F.count(F.lit(1)).alias("size")).withColumn("copies", F.ceil(F.col("size") / PER_COPY).cast("int")), "op10-groups")
    wanted = suspects.select("did").distinct()
    bodies = materialize(norm.join(wanted.hint("merge"), "did", "left_semi").select("did", "norm", F.unhex(F.sha2("norm", 256)).alias("sha")), "op10-suspects")
    reps = (
        bodies.join(groups.withColumnRenamed("sha", "gsha"), (F.col("did") == F.col("keep")) & (F.col("sha") == F.col("gsha")))
        .dropDuplicates(["sha"])
        .select("sha", "keep", "size", F.col("norm").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    )
    hot = groups.filter(F.col("size") > max(float(PER_COPY), total * HOT_SHARE / 4)).select("sha", "copies")
    # At most 4 / HOT_SHARE groups are that large. All other groups are small enough to meet one copy.
    members = bodies.join(F.broadcast(hot), "sha", "left").withColumn("salt", F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("did"), F.col("copies"))).otherwise(F.lit(0)).cast("int")).drop("copies")
    same = F.when(F.col("norm") == F.col("rep"), F.col("keep")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
    double = members.join(reps, ["sha", "salt"]).select("did", same.alias("keep"), "size", "sha")
    double = double.select(public_id("did").alias("doc_id"), public_id("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("did") == F.col("keep")).alias("kept"), hexed.alias("text_sha256"))
    return single.unionByName(double)
