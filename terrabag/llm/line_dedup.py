"""Line dedup by a log-template tree, in DataFrame functions only.

A line's digits are masked; its leaf in the tree is its number of tokens and its leading tokens. Where a leaf has several lines, each
token counts the documents that have it at its position; a line's tokens down to any count are a template that the line may carry, the
others its variable fields. A line carries that of its templates that explains most, or itself. Templates that recur across documents
are dropped everywhere but in the first document that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, free, join_hot, materialize, semi_join_hot, texts

#: Leading tokens in a leaf's path; share of a general template's tokens that are constant at least.
DEPTH, CONSTANT = 3, 0.5
#: Documents from which on a short template recurs; bytes from which on a masked line is long and recurs in LONG_DOCS documents.
MIN_DOCS, LONG_BYTES, LONG_DOCS = 10, 40, 2
#: Tokens that a line must have to be dropped: every line that isn't blank counts.
MIN_TOKENS = 1


def _lines(docs: DataFrame) -> DataFrame:
    """(did, tk, pos, line, n, floor, leaf, t1, t2) of every line that isn't blank; t1 and t2 are hashes of the masked line."""
    # Texts are hashed, masked and split below the explode, once each: Spark evaluates again what a filter above it reads, and splits
    # twice for an explode that isn't outer. No text splits into nothing, so the outer one adds no row.
    whole = docs.select("did", F.xxhash64("text").alias("tk"), F.split(F.regexp_replace("text", "[0-9]+", "<*>"), "\n").alias("parts"))
    rows = whole.select("did", "tk", F.posexplode_outer("parts").alias("pos", "line")).withColumn("line", F.trim("line")).filter("line != ''")
    rows = rows.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    rows = rows.filter(F.col("n") >= MIN_TOKENS) if MIN_TOKENS > 1 else rows
    rows = rows.withColumn("floor", F.when(F.octet_length("line") >= LONG_BYTES, LONG_DOCS).otherwise(MIN_DOCS))
    lead = F.substring_index("line", " ", DEPTH)
    return rows.withColumn("leaf", F.xxhash64("n", lead)).withColumn("t1", F.xxhash64("line")).withColumn("t2", F.xxhash64(F.lit("t"), "line"))


def _cuts(lines: DataFrame, exact: DataFrame, leaves: DataFrame, total: int) -> DataFrame:
    """(t, docs, first, sig, size, limit): the general templates that each line t of the given leaves may carry.

    A token at a position is as frequent as the documents of the leaf's lines that have it there. A line's tokens down to any frequency
    are a template of `size` constant tokens, hashed as sig; the others are variable fields. So a leaf has as many templates as its lines
    show: tokens of a template are as frequent as it is, and what fills its fields is less so.
    """
    t = ["leaf", "t1", "t2"]
    own = semi_join_hot(lines.select(*t, "n", "line"), leaves, "leaf", "lines", total).groupBy(*t).agg(F.first("n").alias("n"), F.first("line").alias("line"))
    own = materialize(own.join(exact.select(*t, "docs", "first"), t), "leaf-lines")
    tokens = own.select(*t, "n", "docs", "first", F.posexplode(F.split("line", " ")).alias("at", "token"))
    tokens = tokens.select(*t, "n", "docs", "first", "at", F.xxhash64("leaf", "at", "token").alias("w"), F.octet_length("token").alias("bytes"))
    counts = materialize(tokens.groupBy("w").agg(F.sum("docs").alias("freq"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "token-counts")
    met = join_hot(tokens, counts, "w", "kinds", own.agg(F.sum("n")).first()[0] or 1)
    # A line's list is as long as the line.
    met = met.groupBy(*t, "n", "docs", "first").agg(F.array_sort(F.collect_list(F.struct("at", "w", "freq", "bytes"))).alias("shared")).filter(F.size("shared") >= CONSTANT * F.col("n"))
    kept = F.transform(F.array_distinct(F.transform("shared", lambda x: x["freq"])), lambda f: F.filter("shared", lambda x: x["freq"] >= f))
    cut = F.transform(kept, lambda k: F.struct(F.xxhash64(F.transform(k, lambda x: x["w"])).alias("sig"), F.size(k).alias("size"), F.aggregate(k, F.lit(0), lambda n, x: n + x["bytes"] + 1).alias("bytes")))
    cuts = met.select(F.struct(*t).alias("t"), "n", "docs", "first", F.explode(cut).alias("cut")).select("t", "n", "docs", "first", "cut.*")
    # Leading tokens are the same in all of a leaf, so they make a template only where all but one token are leading.
    cuts = cuts.filter((F.col("size") >= CONSTANT * F.col("n")) & (F.col("size") < F.col("n")) & ((F.col("size") > DEPTH) | (F.col("size") == F.col("n") - 1)))
    limit = F.when(F.col("bytes") > LONG_BYTES, LONG_DOCS).otherwise(MIN_DOCS)
    return cuts.select("t", "docs", "first", "sig", "size", limit.alias("limit"))


def recurring_lines(body: DataFrame) -> DataFrame:
    """(did, tk, drop): the positions of lines to drop in each document of body, which has did and text."""
    found = materialize(_lines(body).select("did", "tk", "pos", "n", "floor", "leaf", "t1", "t2"), "lines")
    total = max(1, found.count())
    once = found.select("did", "tk", "n", "floor", "leaf", "t1", "t2").distinct()
    exact = materialize(once.groupBy("leaf", "t1", "t2", "n", "floor").agg(F.count(F.lit(1)).alias("docs"), F.min("did").alias("first")), "templates")
    # A leaf may hold a third of all lines: such ones meet them in a join of their own.
    leaves = exact.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("docs").alias("lines")).filter("kinds > 1").select("leaf", "lines")
    cuts = materialize(_cuts(_lines(body), exact, materialize(leaves, "leaves"), total), "cuts")
    likely = cuts.groupBy("sig").agg(F.sum("docs").alias("most"), F.first("limit").alias("limit"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1 and most >= limit")
    cuts = materialize(join_hot(cuts.drop("limit"), materialize(likely.select("sig", "limit", "kinds"), "likely"), "sig", "kinds", max(1, cuts.count())), "cuts")
    # Documents of a general template: lines of one document that share it count once.
    wide = materialize(cuts.groupBy("t", "docs").agg(F.collect_list(F.struct("sig", "limit", "kinds")).alias("cuts")), "wide")
    many = join_hot(once.select("did", "tk", F.struct("leaf", "t1", "t2").alias("t")), wide, "t", "docs", total, shuffle=True)
    many = many.select("did", "tk", F.explode("cuts").alias("cut")).select("did", "tk", "cut.*").distinct()
    spread = materialize(many.groupBy("sig", "limit", "kinds").agg(F.count(F.lit(1)).alias("n")).filter("n >= limit").select("sig", "kinds", "n"), "spread")
    # A line carries the template that explains most: its documents times its constant tokens. The line itself is one of them.
    fits = join_hot(cuts.drop("limit", "kinds"), spread, "sig", "kinds", max(1, cuts.count()))
    score = F.struct((F.col("n") * F.col("size")).alias("score"), "size", "sig")
    best = fits.groupBy("t", "docs", "first").agg(F.max(score).alias("best"))
    lines = exact.select(F.struct("leaf", "t1", "t2").alias("t"), "docs", "first", F.when(F.col("docs") >= F.col("floor"), F.col("docs") * F.col("n")).otherwise(0).alias("own")).filter("own > 0")
    general = materialize(best.join(lines.select("t", "own"), "t", "left").filter(F.col("own").isNull() | (F.col("best.score") > F.col("own"))).select("t", "docs", "first", F.col("best.sig").alias("sig")), "general")
    keep = materialize(general.groupBy("sig").agg(F.min("first").alias("keep"), F.count(F.lit(1)).alias("kinds")), "keep")
    general_drop = join_hot(general, keep, "sig", "kinds", max(1, general.count())).select("t", "docs", "keep")
    exact_drop = lines.join(general.select("t"), "t", "left_anti").select("t", "docs", F.col("first").alias("keep"))
    drop = materialize(general_drop.unionByName(exact_drop), "drops")
    hit = join_hot(found.withColumn("t", F.struct("leaf", "t1", "t2")), drop, "t", "docs", total, shuffle=True).filter("did != keep")
    return hit.groupBy("did", "tk").agg(F.collect_set("pos").alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", keep_whole: bool = False) -> DataFrame:
    """docs with recurring lines dropped from the text, and count_col, if docs has it, set to the new number of code points.

    All rows stay, in the columns of docs; a text that loses every line becomes empty or, with keep_whole, stays as it is. Blank lines stay. A null
    text stays null and counts as empty; a null doc_id counts as the least id. Rows that repeat a doc_id are documents of their own if
    their texts differ, and count once if not. Very long texts are split whole. Of templates that
    explain equally much, the one with more constant tokens counts, then the one of the larger hash. An empty table gives an empty
    result. Columns of any name are kept as they are.
    """
    columns = docs.columns
    own_id, own_text, did, tk, gone, split, same = (free(n, columns) for n in ("line_id", "line_text", "line_did", "line_tk", "line_drop", "line_parts", "line_same"))
    drops = recurring_lines(texts(docs, id_col, text_col)).select(F.col("did").alias(did), F.col("tk").alias(tk), F.col("drop").alias(gone))
    keyed = docs.withColumn(own_id, F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID))).withColumn(own_text, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    met = keyed.join(drops.hint("merge"), (F.col(own_id) == F.col(did)) & (F.col(own_text) == F.col(tk)), "left")
    # A column of its own: within transform the text would be split again for every line.
    met = met.withColumn(split, F.when(F.col(gone).isNotNull(), F.split(F.col(text_col), "\n")))
    parts = F.col(split)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    rest = F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n")
    lost = ~F.exists(stay, lambda i: F.trim(F.element_at(parts, i + 1)) != "") if keep_whole else F.lit(False)
    met = met.withColumn(same, F.col(gone).isNull() | lost)
    met = met.withColumn(own_text, F.when(F.col(same), F.col(text_col)).otherwise(rest))
    out = []
    for c in columns:
        if c == text_col:
            out.append(F.col(own_text).alias(c))
        elif c == count_col:
            out.append(F.when(F.col(same), F.col(c)).otherwise(F.char_length(own_text)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return met.select(*out)
