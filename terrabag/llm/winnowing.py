"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of visible characters; runs of more than TOKEN code points, as in scripts without spaces, and texts under SHORT code
points are taken character by character. Hashes of GRAM tokens come from doubling (one, two, four tokens, and
one more), the least hash of each WINDOW of them, the rightmost of equal ones, is kept with its position. Two texts that share
GRAM + WINDOW - 1 tokens in a row share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import public_id, texts

TOKEN, GRAM, WINDOW = 16, 5, 16
#: Texts of fewer code points have too few words for a window.
SHORT = 120
#: Low bits of a kept number hold the position, counted down; the rest is the hash. No string has more tokens than they can count.
POSITION_BITS = 30
_LOW = (1 << POSITION_BITS) - 1
#: Documents of neighbouring ids that are looked at together, about.
PER_BUCKET = 200


def _join(a: Column, shift: int, both) -> Column:
    """Each element with the one `shift` further on; null stands for what lies behind the end."""
    return F.zip_with(a, F.slice(a, F.lit(shift + 1), F.size(a)), both)


def _mix(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def with_winnowed(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array<long> `out`: kept hashes of the column `text` with their positions, in order of position.

    A text of fewer than GRAM tokens is one gram; a text without tokens has none. Fewer than WINDOW grams are one window.
    """
    t, h, g, m = f"__t_{out}", f"__h_{out}", f"__g_{out}", f"__m_{out}"
    held = df.columns
    words = F.regexp_extract_all(F.col(text), F.lit(f"(?<!\\S)\\S{{1,{TOKEN}}}(?!\\S)|\\S"), F.lit(0))
    df = df.withColumn(t, F.when(F.char_length(text) < SHORT, F.regexp_extract_all(F.col(text), F.lit("\\S"), F.lit(0))).otherwise(words))
    df = df.withColumn(h, F.transform(t, lambda w: F.xxhash64(w)))
    df = df.withColumn(g, _join(F.col(h), 1, _mix))
    df = df.withColumn(g, _join(F.col(g), 2, _mix))
    df = df.withColumn(g, F.zip_with(g, F.slice(h, F.lit(GRAM), F.size(h)), _mix))
    short = F.when(F.size(t) > 0, F.array(F.xxhash64(F.array_join(t, " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(g, F.when(F.size(t) >= GRAM, F.slice(g, F.lit(1), F.greatest(F.size(t) - (GRAM - 1), F.lit(0)))).otherwise(short))
    packed = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW) - i.cast("long").bitwiseAND(F.lit(_LOW))))
    df = df.withColumn(m, packed)
    for step in (1, 2, 4, 8):
        df = df.withColumn(m, _join(F.col(m), step, lambda a, b: F.least(a, b)))
    windows = F.slice(m, F.lit(1), F.greatest(F.size(g) - (WINDOW - 1), F.least(F.size(g), F.lit(1))))
    return df.withColumn(out, F.array_distinct(windows)).select(*held, out)


def printed(kept: str) -> Column:
    """hash:position of each kept gram, joined by commas."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS))), F.lit(":"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 for two empty ones."""
    hashes = lambda c: F.transform(c, lambda x: F.shiftrightunsigned(x, POSITION_BITS))
    every = F.size(F.array_union(hashes(a), hashes(b)))
    return F.when(every > 0, F.size(F.array_intersect(hashes(a), hashes(b))) / every).otherwise(F.lit(1.0)).cast("double")


def _bucket(value: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most `value`, by bisection."""
    if not splits:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        low = F.element_at(table, F.least(mid, F.lit(len(splits) - 1)) + 1) <= value
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~low, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splits).bit_length())), state, halve, lambda s: s["lo"])


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, which has did and text, with next_<column> of the row that follows by did; the first row follows the last.

    Rows are dealt into ranges of ids; the first row of a range, whose id is the range's lower split, goes to the range before as well.
    Rows of equal ids follow each other by the hash of their text.
    """
    total = df.agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("lo")).first()
    n = min(50_000, max(2, total.n // PER_BUCKET))
    points = df.agg(F.percentile_approx("did", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("q")).first().q or []
    splits = sorted({int(x) for x in points if x > total.lo})
    own = _bucket(F.col("did"), splits)
    rows = df.withColumn("bucket", own).withColumn("late", F.lit(0))
    first = F.col("did") == F.element_at(F.split(F.lit(",".join(map(str, [total.lo or 0, *splits]))), ",").cast("array<bigint>"), F.col("bucket") + 1)
    before = F.when(F.col("bucket") > 0, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("late"))).otherwise(F.struct(F.lit(len(splits)).alias("bucket"), F.lit(2).alias("late")))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late"))
    rows = rows.withColumn("__at", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here)))).withColumn("bucket", F.col("__at.bucket")).withColumn("late", F.col("__at.late")).drop("__at")
    order = Window.partitionBy("bucket").orderBy("late", "did", F.xxhash64("text"), "text")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.filter("late = 0").drop("bucket", "late")


def winnow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (hash:position of each kept gram)."""
    kept = with_winnowed(texts(docs, id_col, text_col), "text", "kept")
    return kept.select(public_id("did").alias("doc_id"), printed("kept").alias("fingerprint"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of the code points replaced by as many first ones of the next document by ascending doc_id.
    near_edited and near_next are the Jaccard likeness of the hashes kept of the text and of the edited or the next text. A null text
    counts as empty; two empty fingerprints are alike. Very long texts are taken whole; of equal hashes in a window the rightmost is kept. A null doc_id counts as the least id and comes back as null; of rows that
    repeat a doc_id the next is decided by the hash of their texts; a single row is its own next; an empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    kept = with_winnowed(texts(docs, id_col, text_col), "text", "kept").withColumn("n", F.char_length("text").cast("long"))
    met = with_next(kept, ["text", "kept"])
    quarter = F.floor(F.col("n") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter))
    met = met.select("did", "n", "kept", "next_kept", edited.alias("edited"))
    met = with_winnowed(met, "edited", "edited_kept")
    return met.select(
        public_id("did").alias("doc_id"), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), printed("kept").alias("fingerprint"),
        printed("edited_kept").alias("edited_fingerprint"), likeness("kept", "edited_kept").alias("near_edited"), likeness("kept", "next_kept").alias("near_next"),
    )
