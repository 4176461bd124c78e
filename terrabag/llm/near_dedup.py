"""Near-dedup by MinHash with tensored banding and exact verification.

Two small collections of hashes, each hash made of a few minhashes, give the table keys: every pair of one hash of either collection
is a key, so m + m hashes serve m * m tables. Rows that share a key are candidates; a pair that shares none, with a probability under
`miss` at the limit, isn't found. Equal sets are one node. Nodes meet the least node of their table (star) and links are confirmed on
full shingle sets; n nodes make n pairs a star, never all pairs. What the stars leave open is settled in blocks: a node that its centre
doesn't link is held against those that it does, block by block, as a product of incidence matrices that only gives links back. Two
bounds keep most nodes out of the blocks: a node shares with another one no more shingles than it has in common with any candidate at
all (counted by an exchange of compressed runs), and Jaccard distance is a metric, so distances to a star's centre differ by no more
than the limit between nodes that link.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import NULL_ID, join_dealt, materialize, public_id, texts
from .components import connected_components
from .exact_dedup import answer_runs, owners_for, runs_by_owner
from .shingles import WordHashes, mix, shingle_set

#: Minhashes in one hash of a collection.
PER_HASH = 3
#: Rounds of stars before the blocks.
ROUNDS = 3
#: Nodes and shingles of a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
#: A batch of the exchange has 2 ** BATCH_BITS rows at most.
BATCH_BITS = 8
#: Pairs that share one copy of a centre's text.
PER_COPY = 256


def collection_size(similarity: float, miss: float = 1e-4) -> int:
    """Hashes in a collection, so that rows at the similarity limit share no key with a probability under `miss`."""
    return math.ceil(math.log(miss / 2) / math.log(1 - similarity**PER_HASH))


def _signer(m: int, width: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_min = WordHashes(), 2 * m * PER_HASH
        rng = np.random.default_rng(seed)
        add = rng.integers(0, 2**64, n_min, dtype=np.uint64)
        mul = rng.integers(0, 2**63, n_min, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        spread = rng.integers(0, 2**63, PER_HASH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        tag = np.arange(2 * m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for part in (b.slice(i, 2000) for i in range(0, b.num_rows, 2000)):
                n, key, sig = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, words, width)
                    n.append(len(s))
                    low = np.full(n_min, 2**64 - 1, dtype=np.uint64)
                    for i in range(0, len(s), 4096):
                        h = (s[None, i : i + 4096] ^ add[:, None]) * mul[:, None]
                        np.minimum(low, (h ^ (h >> np.uint64(32))).min(axis=1), out=low)
                    two = mix(np.array([(s * np.uint64(3)).sum(dtype=np.uint64) ^ np.uint64(len(s)), (mix(s + np.uint64(7)) * np.uint64(5)).sum(dtype=np.uint64)], dtype=np.uint64)) if len(s) else np.zeros(2, np.uint64)
                    key.append(two.tobytes())
                    sig.append(mix((mix(low).reshape(2 * m, PER_HASH) * spread).sum(axis=1, dtype=np.uint64) + tag))
                flat = np.array(sig, dtype=np.uint64).reshape(-1, 2 * m).view(np.int64)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, m, dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists(flat[:, :m]), lists(flat[:, m:])], ["did", "tk", "n", "skey", "a", "b"])

    return sign


def _overlap(width: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: WordHashes = WordHashes()
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        for b in batches:
            both, union = [], []
            for p, x, tp, tx in zip(*(b.column(c).to_pylist() for c in ("p", "x", "tp", "tx")), strict=True):
                for key, text in ((p, tp), (x, tx)):
                    if key in held:
                        held.move_to_end(key)
                    else:
                        held[key] = shingle_set(text, words, width)
                s, t = held[p], held[x]
                while len(held) > 64:
                    held.popitem(last=False)
                k = int(np.isin(s, t, assume_unique=True, kind="sort").sum()) if min(len(s), len(t)) else 0
                both.append(k)
                union.append(len(s) + len(t) - k)
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("x"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["p", "x", "both", "union"])

    return compare


class _Verifier:
    """Confirms pairs (p, x) on full shingle sets; a centre p that many pairs share is copied for every PER_COPY of them."""

    def __init__(self, bodies: DataFrame, width: int):
        self.bodies, self.width = bodies, width

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct(), "pairs")
        copies = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / PER_COPY).cast("int").alias("copies"))
        centres = self.bodies.join(copies, self.bodies.cid == copies.p).select("p", F.col("text").alias("tp"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        # At most 1 / HOT_SHARE centres have over that share of the pairs; the salt of all others is spread by what is broadcast here.
        total = pairs.count()
        limit = max(PER_COPY, total / 2000)
        hot = copies.filter(F.col("copies") > limit / PER_COPY).select("p", F.col("copies").alias("many"))
        near = pairs.join(F.broadcast(hot), "p", "left")
        near = near.join(self.bodies.select(F.col("cid").alias("x"), F.col("text").alias("tx")), "x")
        near = near.withColumn("salt", F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("x"), F.col("many"))).otherwise(F.lit(0)).cast("int"))
        met = near.join(centres.select("p", "salt", "tp"), ["p", "salt"]).select("p", "x", "tp", "tx")
        return materialize(met.mapInArrow(_overlap(self.width), "p long, x long, both long, `union` long"), "verified")


def _send_shingles(bits: int, width: int):
    def send(table: pa.Table) -> pa.Table:
        words = WordHashes()
        found = np.concatenate([shingle_set(t, words, width) for t in table.column("text").to_pylist()])
        pid = table.column("pid")[0].as_py()
        rows = [(pid, o, golomb.encode(v), np.packbits(twice).tobytes()) for o, v, twice in runs_by_owner(found, bits)]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("pid", "owner", "run", "twice"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    return send


def _count_shared(bits: int, width: int):
    def count(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = WordHashes()
        sets = [shingle_set(t, words, width) for t in table.column("text").to_pylist()]
        said = dict(zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist(), strict=True))
        values, flags = [], []
        for owner, v, _ in runs_by_owner(np.concatenate(sets), bits):
            values.append(v)
            flags.append(np.unpackbits(np.frombuffer(said[owner], np.uint8))[: len(v)].astype(bool))
        values, flags = np.concatenate(values), np.concatenate(flags)
        shared = [int(flags[np.searchsorted(values, s)].sum()) for s in sets]
        return pa.table({"cid": table.column("cid"), "shared": pa.array(shared, pa.int64())})

    return count


def shared_counts(bodies: DataFrame, shingles: int, width: int) -> DataFrame:
    """(cid, shared): how many of a node's shingles some other node of bodies (pid, cid, text) has as well."""
    bits = owners_for(shingles).bit_length() - 1
    parts = bodies.select("pid", "cid", "text")
    runs = parts.groupBy("pid").applyInArrow(_send_shingles(bits, width), "pid long, owner long, run binary, twice binary")
    bitmaps = runs.groupBy("owner").applyInArrow(answer_runs, "pid long, owner long, bitmap binary")
    return parts.groupBy("pid").cogroup(bitmaps.groupBy("pid")).applyInArrow(_count_shared(bits, width), "cid long, shared long")


def _spanning(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A forest that connects the same nodes as the links do."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := root.setdefault(i, i)) != i:
            root[i] = root[j] if j in root else j
            i = root[i]
        return i

    out = []
    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        if (p := find(i)) != (q := find(j)):
            root[p] = q
            out.append((i, j))
    return out


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by the product of their incidence matrices.

    Shingles that few sets have add to single cells instead of taking a column.
    """
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    if not len(both):
        return out

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(both, flat)
        known = both[np.minimum(at, len(both) - 1)] == flat
        return row[known], at[known]

    (ra, ca), (rb, cb) = places(a, left), places(b, right)
    cells = np.bincount(ca, minlength=len(both)).astype(np.int64) * np.bincount(cb, minlength=len(both))
    dense = np.flatnonzero(cells * 64 >= out.size)
    column = np.full(len(both), -1)
    column[dense] = np.arange(len(dense))
    for start in range(0, len(dense), 4096):
        width = min(4096, len(dense) - start)
        m = []
        for r, c, rows in ((ra, column[ca], len(left)), (rb, column[cb], len(right))):
            here = (c >= start) & (c < start + width)
            x = np.zeros((rows, width), dtype=np.float32)
            x[r[here], c[here] - start] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int32)  # counts under 4096, so exact
    thin_a, thin_b = column[ca] < 0, column[cb] < 0
    ra, ca, rb, cb = ra[thin_a], ca[thin_a], rb[thin_b], cb[thin_b]
    order = np.argsort(cb, kind="stable")
    rb, cb = rb[order], cb[order]
    first, last = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    for start in range(0, len(ca), 100_000):
        lo, n = first[start : start + 100_000], last[start : start + 100_000] - first[start : start + 100_000]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        np.add.at(out, (np.repeat(ra[start : start + 100_000], n), rb[at]), 1)
    return out


def _link_blocks(percent: int, width: int):
    def link(one: pa.Table, two: pa.Table) -> pa.Table:
        words, sides = WordHashes(), []
        for t in (one, two):
            ids = t.column("x").to_numpy()
            sets = [shingle_set(x, words, width) for x in t.column("text").to_pylist()]
            sides.append((ids, sets, np.array([len(s) for s in sets])))
        (ia, sa, na), (ib, sb, nb) = sides
        u = v = np.empty(0, np.int64)
        if len(ia) and len(ib):
            both = common_counts(sa, sb).astype(np.int64)
            x, y = np.nonzero(100 * both >= percent * (na[:, None] + nb[None, :] - both))
            u, v = ia[x], ib[y]
        kept = _spanning(u, v)
        return pa.table({"u": pa.array([i for i, _ in kept], pa.int64()), "v": pa.array([j for _, j in kept], pa.int64())})

    return link


def _chunked(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, rows, chunks) of every group g of rows (g, x)."""
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1))
    return rows.join(sizes, "x").groupBy("g").agg(F.count(F.lit(1)).alias("rows"), n.cast("int").alias("chunks"))


def links_in_blocks(bodies: DataFrame, left: DataFrame, right: DataFrame | None, percent: int, width: int) -> DataFrame:
    """(u, v): enough links between the rows (g, x) of left and of right in each group g, or within left, to connect what links do.

    Groups are cut by hash into chunks of bounded size, and every chunk meets every one of the other side as one task; pairs aren't
    emitted.
    """
    sizes = bodies.select(F.col("cid").alias("x"), "n")
    texts_ = bodies.select(F.col("cid").alias("x"), "text")
    one = materialize(_chunked(left, sizes), "blocks")
    two = one if right is None else materialize(_chunked(right, sizes), "blocks")
    met = one.select("g", F.col("rows").alias("rows_a"), F.col("chunks").alias("a")).join(two.select("g", F.col("rows").alias("rows_b"), F.col("chunks").alias("b")), "g")
    # A row alone has nothing to meet within its group, but one row of each side is a pair.
    met = materialize(met.filter("rows_a > 1") if right is None else met, "blocks")

    def dealt(rows: DataFrame, weight: str, own: str, other: str) -> DataFrame:
        placed = join_dealt(rows, met, "g", weight, max(1, rows.count())).join(texts_, "x")
        mine = F.pmod(F.xxhash64("x"), F.col(own)).cast("int")
        if right is not None:
            facing = F.sequence(F.lit(0), F.col(other) - 1)
        else:
            facing = F.sequence(mine, F.col(other) - 1) if own == "a" else F.sequence(F.lit(0), mine)
        # Both sides may come from the same table; fresh names keep them apart.
        return placed.select(*[F.col(c).alias(c) for c in ("g", "x", "text")], mine.alias(f"at_{own}"), F.explode(facing).alias(f"at_{other}"))

    keys = ["g", "at_a", "at_b"]
    here = dealt(left, "rows_a", "a", "b").groupBy(*keys)
    there = dealt(left if right is None else right, "rows_b", "b", "a").groupBy(*keys)
    return here.cogroup(there).applyInArrow(_link_blocks(percent, width), "u long, v long").filter("u != v")


def near_groups(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(did, tk, n, component): every row's set size and the least id that it reaches over links of percent / 100 similarity or more; tk
    is a hash of its text."""
    tau = 1 - percent / 100
    m = collection_size(percent / 100)
    body = texts(docs, id_col, text_col).withColumn("tk", F.xxhash64("text"))
    signed = materialize(body.mapInArrow(_signer(m, width, seed), "did long, tk long, n long, skey binary, a array<long>, b array<long>"), "signed")
    filled = signed.filter("n > 0")

    # Rows of equal sets are one node, whatever their ids; cid is its number, rep and tk name one of its rows.
    classes = filled.groupBy("skey").agg(F.min(F.struct("did", "tk")).alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "skey", F.col("rep.did").alias("rep"), F.col("rep.tk").alias("tk"), "size", "n", "a", "b"), "classes")
    total = signed.count()
    base = classes.select("cid", "n", "a", "b")

    one = materialize(base.select("cid", F.explode("a").alias("key")), "first-keys")
    shared = materialize(one.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared-keys")
    alive = join_dealt(one, shared, "key", "size", total * m).select("cid").distinct()
    pair_keys = F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("key")
    tables = materialize(base.join(alive, "cid", "left_semi").select("cid", "n", pair_keys), "tables")
    repeated = materialize(tables.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "repeated-keys")
    member = materialize(join_dealt(tables, repeated, "key", "size", tables.count()).select("key", "cid", "n"), "members")

    picked = classes.select("cid", F.col("rep").alias("did"), "tk", "n").join(member.select("cid").distinct(), "cid", "left_semi")
    # Batches of rows of one task: an exchange by pid never meets more of them.
    bodies = body.join(picked.hint("merge"), ["did", "tk"]).dropDuplicates(["cid"]).select("cid", "n", "text", F.shiftright(F.monotonically_increasing_id(), BATCH_BITS).alias("pid"))
    bodies = materialize(bodies, "bodies")
    verify = _Verifier(bodies, width)
    # A node that has fewer than the needed share of its shingles in common with all candidates together links with none of them.
    counts = materialize(shared_counts(bodies, bodies.agg(F.sum("n")).first()[0] or 0, width), "shared")
    member = materialize(member.join(counts, "cid").filter(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n")), "members")

    def starred(rows: DataFrame) -> DataFrame:
        """rows with the centre p of their table: the node with the fewest shingles of its own. Tables of one node go."""
        order = (F.col("n") - F.col("shared")) * F.lit(2**32) + F.xxhash64("cid").bitwiseAND(F.lit(2**32 - 1))
        stats = rows.groupBy("key").agg(F.min_by("cid", order).alias("p"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        return materialize(join_dealt(rows, materialize(stats, "centres"), "key", "size", max(1, rows.count())), "starred")

    member = starred(member.select("key", "cid", "n", "shared"))
    tested = None
    for _ in range(ROUNDS):
        got = verify(member.filter("cid != p").select("p", F.col("cid").alias("x")))
        got = got.withColumn("link", F.lit(100) * F.col("both") >= F.lit(percent) * F.col("union")).withColumn("away", 1 - F.col("both") / F.col("union"))
        tested = got if tested is None else materialize(tested.unionByName(got), "tested")
        # Nodes that the centre of a table doesn't link stay in it and get a new centre.
        open_pairs = got.filter("not link").select("p", F.col("x").alias("cid"))
        member = starred(materialize(member.join(open_pairs, ["p", "cid"]).select("key", "cid", "n", "shared"), "left"))
        if member.isEmpty():
            break

    edges = tested.filter("link").select(F.col("p").alias("u"), F.col("x").alias("v"))
    comp = materialize(connected_components(edges), "components")
    # What stars leave open: a node that its centre doesn't link may link to one that it does, if the triangle inequality lets it.
    of = lambda df, col: df.join(comp.select(F.col("node").alias(col), F.col("component").alias(f"c_{col}")), col, "left").withColumn(f"c_{col}", F.coalesce(f"c_{col}", col))
    # All that a centre links are in its component, and so may the others be by now.
    far = of(of(tested.filter(~F.col("link") & (F.col("away") <= 2 * tau + 1e-9)).select(F.col("p").alias("g"), "x", "away"), "x"), "g").filter("c_x != c_g").select("g", "x", "away")
    close = tested.filter(F.col("link") & (F.col("away") > 0)).select(F.col("p").alias("g"), "x", "away")
    reach = close.groupBy("g").agg(F.max("away").alias("most"), F.count(F.lit(1)).alias("size"))
    far = materialize(far.join(reach.select("g", "most"), "g").filter(F.col("away") <= F.col("most") + tau + 1e-9), "far")
    need = far.groupBy("g").agg(F.min("away").alias("least")).join(reach.select("g", "size"), "g")
    close = materialize(join_dealt(close, materialize(need, "need"), "g", "size", max(1, tested.count())).filter(F.col("away") >= F.col("least") - tau - 1e-9).select("g", "x"), "close")
    more = links_in_blocks(bodies, far.select("g", "x"), close, percent, width)
    rest = materialize(member.select(F.col("p").alias("g"), F.col("cid").alias("x")).distinct(), "rest")
    more = materialize(more.unionByName(links_in_blocks(bodies, rest, None, percent, width)), "block-links")
    if not more.isEmpty():
        comp = materialize(connected_components(edges.unionByName(more)), "components")

    least = comp.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    named = least.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("nodes"))
    named = join_dealt(least, materialize(named, "least"), "component", "nodes", max(1, comp.count())).select(F.col("node").alias("cid"), "least")
    roots = classes.select("cid", "skey", "size", "rep").join(named, "cid", "left").select("skey", "size", F.coalesce("least", "rep").alias("component"))
    placed = join_dealt(filled.select("did", "tk", "n", "skey"), materialize(roots, "roots"), "skey", "size", total).select("did", "tk", "n", "component")
    return placed.unionByName(signed.filter("n = 0").select("did", "tk", "n", F.col("did").alias("component")))


def near_dedup(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Linked are rows whose sets of `width`-word shingles share percent / 100 of their union or more; component_id is the least doc_id
    that a row reaches over links, kept marks rows of that id. A pair that links is found unless its rows share no table key, which at
    the limit has a probability under 1e-4. Rows without words have an empty set and are linked with nothing; with fewer words than
    `width` the whole sequence is one shingle. Very long texts are taken whole. A null doc_id counts as the least id and comes back as
    null. Rows that repeat a doc_id are searched each for itself; equal texts share their component. Ties don't arise: centres of
    equal rank are ordered by hash and don't change the result. An empty table gives an empty result. Other columns, whatever their
    names, are ignored.
    """
    return near_groups(docs, percent, width, id_col, text_col).select(
        public_id("did").alias("doc_id"), F.col("n").alias("n_shingles"), public_id("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of the least doc_id of each group of near copies; all columns stay as they are.

    Nulls, empties, long texts and empty tables as in near_dedup. A row goes or stays by its own text; rows that repeat a doc_id and its
    text share their fate. Of a group whose least doc_id is repeated with different texts, all rows of that id stay.
    """
    stay = near_groups(docs, percent, width, id_col, text_col).filter("did = component").select("did", "tk").distinct()
    here = (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == stay.did) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == stay.tk)
    return docs.join(stay.hint("merge"), here, "left_semi")
