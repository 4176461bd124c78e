"""Packing token sequences by cutting-stock column generation.

Lengths fall into classes of STEP tokens; short lengths whose rounding would cost much are classes of their own. A linear program over patterns
(multisets of classes that fit one sequence) covers the length histogram; new patterns come from an unbounded knapsack over the
program's duals, whose items are chunks of equal pieces rounded up to STEP tokens together. Rounded-down pattern counts and a first-fit pass over
the few pieces that rounding leaves give whole patterns, and pieces take their places by their rank within their class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, public_id, texts
from .token_count import byte_letters

#: Tokens of a sequence, tokens of one length class, and tokens from which on lengths are rounded up to classes.
CAPACITY, STEP, FINE = 4096, 16, 256
#: Tokens of a piece of each class.
SIZES = np.concatenate([np.arange(1, FINE), np.arange(FINE, CAPACITY + 1, STEP)])
#: A short length is rounded up too if its padding is at most this share of all tokens.
SPARE = 1e-4
#: Equal pieces of a chunk at most, but for chunks that fill a sequence.
CHUNK = 16
#: Closes every document.
END = 2
#: Pieces ranked together.
PER_CHUNK = 2_000
#: Pieces whose ids a worker remembers.
MEMORY = 600_000


#: Texts of these characters alone, without "<|", need no normalisation but lower case, and fall apart by _PIECE as the tokenizer has it.
_PLAIN = re.compile(r"[\x20-\x7e\n\r\t\xc0-\xff]*")
# Fixed value: the tokenizer's pattern for lower-case text of those characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")


class PieceIds(dict):
    """Ids of a text's pieces as little-endian uint32 bytes, remembered up to a bound and asked of the model otherwise."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        tokens = self.model.tokenize("".join([self.letters[b] for b in piece.encode("utf-8")]))
        ids = self[piece] = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return ids


_KNOWN: dict[str, PieceIds] = {}


def known_pieces(path: str) -> PieceIds:
    """The worker process's own memory for a tokenizer file."""
    if path not in _KNOWN:
        _KNOWN[path] = PieceIds(path)
    return _KNOWN[path]


def document_ids(batch: list[str], known: PieceIds) -> Iterator[bytes]:
    """Each text's ids, END included, as little-endian uint32 bytes."""
    end = int(END).to_bytes(4, "little")
    for text in batch:
        if "<|" not in text and _PLAIN.fullmatch(text):
            yield b"".join(map(known.__getitem__, _PIECE.findall(text.lower()))) + end
        else:
            yield np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + end


def _cutter(path: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            known = known if known is not None else known_pieces(path)
            did, start, length, crc, total = [], [], [], [], []
            ids, body = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(ids), 256):
                for d, raw in zip(ids[i : i + 256], document_ids(body[i : i + 256], known), strict=True):
                    n = len(raw) // 4
                    for a in range(0, n, CAPACITY):
                        z = min(n, a + CAPACITY)
                        did.append(d)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * z]))
                        total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (did, start, length, crc, total)], ["did", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of classes 1..len(value) of total size `room` at most."""
    best, took = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    size = np.arange(1, len(value) + 1)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        k = min(w, len(value))
        gain = best[w - size[:k]] + value[:k]
        i = int(gain.argmax())
        if gain[i] > best[w] + 1e-12:
            best[w], took[w] = gain[i], i + 1
    pattern, w = np.zeros(len(value), dtype=np.int64), room
    while w > 0:
        if took[w]:
            pattern[took[w] - 1] += 1
            w -= took[w]
        else:
            w -= 1
    return float(best[room]), pattern


def merged_classes(held: np.ndarray) -> np.ndarray:
    """The class, from 1 on, that pieces of each class are packed as: their own, or the next multiple of STEP for rare short ones."""
    own = np.arange(1, len(held) + 1)
    up = -(-SIZES // STEP) * STEP
    cost = held * (up - SIZES)
    return np.where(cost > SPARE * (held @ SIZES), own, np.searchsorted(SIZES, up) + 1)


def chunk_items(sizes: np.ndarray, room: int, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class position, pieces, units) of every chunk: some equal pieces, rounded up to units together."""
    most = room // sizes
    rows = [(i, k, -(-int(k * sizes[i]) // unit)) for i in range(len(sizes)) for k in {*range(1, min(CHUNK, int(most[i])) + 1), int(most[i])}]
    at, many, units = np.array(rows, dtype=np.int64).T
    fits = units <= room // unit
    return at[fits], many[fits], units[fits]


def plan_patterns(demand: np.ndarray, room: int, sizes: np.ndarray | None = None, unit: int = 1, steps: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): together the patterns hold exactly demand[c] pieces of class c, of size sizes[c] (c + 1 by default) each.

    The program is solved to 1e-4 of its optimum over such patterns, or for `steps` columns; what it leaves open is filled in first fit,
    so the plan is whole in any case.
    """
    sizes = np.arange(1, len(demand) + 1) if sizes is None else sizes
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    m, own = len(used), sizes[used]
    at, many, units = chunk_items(own, room, unit)
    base = np.diag((room // own).astype(float))
    inverse, need = np.linalg.inv(base), demand[used].astype(float)
    for step in range(steps):
        if step % 40 == 39:
            inverse = np.linalg.inv(base)
        worth = inverse.sum(axis=0)[at] * many
        # The best chunk of each number of units: of repeated places the last one written stays.
        order = np.argsort(worth, kind="stable")
        chosen = np.full(room // unit + 1, -1)
        chosen[units[order]] = order
        value, taken = best_pattern(np.where(chosen >= 0, worth[chosen], 0.0)[1:], room // unit)
        if value <= 1 + 1e-4:
            break
        column = np.zeros(m)
        for u in np.flatnonzero(taken):
            column[at[chosen[u + 1]]] += taken[u] * many[chosen[u + 1]]
        x, move = inverse @ need, inverse @ column
        ratio = np.where(move > 1e-7, np.maximum(x, 0) / np.where(move > 1e-7, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        base[:, out] = column
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    x = np.linalg.solve(base, need)
    plan, left = [], demand.astype(np.int64).copy()
    for j in range(m):
        full = np.zeros(len(demand), dtype=np.int64)
        full[used] = np.rint(base[:, j]).astype(np.int64)
        times = int(np.floor(max(0.0, x[j]) + 1e-6))
        held = full > 0
        times = min(times, int((left[held] // full[held]).min()))
        if times > 0:
            plan.append((full, times))
            left -= full * times
    # First fit over the classes of the few pieces left, largest first; equal sequences in one go.
    while left.any():
        pattern, free = np.zeros(len(demand), dtype=np.int64), room
        for c in range(len(demand) - 1, -1, -1):
            k = min(int(left[c]), free // int(sizes[c]))
            if k:
                pattern[c], free = k, free - k * int(sizes[c])
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def _places(plan: list[tuple[np.ndarray, int]], classes: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: first ranks of its blocks, pieces a sequence in each block, first sequence of each block."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    at, rank = 0, np.zeros(classes, dtype=np.int64)
    for pattern, times in plan:
        for c in np.flatnonzero(pattern):
            out.setdefault(int(c) + 1, []).append((int(rank[c]), int(pattern[c]), at))
            rank[c] += int(pattern[c]) * times
        at += times
    return {c: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for c, rows in out.items()}


def _placer(places: dict):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            seq = np.empty(len(cls), dtype=np.int64)
            for c in np.unique(cls):
                own = cls == c
                first, each, start = places[int(c)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                seq[own] = start[k] + (rank[own] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "rank"), pa.array(seq)], [*(c for c in b.schema.names if c != "rank"), "sequence_id"])

    return place


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A document is its ids by the tokenizer file and then END; longer ones than CAPACITY are cut every CAPACITY ids. padded_length is
    the sequence's tokens if they are a power of two and CAPACITY otherwise. A null text counts as empty and gives one piece of one
    token. A null doc_id comes back as null; repeated rows are packed each; an empty table gives an empty result; other columns,
    whatever their names, are ignored. Very long texts are cut into as many pieces as they need. The driver holds the class histogram and the plan, which don't grow with the data.
    """
    classes = len(SIZES)
    pieces = texts(docs, id_col, text_col).mapInArrow(_cutter(tokenizer), "did long, start long, length long, ids_crc32 long, doc_tokens long")
    cls = F.when(F.col("length") < FINE, F.col("length")).otherwise(FINE + F.ceil((F.col("length") - FINE) / STEP))
    pieces = materialize(pieces.withColumn("cls", cls.cast("long")), "pieces")
    held = np.zeros(classes, dtype=np.int64)
    for r in pieces.groupBy("cls").count().collect():  # one row a class
        held[r.cls - 1] = r["count"]
    merged = merged_classes(held)
    pieces = pieces.withColumn("cls", F.element_at(F.array(*[F.lit(int(c)) for c in merged]), F.col("cls").cast("int")).cast("long"))
    demand = np.bincount(merged - 1, weights=held, minlength=classes).astype(np.int64)
    places = _places(plan_patterns(demand, CAPACITY, SIZES, STEP), classes)

    chunks = [max(1, -(-int(n) // PER_CHUNK)) for n in demand]
    many = F.element_at(F.array(*[F.lit(n) for n in chunks]), F.col("cls").cast("int"))
    order = ["did", "start", "ids_crc32"]
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64(*order), many))
    counts = materialize(dealt.groupBy("cls", "chunk").agg(F.count(F.lit(1)).alias("held")), "chunks")
    # Sums over chunks of a class: in blocks of chunks first, so that no task sorts all chunks.
    block = counts.withColumn("block", F.floor(F.col("chunk") / 1000))
    before_block = block.groupBy("cls", "block").agg(F.sum("held").alias("held")).select("cls", "block", (F.sum("held").over(Window.partitionBy("cls").orderBy("block")) - F.col("held")).alias("before"))
    inside = F.sum("held").over(Window.partitionBy("cls", "block").orderBy("chunk")) - F.col("held")
    starts = block.withColumn("inside", inside).join(before_block, ["cls", "block"]).select("cls", "chunk", (F.col("before") + F.col("inside")).alias("first"))
    number = F.row_number().over(Window.partitionBy("cls", "chunk").orderBy(*order)) - 1
    ranked = dealt.withColumn("number", number).join(starts, ["cls", "chunk"]).select("did", "start", "length", "ids_crc32", "doc_tokens", "cls", (F.col("first") + F.col("number")).cast("long").alias("rank"))
    placed = ranked.mapInArrow(_placer(places), "did long, start long, length long, ids_crc32 long, doc_tokens long, cls long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    out = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).withColumn("used", total)
    padded = F.when(F.bit_count("used") == 1, F.col("used")).otherwise(F.lit(CAPACITY)).cast("long")
    return out.select(public_id("did").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padded.alias("padded_length"))
