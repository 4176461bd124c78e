"""Removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Every window of WIDTH bytes has an anchor: the start of its least-hashed K bytes, the rightmost of equal ones. Equal windows have equal
anchors at equal offsets, so suffixes need to be indexed at anchors only. The entries of an array stand for suffixes, ordered by hashes
of their leading bytes rather than by the bytes, since only matches of a fixed length count. About BATCH bytes of a partition are a batch
with arrays of its own; the owner of a range of hashes takes in one batch after the other: a new array is merge-scanned with the levels it meets, and
levels merge when the new one is as large, so sizes grow geometrically.

Two such families are used. The first holds anchors and pieces (all bytes that the windows of one anchor cover): a piece that recurs has
only repeated windows, an anchor that doesn't recur has none. The second holds the single windows of what is left: pieces that don't recur
though their anchor does, and one copy of the recurring pieces around the same anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize, public_id, texts
from .shingles import mix

#: Bytes of a repeated string, and of an anchor's hash.
WIDTH, K = 200, 32
#: Bytes that are looked at together; an anchor's place within them takes PLACE_BITS bits.
CHUNK, PLACE_BITS = 1 << 20, 22
#: Entries that one owner handles, about; as many meet a batch's answers at a time.
PER_OWNER = 500_000
#: Entries of several batches that an owner sorts before it takes them in.
AT_ONCE = PER_OWNER // 8
#: Bytes of text in a batch, about, and bits of its number within a partition.
BATCH, BATCH_BITS = 1 << 24, 24

MARK = np.dtype([("key", "<u8"), ("piece", "<u8"), ("start", "<u4"), ("many", "<u2")])
SPAN = np.dtype([("start", "<u4"), ("many", "<u2"), ("code", "<u1")])
PIECE = np.dtype([("hash", "<u8"), ("check", "<u4"), ("row", "<u4"), ("twice", "<u1")])
ANCHOR = np.dtype([("hash", "<u8"), ("check", "<u4"), ("row", "<u4"), ("twice", "<u1")])
WINDOW = np.dtype([("hash", "<u8"), ("check", "<u4"), ("row", "<u1"), ("twice", "<u1")])
RECURS, RECURS_SENT, OPEN = 1, 2, 3

_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(0, 2**64, (3, 256), dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) | 1 for x in _RNG.integers(2**60, 2**63, 2)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """base ** i, or its inverse, modulo 2 ** 64, for i < n."""
    got = _POWERS.get((which, inverse))
    if got is None or len(got) < n:
        base = pow(_BASE[which], -1, 2**64) if inverse else _BASE[which]
        size = max(n, CHUNK + WIDTH + 1)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        got = _POWERS[which, inverse] = np.multiply.accumulate(got)
    return got[:n]


class Hashed:
    """Hashes of any range of a byte array in constant time."""

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[1 + which][data] * _powers(which, False, len(data)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _powers(self.which, True, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place, for K = 32, by doubling."""
    h, step = _TABLE[0][data], 1
    for i in range(5):
        h = h[:-step] * _MUL[i] + h[step:]
        step *= 2
    return mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def marks_of(docs: list[bytes]) -> list[np.ndarray]:
    """Each text's anchors in order: key, piece hash, first window and number of windows."""
    out = [np.empty(0, MARK) for _ in docs]
    parts: list[tuple[int, int, bytes]] = []  # text, first window, bytes
    for i, d in enumerate(docs):
        for a in range(0, len(d) - WIDTH + 1, CHUNK):
            parts.append((i, a, d[a : a + CHUNK + WIDTH - 1]))
    held: dict[int, list[np.ndarray]] = {}
    for lo, hi in blocks([len(p[2]) for p in parts], CHUNK):
        data = np.frombuffer(b"".join(p[2] for p in parts[lo:hi]), dtype=np.uint8)
        sizes = np.array([len(p[2]) for p in parts[lo:hi]])
        begin = np.cumsum(sizes) - sizes
        gram = _grams(data)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = _least((gram & ~low) | (low - np.arange(len(gram), dtype=np.uint64)), WIDTH - K + 1)
        place = (low - (least & low)).astype(np.int64)
        windows = sizes - WIDTH + 1
        own = np.repeat(np.arange(len(sizes)), windows)
        s = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
        at = place[s]
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])]))
        many = np.diff(np.append(head, len(s)))
        first = s[head]
        m = np.empty(len(head), MARK)
        m["key"] = gram[at[head]]
        m["piece"] = Hashed(data, 0)(first, first + many - 1 + WIDTH)
        m["start"] = first - begin[own[head]] + np.array([p[1] for p in parts[lo:hi]])[own[head]]
        m["many"] = many
        for j, x in zip(range(lo, hi), np.split(m, np.flatnonzero(np.diff(own[head])) + 1), strict=True):
            held.setdefault(parts[j][0], []).append(x)
    for i, xs in held.items():
        out[i] = np.concatenate(xs)
    return out


# ---- arrays and levels


def _sorted_by(column: np.ndarray, runs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, values) of a sort; `runs`: the column is a few sorted runs, which a stable sort only merges."""
    values = np.ascontiguousarray(column)
    order = np.argsort(values, kind="stable" if runs else None)
    return order, values[order]


def _reduced(how: np.ufunc, column: np.ndarray, order: np.ndarray, head: np.ndarray) -> np.ndarray:
    return how.reduceat(np.ascontiguousarray(column)[order], head)


def fold(entries: np.ndarray, runs: bool = False) -> np.ndarray:
    """Sorted distinct entries by (hash, check): the least row, and whether there was more than one entry."""
    if not len(entries):
        return entries
    order, h = _sorted_by(entries["hash"], runs)
    check = np.ascontiguousarray(entries["check"])
    c, same = check[order], h[1:] == h[:-1]
    if np.any(same & (c[1:] != c[:-1])):  # a 64-bit hash of different strings: sort by both
        order = np.lexsort((check, entries["hash"]))
        c = check[order]
    head = np.flatnonzero(np.concatenate([[True], ~same | (c[1:] != c[:-1])]))
    out = entries[order[head]]
    out["row"] = _reduced(np.minimum, entries["row"], order, head)
    out["twice"] = np.maximum(_reduced(np.maximum, entries["twice"], order, head), np.diff(np.append(head, len(order))) > 1)
    return out


class Levels:
    """The index family: sorted arrays of falling size; taking in a new one merges those that aren't larger."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def take(self, array: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) <= len(array):
            array = fold(np.concatenate([self.levels.pop(), array]), True)
        self.levels.append(array)

    def all(self) -> np.ndarray:
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels[-1] = fold(np.concatenate([self.levels[-1], last]), True)
        return self.levels[0] if self.levels else np.empty(0, WINDOW)


def find(table: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Position in the sorted distinct table of each (hash, check); all of them are there."""
    at = np.searchsorted(np.ascontiguousarray(table["hash"]), np.ascontiguousarray(hashes))
    wrong = np.flatnonzero(table["check"][np.minimum(at, len(table) - 1)] != checks)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[table["check"][np.minimum(at[wrong], len(table) - 1)] != checks[wrong]]
    return at


def _by_owner(entries: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    owner = (entries["hash"] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for part in np.split(entries, cuts) if len(entries) else ():
        yield int(part["hash"][0] >> np.uint64(64 - bits)), part


def piece_entries(marks: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and anchor entries of marks; an anchor's check is kept in `row`, so that fold() tells whether all its pieces agree."""
    p, a = np.zeros(len(marks), PIECE), np.zeros(len(marks), ANCHOR)
    p["hash"], p["check"], p["row"] = mix(marks["piece"] ^ (marks["key"] * _MUL[6])), marks["key"] & np.uint64(0xFFFFFFFF), rows
    # Keys are the least of many hashes: unmixed, the first owners would get most of them.
    a["hash"], a["row"] = mix(marks["key"] ^ _MUL[5]), marks["piece"] & np.uint64(0xFFFFFFFF)
    return p, a


def fold_anchors(entries: np.ndarray, runs: bool = False) -> np.ndarray:
    """Sorted distinct anchors: twice bit 0: more than one entry; bit 1: entries of different pieces."""
    if not len(entries):
        return entries
    order, h = _sorted_by(entries["hash"], runs)
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    out = entries[order[head]]
    low, high = _reduced(np.minimum, entries["row"], order, head), _reduced(np.maximum, entries["row"], order, head)
    more = np.diff(np.append(head, len(order))) > 1
    out["row"], out["twice"] = low, _reduced(np.bitwise_or, entries["twice"], order, head) | more | ((low != high) * 2)
    return out


class AnchorLevels(Levels):
    def take(self, array: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) <= len(array):
            array = fold_anchors(np.concatenate([self.levels.pop(), array]), True)
        self.levels.append(array)

    def all(self) -> np.ndarray:
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels[-1] = fold_anchors(np.concatenate([self.levels[-1], last]), True)
        return self.levels[0] if self.levels else np.empty(0, ANCHOR)


def _owners(entries: int) -> int:
    bits = 6
    while (1 << bits) * PER_OWNER < entries:
        bits += 1
    return bits


def _table(columns: dict, types: dict) -> pa.Table:
    return pa.table({k: pa.array(v, types[k]) for k, v in columns.items()})


# ---- first family: anchors and pieces


def _batched(most: int):
    """Rows of a partition, whose `pid` is the partition's number, with that of their batch instead: `most` bytes of text, by `size`."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            if b.num_rows:
                size = b.column("size").to_numpy()
                ends = done + np.cumsum(size)
                pid = (b.column("pid").to_numpy() << BATCH_BITS) + (ends - size) // most
                done = int(ends[-1])
                yield b.set_column(b.schema.get_field_index("pid"), "pid", pa.array(pid, pa.int64()))

    return number


def _marker(most: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batched(most)(batches):
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                marks = marks_of([x.encode("utf-8") for x in part.column("text").to_pylist()])
                cols = [part.column(c) for c in ("pid", "did", "tk", "size", "sha")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([m.tobytes() for m in marks], pa.binary())], ["pid", "did", "tk", "size", "sha", "marks"])

    return mark


def _read(raw: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(raw, kind) if raw else np.empty(0, kind)


def _numbers(table, name: str) -> np.ndarray:
    return np.array(table.column(name).to_numpy(), dtype=np.int64).view(np.uint64)


def _unpack(table) -> tuple[np.ndarray, np.ndarray]:
    """All marks of a table in one array, and for each the hash of its row's id and text."""
    marks = table.column("marks").to_pylist()
    row = mix(_numbers(table, "tk") ^ (_numbers(table, "did") * _MUL[7])) >> np.uint64(32)
    return _read(b"".join(marks), MARK), np.repeat(row.astype(np.uint32), [len(x) // MARK.itemsize for x in marks])


def _send_marks(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pids = b.column("pid").to_numpy()
            for pid in np.unique(pids):
                own = b.filter(pa.array(pids == pid))
                p, a = piece_entries(*_unpack(own))
                rows = [(int(pid), o, 0, x.tobytes()) for o, x in _by_owner(fold(p), bits)] + [(int(pid), o, 1, x.tobytes()) for o, x in _by_owner(fold_anchors(a), bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["pid", "owner", "kind", "run"])

    return send


def _arrays(runs: list[bytes], kind: np.dtype, folded) -> Iterator[np.ndarray]:
    """The runs of consecutive batches as arrays of AT_ONCE entries or of one run: merges grow with the number of arrays."""
    for lo, hi in blocks([len(x) // kind.itemsize for x in runs], AT_ONCE):
        yield _read(runs[lo], kind) if hi == lo + 1 else folded(_read(b"".join(runs[lo:hi]), kind))


def _answers(whole: np.ndarray, asked: list[np.ndarray]) -> list[bytes]:
    """What `whole` has of each of the arrays and recurs. All are looked up at once: a look-up goes through the table, an owner has as many
    arrays as there are batches."""
    if not asked:
        return []
    mine = np.concatenate(asked)
    got = whole[find(whole, mine["hash"], mine["check"])] if len(mine) else mine
    return [x[x["twice"] > 0].tobytes() for x in np.split(got, np.cumsum([len(x) for x in asked])[:-1])]


def _own_marks(table: pa.Table) -> pa.Table:
    """Tell every batch which of its pieces recur (and whose row sends them), and which of its anchors recur, with one piece or more."""
    pids, kinds, runs = (table.column(c).to_pylist() for c in ("pid", "kind", "run"))
    out = [b""] * len(runs)
    for k, (family, folded) in enumerate(((Levels(), fold), (AnchorLevels(), fold_anchors))):
        own = [i for i, kind in enumerate(kinds) if kind == k]
        for array in _arrays([runs[i] for i in own], PIECE, folded):
            family.take(array)
        for i, answer in zip(own, _answers(family.all(), [_read(runs[i], PIECE) for i in own]), strict=True):
            out[i] = answer
    return _table({"pid": pids, "kind": kinds, "answer": out}, {"pid": pa.int64(), "kind": pa.int64(), "answer": pa.binary()})


def _look(table: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Position of each (hash, check) in the sorted distinct table, or -1."""
    if not len(table):
        return np.full(len(hashes), -1)
    hashes, checks = np.ascontiguousarray(hashes), np.ascontiguousarray(checks)
    known, marks = np.ascontiguousarray(table["hash"]), np.ascontiguousarray(table["check"])
    at = np.searchsorted(known, hashes)
    near = np.minimum(at, len(known) - 1)
    met = known[near] == hashes
    hit = met & (marks[near] == checks)
    out = np.where(hit, near, -1)
    open_ = np.flatnonzero(met & ~hit)
    at[open_] += 1
    while len(open_):
        open_ = open_[at[open_] < len(table)]
        open_ = open_[known[at[open_]] == hashes[open_]]
        hit = marks[at[open_]] == checks[open_]
        out[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
        at[open_] += 1
    return out


def _code_marks(rows: pa.Table, answers: pa.Table) -> pa.Table:
    raw = rows.column("marks").to_pylist()
    marks, owner = _unpack(rows)
    said = {0: [], 1: []}
    for kind, x in zip(answers.column("kind").to_pylist(), answers.column("answer").to_pylist(), strict=True):
        said[kind].append(x)
    pieces, anchors = fold(_read(b"".join(said[0]), PIECE)), _read(b"".join(said[1]), ANCHOR)
    anchors = anchors[np.argsort(anchors["hash"], kind="stable")]
    p, a = piece_entries(marks, owner)
    at_p, at_a = _look(pieces, p["hash"], p["check"]), _look(anchors, a["hash"], a["check"])
    code = np.zeros(len(marks), np.uint8)
    code[(at_p < 0) & (at_a >= 0)] = OPEN
    code[at_p >= 0] = RECURS
    if len(pieces) and len(anchors):
        mixed = (at_p >= 0) & (at_a >= 0) & (anchors["twice"][np.maximum(at_a, 0)] >= 2) & (pieces["row"][np.maximum(at_p, 0)] == owner)
        code[mixed] = RECURS_SENT
    spans = np.zeros(len(marks), SPAN)
    spans["start"], spans["many"], spans["code"] = marks["start"], marks["many"], code
    blobs, state, emit, i = [], [], [], 0
    for x in raw:
        n = len(x) // MARK.itemsize
        own = spans[i : i + n]
        i += n
        own = own[own["code"] > 0]
        blobs.append(own.tobytes())
        state.append(int(own["code"].max()) if len(own) else 0)
        emit.append(int(own["many"][own["code"] >= RECURS_SENT].sum(dtype=np.int64)))
    out = rows.drop_columns(["pid", "marks"])
    return out.append_column("spans", pa.array(blobs, pa.binary())).append_column("state", pa.array(state, pa.int64())).append_column("emit", pa.array(emit, pa.int64()))


# ---- second family: single windows


def _window_entries(data: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, entries, open) of all windows of spans that are sent."""
    spans = spans[spans["code"] >= RECURS_SENT]
    many = spans["many"].astype(np.int64)
    start = np.repeat(spans["start"].astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    e = np.zeros(len(start), WINDOW)
    open_ = np.repeat(spans["code"] == OPEN, many)
    for i in range(0, len(data), CHUNK):
        own = np.flatnonzero((start >= i) & (start < i + CHUNK))
        if len(own):
            part = np.frombuffer(data, np.uint8)[i : i + CHUNK + WIDTH - 1]
            e["hash"][own] = Hashed(part, 0)(start[own] - i, start[own] - i + WIDTH)
            e["check"][own] = Hashed(part, 1)(start[own] - i, start[own] - i + WIDTH) >> np.uint64(32)
    e["twice"] = ~open_
    e["row"] = ~open_  # 0 once folded: some batch asks about this window
    return start, e, open_


def _send_windows(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, Levels()

        def runs() -> Iterator[pa.RecordBatch]:
            rows = [(at, o, x.tobytes()) for o, x in _by_owner(levels.all(), bits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["pid", "owner", "run"])

        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                fresh: dict[int, list[np.ndarray]] = {}
                for pid, text, raw in zip(*(part.column(c).to_pylist() for c in ("pid", "text", "spans")), strict=True):
                    fresh.setdefault(pid, []).append(_window_entries(text.encode("utf-8"), _read(raw, SPAN))[1])
                for pid, xs in fresh.items():
                    if pid != at:  # a batch's rows follow one another, so only one is held; one met again sends another run
                        yield from runs()
                        at, levels = pid, Levels()
                    levels.take(fold(np.concatenate(xs)))
        yield from runs()

    return send


def _own_windows(table: pa.Table) -> pa.Table:
    pids, runs = (table.column(c).to_pylist() for c in ("pid", "run"))
    family = Levels()
    for array in _arrays(runs, WINDOW, fold):
        family.take(array)
    asked = []
    for run in runs:
        mine = _read(run, WINDOW)
        asked.append(mine[mine["row"] == 0])
    return _table({"pid": pids, "answer": _answers(family.all(), asked)}, {"pid": pa.int64(), "answer": pa.binary()})


def _finished(did, data: bytes, repeated: np.ndarray) -> tuple:
    """Result columns of a text from the starts of its repeated windows."""
    flag = np.zeros(len(data) + 1, bool)
    flag[repeated] = True
    starts = np.flatnonzero(flag)
    split = np.flatnonzero(np.diff(starts) > WIDTH) + 1
    begin = starts[np.concatenate([[0], split])].tolist() if len(starts) else []
    end = (starts[np.concatenate([split - 1, [len(starts) - 1]])] + WIDTH).tolist() if len(starts) else []
    kept = b"".join(data[x:y] for x, y in zip([0, *end], [*begin, len(data)], strict=True))
    return did, len(data), len(data) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()


_OUT = {"did": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
_OUT_SQL = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _starts(spans: np.ndarray) -> np.ndarray:
    many = spans["many"].astype(np.int64)
    return np.repeat(spans["start"].astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _finish_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for did, text, raw in zip(*(b.column(c).to_pylist() for c in ("did", "text", "spans")), strict=True):
            rows.append(_finished(did, text.encode("utf-8"), _starts(_read(raw, SPAN))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.values(), strict=True)], list(_OUT))


def _finish_open(rows: pa.Table, answers: pa.Table) -> pa.Table:
    known = fold(_read(b"".join(answers.column("answer").to_pylist()), WINDOW))
    dids, bodies, raws = (rows.column(c).to_pylist() for c in ("did", "text", "spans"))
    out = []
    # Many texts are looked up at once, as a look-up goes through the table.
    for lo, hi in blocks([int(s["many"][s["code"] == OPEN].sum(dtype=np.int64)) for s in (_read(x, SPAN) for x in raws)], PER_OWNER):
        entries, plain, where = [], [], []
        for text, raw in zip(bodies[lo:hi], raws[lo:hi], strict=True):
            spans = _read(raw, SPAN)
            start, e, _ = _window_entries(text.encode("utf-8"), spans[spans["code"] == OPEN])
            entries.append(e)
            where.append(start)
            plain.append(_starts(spans[spans["code"] != OPEN]))
        every = np.concatenate(entries)
        hits = np.split(_look(known, every["hash"], every["check"]) >= 0, np.cumsum([len(e) for e in entries])[:-1])
        for did, text, hit, start, sure in zip(dids[lo:hi], bodies[lo:hi], hits, where, plain, strict=True):
            out.append(_finished(did, text.encode("utf-8"), np.concatenate([sure, start[hit]])))
    cols = list(zip(*out, strict=True)) or [[] for _ in _OUT]
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(_OUT.items(), cols, strict=True)})


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of the UTF-8 text covered by a WIDTH-byte string that also starts anywhere else, in the same document too;
    matches don't cross documents and are judged on the input. n_spans counts maximal removed runs; kept_sha256 is that of the bytes
    that remain. A null text counts as empty; texts under WIDTH bytes stay whole. A null doc_id comes back as null; repeated rows are
    documents of their own, so their strings recur. Very long texts are taken whole, CHUNK bytes at a time. Of equal strings all go, so
    ties don't arise. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    body = texts(docs, id_col, text_col).withColumn("tk", F.xxhash64("text"))
    sized = body.withColumn("pid", F.shiftright(F.monotonically_increasing_id(), 33)).withColumn("size", F.octet_length("text").cast("long")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    marked = materialize(sized.select("pid", "did", "tk", "size", "sha", "text").mapInArrow(_marker(BATCH), "pid long, did long, tk long, size long, sha binary, marks binary"), "op4-marks")
    bits = _owners((marked.agg(F.sum(F.length("marks"))).first()[0] or 0) // MARK.itemsize * 2)
    runs = marked.select("pid", "did", "tk", "marks").mapInArrow(_send_marks(bits), "pid long, owner long, kind long, run binary")
    answers = runs.groupBy("owner").applyInArrow(_own_marks, "pid long, kind long, answer binary")
    coded = marked.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_code_marks, "did long, tk long, size long, sha binary, spans binary, state long, emit long")
    coded = materialize(coded, "op4-codes")
    clean = coded.filter("state = 0").select("did", F.col("size").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"))

    touched = coded.filter("state > 0").groupBy("did", "tk").agg(F.max("spans").alias("spans"), F.max("state").alias("state"), F.max("emit").alias("emit"))
    found = body.join(touched.hint("merge"), ["did", "tk"]).withColumn("pid", F.shiftright(F.monotonically_increasing_id(), 33)).withColumn("size", F.octet_length("text").cast("long"))
    found = materialize(found.select("pid", "did", "size", "text", "spans", "state", "emit").mapInArrow(_batched(BATCH), "pid long, did long, size long, text string, spans binary, state long, emit long"), "op4-touched")
    plain = found.filter(F.col("state") < OPEN).select("did", "text", "spans").mapInArrow(_finish_plain, _OUT_SQL)
    bits = _owners(found.agg(F.sum("emit")).first()[0] or 0)
    sent = found.filter("emit > 0").select("pid", "text", "spans").mapInArrow(_send_windows(bits), "pid long, owner long, run binary")
    answers = sent.groupBy("owner").applyInArrow(_own_windows, "pid long, answer binary")
    open_ = found.filter(F.col("state") == OPEN).select("pid", "did", "text", "spans")
    settled = open_.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_finish_open, _OUT_SQL)
    out = clean.unionByName(plain).unionByName(settled)
    return out.select(public_id("did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
