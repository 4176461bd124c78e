"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions near hits only, then checksums where a kind has one."""

from __future__ import annotations

import binascii
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import public_id, texts

#: Kinds in the order in which the results list them.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key")
BASE_KINDS = KINDS[:3]

_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyJ",),
    "private_key": ("-----BEGIN ",),
}
_ANCHORED = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
}
_HEX = re.compile(r"[0-9a-f]+")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {i: i + 32 for i in range(65, 91)}
_CLASS = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_HEX_MIN = 24


def checksum_holds(token: str) -> bool:
    """The last six characters of a prefixed token are the base-62 CRC-32 of the characters between prefix and checksum."""
    body, tail = token[4:-6], token[-6:]
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out == tail


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for kind, keys in _KEYWORDS.items():
        for w in keys:
            low = w.translate(_LOWER)
            had = words.get(low, ())
            words.add_word(low, (*had, (kind, w)))
    words.make_automaton()
    return words


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        return checksum_holds(m[0])
    return True


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of 24 or more hexadecimal digits: the automaton's keyword is the class, written as one letter."""
    mapped = text.encode("ascii", "replace").translate(_CLASS)
    needle, at = b"x" * _HEX_MIN, 0
    while (at := mapped.find(needle, at)) >= 0:
        m = _HEX.match(text, at)
        yield m.span()
        at = m.end()


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, in code points, sorted by start and kind.

    Matches of a kind are leftmost and don't overlap: a match that fails the kind's test still uses up its characters.
    """
    found, free = [], dict.fromkeys(KINDS, 0)
    starts: dict[str, list[int]] = {}
    for end, hits in words.iter(text.translate(_LOWER)):
        for kind, w in hits:
            start = end - len(w) + 1
            if kind == "assign" or text.startswith(w, start):
                starts.setdefault(kind, []).append(start)
    for kind, places in starts.items():
        for start in sorted(places):
            if start >= free[kind] and (m := _ANCHORED[kind].match(text, start)):
                free[kind] = m.end()
                if _passes(kind, m):
                    found.append((start, kind, m.end()))
    found += [(a, "hex", b) for a, b in _hex_runs(text)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return found


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _automaton()
    for b in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digest, joined = [], []
        for text in b.column(1).to_pylist():
            spans = scan(text, words)
            base = [x for x in spans if x[1] in BASE_KINDS]
            for k in KINDS:
                counts[k].append(sum(x[1] == k for x in spans))
            digest.append(hashlib.sha256(_join(base).encode()).hexdigest())
            joined.append(_join(spans))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(joined, pa.string())], ["did", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the number of spans of each kind (n_<kind>), base_sha256 and spans.

    spans lists kind:start:end of every find, in code points with the end exclusive, by start and then kind; base_sha256 is the
    SHA-256 of that list of the kinds assign, access and hex alone. Null texts count as empty; empty texts have empty lists; very long texts
    are scanned whole; finds that start at one place are ordered by kind; repeated rows give repeated rows; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    schema = "did long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    found = texts(docs, id_col, text_col).mapInArrow(_scanner, schema)
    return found.select(public_id("did").alias("doc_id"), *found.columns[1:])
