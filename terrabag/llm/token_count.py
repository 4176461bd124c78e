"""Token counts by a linear longest-match automaton.

The vocabulary's trie has failure links, as in linear-time WordPiece: when no child fits, the automaton has matched a prefix whose
greedy pieces are known, so it adds their precomputed number and goes on from the rest. Each character is read once, no piece is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import public_id, texts

#: Word counts that a worker remembers.
MEMORY = 500_000
_WORD = regex.compile(r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves, others follow from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str) -> list[bytes]:
    """Pieces of a tokenizer file as bytes; the mark of a word's end is byte 0xff, which UTF-8 doesn't use."""
    back = {c: b for b, c in enumerate(byte_letters())}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, out = model.get("end_of_word_suffix") or "", []
    for piece in model["vocab"]:
        ends = bool(suffix) and piece.endswith(suffix)
        body = piece[: -len(suffix)] if ends else piece
        if body and all(c in back for c in body) and (raw := bytes(back[c] for c in body)).find(b"\xff") < 0:
            out.append(raw + b"\xff" * ends)
    return out


class LongestMatch:
    """Counts the greedy longest-match pieces of a word in one pass."""

    def __init__(self, pieces: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        final, parent, symbol = [False], [0], [0]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[at][c] = nxt
                    self.child.append({})
                    final.append(False)
                    parent.append(at)
                    symbol.append(c)
                at = nxt
            final[at] = True
        # fail[v]: where the automaton stands after popping pieces off the string of v; pops[v]: how many; -1: nothing can be popped.
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n
        order = [0]
        for v in order:
            order.extend(self.child[v].values())
        for v in order[1:]:
            if final[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            u, c = parent[v], symbol[v]
            z, k = self.fail[u], self.pops[u]
            while z >= 0 and c not in self.child[z]:
                k += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.child[z][c], k

    def count(self, word: bytes) -> int:
        """Pieces of `word`, which ends in the end mark; a byte that no piece can begin with counts as one unknown piece."""
        at = total = 0
        for c in word:
            while c not in self.child[at]:
                if at == 0:
                    total += c != 255
                    break
                if self.fail[at] < 0:  # the vocabulary lacks a piece for the first byte held
                    return total + 1
                total += self.pops[at]
                at = self.fail[at]
            else:
                at = self.child[at][c]
        while at:
            if self.fail[at] < 0:
                return total + 1
            total += self.pops[at]
            at = self.fail[at]
        return total


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[word] = self.automaton.count(word.encode("utf-8") + b"\xff")
        return n


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            if known is None:
                known = _Counts(LongestMatch(load_vocabulary(path)))
            words, tokens = [], []
            for text in b.column(1).to_pylist():
                found = _WORD.findall(text.lower())
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["did", "n_words", "n_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_tokens.

    Words are runs of letters and marks, single digits or runs of other visible characters of the lower-cased text; each is cut greedily
    into the longest pieces of the vocabulary file. Null and empty texts have 0 of either; repeated rows are counted each; very long
    texts are counted whole; there are no ties, as the longest piece is one; an empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    found = texts(docs, id_col, text_col).mapInArrow(_counter(vocabulary), "did long, n_words long, n_tokens long")
    return found.select(public_id("did").alias("doc_id"), "n_words", "n_tokens")
