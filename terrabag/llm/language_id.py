"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram binds (multiplies) its letters' vectors, each rolled by its place; a text
bundles (adds) the vectors of its trigrams; a language's prototype bundles the unit vectors of its labelled texts. The prediction is
the prototype with the largest cosine.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import public_id, small_batches, texts

#: Components of a vector.
DIMENSIONS = 1024
#: Bits of a letter's code; 0 stands for anything that is no letter.
CODE_BITS = 21
MASK = (1 << CODE_BITS) - 1
#: Texts, and about their letters, that are bundled together; trigrams whose vectors are held at a time.
GROUP, GROUP_LETTERS, HELD = 64, 1 << 20, 4096
#: Partial sums of a language that are added up apart before the last step.
SPREAD = 32
UNKNOWN = "und"
_CODES: np.ndarray | None = None


def letter_codes() -> np.ndarray:
    """Code of each code point: 0 if it is no letter, else that of its lower-case letter."""
    global _CODES
    if _CODES is None:
        codes = np.zeros(0x110000, dtype=np.int32)
        for i in range(0x110000):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                codes[i] = ord(c.lower()[0])
        _CODES = codes
    return _CODES


class Letters:
    """The vectors of letters, made from a hash of seed and letter when they are first asked for: every letter of every script has its own."""

    def __init__(self, seed: int):
        self.seed, self.slot, self.table = seed, np.full(0x110000, -1, dtype=np.int32), np.empty((0, DIMENSIONS), dtype=np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.slot[codes] < 0])
        if len(new):
            bits = [np.unpackbits(np.frombuffer(hashlib.shake_256(f"{self.seed}:{c}".encode()).digest(DIMENSIONS // 8), np.uint8)) for c in new.tolist()]
            self.slot[new] = np.arange(len(self.table), len(self.table) + len(new))
            self.table = np.concatenate([self.table, np.array(bits, dtype=np.int8) * 2 - 1])
        return self.table[self.slot[codes]]


class Encoder:
    """Texts to vectors."""

    def __init__(self, seed: int):
        self.codes, self.letters = letter_codes(), Letters(seed)

    def trigrams(self, text: str) -> np.ndarray:
        """Trigram codes over letters, with every run of other characters as one gap; empty if the text has no letters."""
        c = self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
        if not c.any():
            return np.empty(0, dtype=np.int64)
        c = np.concatenate([[0], c, [0]]).astype(np.int64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        return (c[:-2] << 2 * CODE_BITS) | (c[1:-1] << CODE_BITS) | c[2:]

    def bundle(self, grams: list[np.ndarray]) -> np.ndarray:
        """One unit vector for each list of trigram codes; zeros for an empty one."""
        out = np.zeros((len(grams), DIMENSIONS), dtype=np.float32)
        if len(grams) == 1:  # a long text, in parts
            for i in range(0, len(grams[0]), GROUP_LETTERS):
                self._add(out, [grams[0][i : i + GROUP_LETTERS]])
        else:
            self._add(out, grams)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    def _add(self, out: np.ndarray, grams: list[np.ndarray]) -> None:
        sizes = [len(g) for g in grams]
        if not sum(sizes):
            return
        codes = np.concatenate(grams)
        order = np.argsort(codes)
        codes, owner = codes[order], np.repeat(np.arange(len(grams), dtype=np.int32), sizes)[order]
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        values, where = codes[new], np.cumsum(new) - 1
        for i in range(0, len(values), HELD):
            v = values[i : i + HELD]
            here = slice(*np.searchsorted(where, [i, i + len(v)]))
            count = np.bincount(owner[here] * len(v) + where[here] - i, minlength=len(grams) * len(v)).reshape(len(grams), -1).astype(np.float32)
            bound = self.letters(v & MASK) * np.roll(self.letters((v >> CODE_BITS) & MASK), 1, axis=1) * np.roll(self.letters(v >> 2 * CODE_BITS), 2, axis=1)
            out += count @ bound.astype(np.float32)

    def groups(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(position, trigram lists) of texts, some at a time; a null text counts as empty."""
        start, grams, letters = 0, [], 0
        for i in range(0, len(texts), GROUP):
            for text in texts.slice(i, GROUP).to_pylist():
                own = self.trigrams(text or "")
                if grams and (len(grams) == GROUP or letters + len(own) > GROUP_LETTERS):
                    yield start, grams
                    start, grams, letters = start + len(grams), [], 0
                grams.append(own)
                letters += len(own)
        if grams:
            yield start, grams


def _summer(seed: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total, rows = Encoder(seed), {}, {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for i, grams in encoder.groups(b.column("text")):
                vectors, own = encoder.bundle(grams), langs[i : i + len(grams)]
                for lang in set(own):
                    total[lang] = total.get(lang, 0) + vectors[own == lang].sum(axis=0, dtype=np.float64)
                    rows[lang] = rows.get(lang, 0) + int((own == lang).sum())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary()), pa.array([rows[k] for k in total], pa.int64())], ["lang", "sum", "n"])

    return add


def _merge(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table.column("sum").to_pylist()], axis=0)
    return pa.table({"lang": table.column("lang")[:1], "sum": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})


class LanguageModel:
    """Prototypes by language; a prototype is what its language has beside the mean of all."""

    def __init__(self, langs: list[str], prototypes: np.ndarray, mean: np.ndarray, seed: int):
        self.langs, self.prototypes, self.mean, self.seed = langs, prototypes, mean, seed

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(did, lang_pred, score) of every row; the score is the cosine mapped to 0..1; UNKNOWN with score 0 for texts without letters."""
        body = texts(docs, id_col, text_col)
        return body.mapInArrow(self._predictor(), "did long, lang_pred string, score double")

    def keep(self, docs: DataFrame, min_score: float, min_letters: int, text_col: str = "text") -> DataFrame:
        """The rows of docs whose text has a language: one with letters and, from min_letters on, a score of min_score or more."""
        small_batches(docs.sparkSession)
        names, predict, at = docs.columns, self._predictor(), docs.columns.index(text_col)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = letter_codes()
            for b in batches:
                one = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(at)], ["did", "text"])
                (found,) = predict(iter([one]))
                texts = (t or "" for i in range(0, b.num_rows, GROUP) for t in b.column(at).slice(i, GROUP).to_pylist())
                letters = np.array([np.count_nonzero(codes[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)]) for t in texts])
                score, known = found.column("score").to_numpy(), np.array(found.column("lang_pred").to_pylist(), dtype=object) != UNKNOWN
                yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array(known & ((letters < min_letters) | (score >= min_score))))

        return docs.mapInArrow(choose, docs.schema)

    def _predictor(self):
        langs, prototypes, mean, seed = self.langs, self.prototypes.astype(np.float32), self.mean.astype(np.float32), self.seed

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = Encoder(seed)
            for b in batches:
                names, scores = [], []
                for _, grams in encoder.groups(b.column(1)):
                    vectors = encoder.bundle(grams)
                    centred = vectors - mean
                    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
                    cosine = centred @ prototypes.T if langs else np.zeros((len(grams), 0))
                    for g, row in zip(grams, cosine, strict=True):
                        if len(g) and langs:
                            names.append(langs[int(row.argmax())])
                            scores.append(float(min(1.0, max(0.0, (float(row.max()) + 1) / 2))))
                        else:
                            names.append(UNKNOWN)
                            scores.append(0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["did", "lang_pred", "score"])

        return predict


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 7) -> LanguageModel:
    """A model of every language in the rows whose text and language aren't null.

    Each partition sends one vector a language, which are summed in two steps; the driver gets one vector a language. Ties go to the
    language that comes first by name. Without labelled rows every prediction is UNKNOWN.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("text is not null and lang is not null")
    part = rows.mapInArrow(_summer(seed), "lang string, sum binary, n long")
    part = part.withColumn("salt", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(SPREAD)))
    once = part.groupBy("lang", "salt").applyInArrow(_merge, "lang string, sum binary, n long")
    sums = sorted((r.lang, np.frombuffer(bytes(r["sum"])), r.n) for r in once.groupBy("lang").applyInArrow(_merge, "lang string, sum binary, n long").collect())
    if not sums:
        return LanguageModel([], np.zeros((0, DIMENSIONS)), np.zeros(DIMENSIONS), seed)
    each = np.array([v / n for _, v, n in sums])
    mean = each.mean(axis=0) if len(sums) > 1 else np.zeros(DIMENSIONS)
    each = each - mean
    return LanguageModel([k for k, _, _ in sums], each / np.maximum(np.linalg.norm(each, axis=1, keepdims=True), 1e-12), mean, seed)


def keep_known_languages(docs: DataFrame, min_score: float = 0.6, min_letters: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without rows that language ID rejects: null texts, texts without letters, and texts of min_letters letters or more whose best
    score is under min_score. Short texts with letters stay, as their scores say little. All columns stay as they are."""
    model = fit_languages(docs.filter(~held_out(docs[id_col])), text_col, lang_col)
    return model.keep(docs, min_score, min_letters, text_col)


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    The model learns from text and language of the rows that aren't held out. lang_pred is UNKNOWN, with score 0, where the text is
    null, empty or has no letters. Very long texts are taken whole. Of languages with equal cosines the first by name counts. A null
    doc_id isn't held out. Repeated rows give repeated rows; an empty table gives an empty result; other columns, whatever their names,
    are ignored.
    """
    model = fit_languages(docs.filter(~held_out(docs[id_col])), text_col, lang_col)
    found = model.predict(docs, id_col, text_col)
    doc_id = public_id("did")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score")
