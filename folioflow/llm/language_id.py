"""Operator 3: language identification by words first, then character n-grams.

The model holds, per language, the log frequency of words and of character n-grams (5 to 1 letters,
with word borders). A known word is scored by its own frequencies; an unseen one by its longest known
n-grams, falling back to shorter ones. A text's languages are weighed by the sum over its words, and
the score is the share of the best one.

The model is fitted on a sample of labelled rows whose expected size per language is ``SAMPLE_DOCS``,
chosen by hashed id and text so that it depends on no order. Every word and n-gram of the sample is in
the model. It is kept compact: the sorted 64-bit hashes of its entries, and for each entry only the
languages that have it. Texts are predicted whole, from nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text
when nothing was learned; rows without lang are not learned from; ties go to the first language by
name; repeated rows are predicted each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

#: Expected labelled documents per language that the model is fitted on.
SAMPLE_DOCS = 2_000
LONGEST = 5
#: Bytes of scores of words that a Python worker keeps, letters of a kept word, and characters that are read at once.
CACHE_BYTES, CACHE_LETTERS, BLOCK = 24 << 20, 40, 1_000_000
#: Occurrences that every language is credited with, and the seed of Spark's xxhash64.
_SMOOTH, _SEED = 0.1, 42

_letters = re.compile(r"[^\W\d_]+")


def held_out(doc_id) -> F.Column:
    """Rows that the model never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The whole text in parts that end at a blank."""
    at = 0
    while len(text) - at > size:
        cut = re.compile(r"\s").search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _hashes(keys: list[str]) -> np.ndarray:
    """The values that Spark's xxhash64 gives, unsigned."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k.encode("utf-8", "surrogatepass"), _SEED) for k in keys), np.uint64, len(keys))


@dataclass
class Scores:
    """Log frequencies of entries by language: ``absent`` of a language without the entry, and what each that has it is above."""

    hashes: np.ndarray  # sorted, one for each entry
    first: np.ndarray  # where an entry's languages begin
    langs: np.ndarray
    above: np.ndarray
    absent: np.ndarray  # by language

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> Scores:
        """From the hash, language and count of each pair of entry and language."""
        order = np.lexsort((langs, keys))
        keys, langs, counts = keys[order], langs[order], counts[order].astype(np.float64)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        totals = np.bincount(langs, counts, n_langs)
        above = np.log((counts + _SMOOTH) / _SMOOTH).astype(np.float32)
        return cls(keys[new], np.append(np.flatnonzero(new), len(keys)).astype(np.int32), langs.astype(np.uint16), above, np.log(_SMOOTH / (totals + 1)).astype(np.float32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry's number, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, table: np.ndarray, rows: np.ndarray, entries: np.ndarray) -> None:
        """Adds the scores of each entry to its row of the table."""
        sizes = self.first[entries + 1] - self.first[entries]
        at = np.repeat(self.first[entries] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        np.add.at(table, (np.repeat(rows, sizes), self.langs[at]), self.above[at])
        np.add.at(table, rows, self.absent)


class Backoff:
    """Scores of words by language, from the model; scores of short words are kept up to ``CACHE_BYTES``."""

    def __init__(self, langs: list[str], words: Scores, grams: Scores):
        self.langs, self.words, self.grams = langs, words, grams
        self.most = max(1_000, CACHE_BYTES // (4 * len(langs) + 160))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)), np.float32)
        self.letters = np.zeros(1024, bool)

    def score(self, new: list[str]) -> np.ndarray:
        """A row of log frequencies for each word."""
        out = np.zeros((len(new), len(self.langs)), np.float32)
        entries = self.words.find(_hashes(new))
        known = np.flatnonzero(entries >= 0)
        self.words.add(out, known, entries[known])
        pending = np.flatnonzero(entries < 0)
        for n in range(LONGEST, 0, -1):
            framed = [f"_{new[i]}_" for i in pending]
            sizes = np.array([max(0, len(f) - n + 1) for f in framed], np.int64)
            grams = self.grams.find(_hashes([f[j : j + n] for f in framed for j in range(len(f) - n + 1)]))
            owner = np.repeat(pending, sizes)[grams >= 0]
            self.grams.add(out, owner, grams[grams >= 0])
            found = np.bincount(owner, minlength=len(new))
            out[found > 0] /= found[found > 0, None]
            pending = pending[found[pending] == 0]
            if not len(pending):
                break
        return out

    def learn(self, found: set[str]) -> None:
        """Score the words that are not known yet, all at once."""
        if len(self.place) > self.most:
            self.clear()
        new = list(found.difference(self.place))
        first = len(self.place)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.place.update(zip(new, range(first, first + len(new)), strict=True))
        self.letters[first : first + len(new)] = [any(map(str.isalpha, w)) for w in new]
        self.table[first : first + len(new)] = self.score(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; the words of ``BLOCK`` characters are scored together."""
        totals, any_letter = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            for part in blocks(text or ""):
                held.append((row, _letters.findall(part.lower())))
                size += len(part)
                if size >= BLOCK:
                    self._sum(held, totals, any_letter)
                    held, size = [], 0
        self._sum(held, totals, any_letter)
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        best = totals.argmax(axis=1)
        top = totals[np.arange(len(texts)), best]
        share = 1 / np.exp(np.minimum(totals - top[:, None], 0)).sum(axis=1)
        return [(self.langs[b], s) if ok else ("und", 0.0) for ok, b, s in zip(any_letter.tolist(), best.tolist(), share.tolist(), strict=True)]

    def _sum(self, held: list[tuple[int, list[str]]], totals: np.ndarray, any_letter: np.ndarray) -> None:
        found = set().union(*(words for _, words in held))
        self.learn(found)
        for row, words in held:
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                totals[row] += self.table[at].sum(axis=0, dtype=np.float64)
                any_letter[row] |= self.letters[at].any()
        if any(len(w) > CACHE_LETTERS for w in found):
            self.clear()


#: Languages, then the scores of words and of n-grams.
Model = tuple[list[str], Scores, Scores]


def fit(docs: DataFrame) -> Model:
    """The model of the labelled rows that are not held out."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        nothing = Scores.of(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), 0)
        return [], nothing, nothing
    by_lang = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in zip(langs, values, strict=True) for x in pair]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6
    sample = labelled.where(draw < by_lang([min(1.0, SAMPLE_DOCS / sizes[l]) for l in langs])).select("text", by_lang(list(range(len(langs)))).alias("lang"))
    tokens = sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word"))
    counts = tokens.groupBy("lang", "word").agg(F.count("*").alias("n"))
    framed = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    size = F.char_length(framed)

    def pieces(n: int) -> F.Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(framed, i, F.lit(n)))

    every = F.concat(*[pieces(n) for n in range(1, LONGEST + 1)])
    grams = counts.select("lang", "n", F.explode(F.transform(every, lambda g: F.xxhash64(g))).alias("h")).groupBy("lang", "h").agg(F.sum("n").alias("n"))

    def scores(df: DataFrame) -> Scores:
        # bounded by the sample; 20 bytes an entry and language
        got = df.select("h", F.col("lang").cast("int").alias("lang"), "n").toArrow()
        h, lang, n = (got.column(k).to_numpy() for k in range(3))
        return Scores.of(h.view(np.uint64), lang, n, len(langs))

    return langs, scores(counts.select("lang", "n", F.xxhash64("word").alias("h"))), scores(grams)


def predictor(docs: DataFrame):
    """A function from batches of texts to batches of <lang_pred, score>, with the model fitted on the table."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.StructArray]:
        model = Backoff(*shared.value)
        for texts in batches:
            got = model.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])
        del model
        release()

    return predict


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    predict = predictor(small_batches(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the batch whose texts are being read

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                held[:] = [batch]
                yield batch.column(2)

        for found in predict(texts()):
            yield pa.RecordBatch.from_arrays([*held[0].columns[:2], *found.flatten()], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """The documents that have a language; only texts go to Python."""
    predict = predictor(small_batches(docs))

    @F.arrow_udf("string")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in predict(batches):
            yield found.field("lang_pred")

    return docs.where(language("text") != "und")
