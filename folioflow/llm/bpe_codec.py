"""Operator 2: BPE encoding and decoding through a pair occurrence index.

The distinct words of a partition's batch are merged together. An index maps each adjacent pair of
symbols to every position where it stands; the pair of the lowest active rank is taken, merged at
all its positions from left to right, and the lists of the neighbouring pairs are updated.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows are
encoded each; other columns of the input, whatever their names, are not read; a very long text is
encoded whole, since only its distinct words are held besides the text itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Words of a generation; a Python worker keeps the encodings of two, and what is used again moves to the younger.
CACHE_WORDS = 150_000

_codecs: dict[str, PairIndexCodec] = {}


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexCodec:
    """Encoder and decoder of a tokenizers file with a BPE model and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.vocab | self.special
        self.names = {i: s for s, i in names.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.bytes = byte_symbols()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.blank = regex.compile(r"\s+")
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def normalized(self, text: str) -> str:
        """NFC, runs of white space to one space, lower case by single characters."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = self.blank.sub(" ", text)
        if "Σ" in text:  # str.lower() looks at a sigma's place in its word
            return "σ".join(part.lower() for part in text.split("Σ"))
        return text.lower()

    def split(self, text: str) -> list[str]:
        """Words of a text, with special tokens as words of their own."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pieces.findall(self.normalized(text))
        found: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                found.append(part)
            else:
                found += self.pieces.findall(self.normalized(part))
        return found

    def merge(self, batch: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word, by one index over the positions of all of them."""
        todo = list(batch)
        symbols: list[int] = []
        left: list[int] = []
        right: list[int] = []
        heads: list[int] = []
        vocab, table, suffix = self.vocab, self.bytes, self.suffix
        for word in todo:
            chars = [table[b] for b in word.encode("utf-8", "surrogatepass")]
            chars[-1] += suffix
            first = len(symbols)
            heads.append(first)
            symbols += [vocab[c] for c in chars]
            last = len(symbols) - 1
            left += [-1, *range(first, last)]
            right += [*range(first + 1, last + 1), -1]
        ranks = self.ranks
        places: dict[tuple[int, int], list[int]] = {}
        for i, j in enumerate(right):
            if j >= 0 and (pair := (symbols[i], symbols[j])) in ranks:
                places.setdefault(pair, []).append(i)
        active = [(ranks[pair][0], pair) for pair in places]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            found = places.pop(pair, None)
            if found is None:
                continue
            a, b = pair
            made = ranks[pair][1]
            for i in sorted(found):
                j = right[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue  # another merge has taken one of the two
                symbols[i], symbols[j] = made, -1
                right[i] = k = right[j]
                right[j] = -1
                if k >= 0:
                    left[k] = i
                    self._note((made, symbols[k]), i, places, active)
                if (h := left[i]) >= 0:
                    self._note((symbols[h], made), h, places, active)
        out: dict[str, list[int]] = {}
        for word, i in zip(todo, heads, strict=True):
            ids = []
            while i >= 0:
                ids.append(symbols[i])
                i = right[i]
            out[word] = ids
        return out

    def _note(self, pair: tuple[int, int], place: int, places: dict, active: list) -> None:
        if pair in self.ranks:
            if pair not in places:
                places[pair] = []
                heapq.heappush(active, (self.ranks[pair][0], pair))
            places[pair].append(place)

    def learn(self, found: set[str]) -> None:
        """Encode the words that are not known yet, in blocks."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for word in found.difference(known):
            if word in older:
                known[word] = older.pop(word)
            else:
                new.append(word)
        for at in range(0, len(new), 20_000):
            block = new[at : at + 20_000]
            for word, ids in self.merge(w for w in block if w not in self.special).items():
                self.known[word] = (np.array(ids, "<u4").tobytes(), " ".join(self.names[i] for i in ids))
            for word in block:
                if word in self.special:
                    self.known[word] = (np.array([self.special[word]], "<u4").tobytes(), word)

    def encode(self, text: str) -> list[int]:
        found = self.split(text)
        self.learn(set(found))
        return np.frombuffer(b"".join(self.known[w][0] for w in found), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder of its own the file's tokens are joined by spaces."""
        return " ".join(self.names[i] for i in ids)


def codec(path: str) -> PairIndexCodec:
    if path not in _codecs:
        _codecs[path] = PairIndexCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, tokenizer: str, *, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded (text) and their digests, for each row.

    ``keep_ids=False`` leaves out the ids and the decoded text, and only digests are returned.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                split = [own.split(t or "") for t in part.column(1).to_pylist()]
                own.learn(set().union(*split) if split else set())
                known = own.known
                rows: dict[str, list] = {"doc_id": part.column(0).to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                for found in split:
                    got = [known[w] for w in found]
                    ids = b"".join([g[0] for g in got])
                    text = " ".join([g[1] for g in got])
                    rows["n_tokens"].append(len(ids) // 4)
                    rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        rows["ids"].append(np.frombuffer(ids, "<i4"))
                        rows["decoded"].append(text)
                kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
                if keep_ids:
                    kinds |= {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], v) for k, v in kinds.items()], names=list(kinds))

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
