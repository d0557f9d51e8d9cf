"""Operator 9: repeated word windows behind a count-min prefilter.

Pass one: every block of texts makes a count-min sketch of its windows, and the sketches are merged by range of
cells (``sketch.py``). Pass two: only windows estimated repeated are grouped, by the 128-bit BLAKE2b digest of
their words joined by one space. A block sends a window once, from its smallest document; its other documents
are already known to repeat a smaller one. So a window that a third of all rows hold costs one record a block.
A bucket of windows finds the smallest document of each.

The digest is cryptographic: two windows of different words that share one cannot be made, and would not turn
up by chance; the weaker hashes of the sketch only choose what is digested.

Defined results: a null or empty text has no words and keeps the empty string; a text of fewer words than a
window loses nothing; equal windows of one document do not remove each other, nor do rows that share a
doc_id; a null doc_id is not compared; repeated rows are returned each; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches
from .hashing import word_bounds, word_window_hashes
from .sketch import Shape, dealt, may_repeat, pack, repeat_marks, unpack

WINDOW = 13
#: Bytes of text that are hashed at once, and of input a bucket of the exact pass.
HASH_BYTES, BUCKET_BYTES = 1 << 20, 24 << 20
_FIELDS = [("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("pos", "<i4")]
_PLACE = _FIELDS[2:]


#: Bytes with A-Z in lower case, and as they are.
_LOWER, _SAME = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)), bytes(range(256))


class Words:
    """The words of some whole texts, parted by one space, a line for each text; with ``lower``, A-Z in lower case."""

    def __init__(self, texts: list[str | None], width: int, lower: bool = False):
        case = _LOWER if lower else _SAME
        lines = [b" ".join((t or "").encode("utf-8", "surrogatepass").translate(case).split()) for t in texts]
        self.data = b"\n".join(lines)
        data = np.frombuffer(self.data, np.uint8)
        self.starts, self.stops = word_bounds(data)
        ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
        row = np.searchsorted(ends, self.starts, side="right")
        h = word_window_hashes(data, self.starts, self.stops, width)
        #: the windows that lie in one text: number of their first word here, row, number in the text, hash
        self.at = np.flatnonzero(row[: len(h)] == row[width - 1 : width - 1 + len(h)])
        self.row, self.hashes = row[self.at], h[self.at]
        self.pos = self.at - np.searchsorted(row, np.arange(len(lines)))[self.row]
        self.width = width

    def names(self) -> np.ndarray:
        """64 bits of the bytes of each window."""
        data, digest = self.data, xxhash.xxh3_64_intdigest
        a, b = self.starts[self.at].tolist(), self.stops[self.at + self.width - 1].tolist()
        return np.fromiter((digest(data[i:j]) for i, j in zip(a, b, strict=True)), np.uint64, len(a))

    def digests(self, which: np.ndarray) -> np.ndarray:
        """128 bits of the bytes of the windows."""
        data, new = self.data, hashlib.blake2b
        a, b = self.starts[self.at[which]].tolist(), self.stops[self.at[which] + self.width - 1].tolist()
        return np.frombuffer(b"".join([new(data[i:j], digest_size=16).digest() for i, j in zip(a, b, strict=True)]), "<u8").reshape(-1, 2)


def text_groups(texts: pa.ChunkedArray, width: int, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """(number of the first text, windows) of groups of whole texts of about ``HASH_BYTES``."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts.to_pylist()):
        if held and size >= HASH_BYTES:
            yield first, Words(held, width, lower)
            held, size, first = [], 0, i
        held.append(text)
        size += len(text or "")
    if held:
        yield first, Words(held, width, lower)


def window_hashes(texts: pa.ChunkedArray, width: int, lower: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[w.hashes for _, w in text_groups(texts, width, lower)]])


def _packed(r: np.ndarray) -> bytes:
    return pack(*[np.diff(r[n], prepend=r.dtype[n].type(0)) if n in ("doc", "pos") else r[n] for n in r.dtype.names])


def _records(blob: bytes, fields: list[tuple[str, str]]) -> np.ndarray:
    columns = unpack(blob, *[k for _, k in fields])
    out = np.empty(len(columns[0]), fields)
    for (name, kind), column in zip(fields, columns, strict=True):
        out[name] = np.cumsum(column, dtype=kind) if name in ("doc", "pos") else column
    return out


def _split_smallest(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the records) of the smallest document of each window, and of the others."""
    order = np.lexsort((r["doc"], r["b"], r["a"]))
    a, b, doc = r["a"][order], r["b"][order], r["doc"][order]
    new = np.ones(len(r), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    same = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(r) else new
    return order[same], order[~same]


def text_tag() -> F.Column:
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")


def _dealt(docs: DataFrame, width: int) -> tuple[DataFrame, Shape]:
    """doc_id, text, tag and block of each row, and the sketch's sizes."""
    size = small_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape.of(size, size // 6)
    rows = docs.select("doc_id", "text", text_tag().alias("tag"))
    return dealt(rows, F.struct("doc_id", "text"), shape, "block"), shape


def repeated_windows(texts: DataFrame, shape: Shape, *, width: int = WINDOW) -> DataFrame:
    """block and places (packed document, tag and first word) of windows that a smaller document also has."""
    buckets = max(16, shape.blocks * (8 << 20) // BUCKET_BYTES)

    def candidates(key: tuple, block: pa.Table, marks: pa.Table) -> pa.Table:
        number = key[0].as_py()
        ids, tags = block.column("doc_id").combine_chunks(), block.column("tag").to_numpy()
        known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        groups = list(text_groups(block.column("text"), width))
        repeats = may_repeat(np.concatenate([np.zeros(0, np.uint64), *[w.hashes for _, w in groups]]), marks, shape)
        found, at = [], 0
        for first, w in groups:
            own = repeats[at : at + len(w.hashes)] & known[w.row + first]
            at += len(w.hashes)
            which = np.flatnonzero(own)
            r = np.empty(len(which), _FIELDS)
            row = w.row[which] + first
            digest = w.digests(which)
            r["a"], r["b"], r["doc"], r["tag"], r["pos"] = digest[:, 0], digest[:, 1], ids[row], tags[row], w.pos[which]
            found.append(r)
        r = np.concatenate([np.zeros(0, _FIELDS), *found])
        smallest, others = (r[x] for x in _split_smallest(r))
        bucket = (smallest["a"] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((smallest["pos"], smallest["doc"], bucket))
        smallest = smallest[order]
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(bounds)).tolist()
        blobs = [_packed(smallest[bounds[k] : bounds[k + 1]]) for k in full]
        decided = []
        if len(others):
            others = others[np.lexsort((others["pos"], others["doc"]))]
            full.append(number % buckets)
            decided = [_packed(others[[n for n, _ in _PLACE]])]
        release()
        return pa.table({"bucket": pa.array(full, pa.int64()), "block": pa.array([number] * len(full), pa.int32()), "records": pa.array([*blobs, *[None] * len(decided)], pa.binary()), "decided": pa.array([*[None] * len(blobs), *decided], pa.binary())})

    def exact(bucket: pa.Table) -> pa.Table:
        blocks, places = [], []
        held, of = [], []
        for block, records, decided in zip(*(bucket.column(c).to_pylist() for c in ("block", "records", "decided")), strict=True):
            if decided is not None:
                blocks.append(block)
                places.append(decided)
            else:
                held.append(_records(records, _FIELDS))
                of.append(np.full(len(held[-1]), block, np.int64))
        if held:
            r, of = np.concatenate(held), np.concatenate(of)
            others = _split_smallest(r)[1]
            r, of = r[others][[n for n, _ in _PLACE]], of[others]
            order = np.lexsort((r["pos"], r["tag"], r["doc"], of))
            r, of = r[order], of[order]
            bounds = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
            for a, b in pairwise(bounds):
                blocks.append(int(of[a]))
                places.append(_packed(r[a:b]))
        release()
        return pa.table({"block": pa.array(blocks, pa.int32()), "places": pa.array(places, pa.binary())})

    marks = repeat_marks(texts, "block", shape, lambda block: window_hashes(block.column("text"), width))
    sent = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(candidates, "bucket long, block int, records binary, decided binary")
    return sent.groupBy("bucket").applyInArrow(exact, "block int, places binary")


def remove_repeats(docs: DataFrame, *, width: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept_text of each row."""
    texts, shape = _dealt(docs, width)
    found = repeated_windows(texts, shape, width=width)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}

    def remove(block: pa.Table, found: pa.Table) -> pa.Table:
        r = np.concatenate([np.zeros(0, _PLACE), *[_records(b, _PLACE) for b in found.column("places").to_pylist()]])
        r = r[np.lexsort((r["tag"], r["doc"]))]
        cuts = np.flatnonzero((np.diff(r["doc"]) != 0) | (np.diff(r["tag"]) != 0)) + 1
        bounds = [0, *cuts.tolist(), len(r)] if len(r) else [0]
        places = {(int(r["doc"][a]), int(r["tag"][a])): r["pos"][a:b] for a, b in pairwise(bounds)}
        out: dict[str, list] = {n: [] for n in names[1:]}
        for doc, tag, text in zip(*(block.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            out["n_words"].append(len(words))
            first = places.get((doc, tag))
            if first is not None:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + width, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            kept = b" ".join(words)
            out["n_removed"].append(out["n_words"][-1] - len(words))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                out["kept_text"].append(kept.decode("utf-8", "surrogatepass"))
        return pa.table([block.column("doc_id"), *[pa.array(out[n], kinds[n]) for n in names[1:]]], names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, schema)
