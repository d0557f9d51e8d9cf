"""Operator 4: repeated runs of lines, by content-defined chunks.

Rolling hashes over the hashes of adjacent lines choose where a text is cut, so that lines put in or taken out move
only the cuts next to them, and a passage that two texts share is cut alike in both. A chunk reaches to the first line
of the next one: every two adjacent lines, a window, lie in just one chunk. Chunks that occur again go as a whole,
from their bytes. What a passage shares with the beginning or end of a chunk only is found on a second level, the
windows of the chunks that stay: those that occur earlier go, so no boundary has to fall inside a passage, and every
repeated run of two lines or more is removed. That nothing else is: all windows of a chunk that goes are in the
earlier one.

The windows' hashes go to count-min sketches of blocks of texts (``sketch.py``). Chunks all of whose windows, and in
other chunks the windows that, are estimated repeated are compared over all documents: a block sends each once,
from its first occurrence there, and a bucket finds the first of all. So a chunk that a third of all documents hold
costs one record a block, and its windows one record in all. The first occurrence (smallest doc_id, then hash of the
row, then place) stays, the lines of every later one are removed.

Defined results: a null text is an empty one with one empty line; a text without a line feed has one line
and loses nothing; a window of blank lines only is never removed by itself; where one line follows itself and
the first window overlaps the next, the first keeps both its lines; n_removed_chunks counts removed windows;
repeated rows (equal id and text) are one document, so each keeps what the first occurrence keeps; a null
doc_id comes first; other columns are not read by ``repeated_chunks`` and are returned unchanged by
``drop_repeated_chunks``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, unused
from .hashing import mix
from .sketch import Shape, dealt, may_repeat, pack, repeat_marks, unpack

#: Mean lines of a chunk, most of one (a longer one is cut by number), lines of a window.
MEAN_LINES, MOST_LINES, LEAST_LINES = 4, 64, 2
#: Bytes of input a bucket of chunks.
BUCKET_BYTES = 16 << 20
_FACTOR = 0x100000001B3
_LEAST_ID = -(1 << 63)


def _starts(windows: np.ndarray) -> list[int]:
    """First windows of the chunks, from the rolled hashes of all windows: a text is cut behind a window that its hash chooses."""
    chosen = np.flatnonzero(windows >> np.uint64(40) < np.uint64((1 << 24) // MEAN_LINES)) + LEAST_LINES
    out = []
    for first, end in zip([0, *chosen.tolist()], [*chosen.tolist(), len(windows)], strict=True):
        out += range(first, min(end, len(windows)), MOST_LINES)
    return out


def cut_chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """Chunks as (first line, line after the last), without the line that each shares with the next one."""
    starts = [0, *_starts(line_hashes([b"\n".join(lines).decode("utf-8", "surrogatepass")])[0])[1:]]
    return list(zip(starts, [*starts[1:], len(lines)], strict=True))


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _multi(lines: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, first line, end, bytes) of the windows that may be removed."""
    for a in range(len(lines) - LEAST_LINES + 1):
        body = b"\n".join(lines[a : a + LEAST_LINES])
        if body.strip():
            yield a, a, a + LEAST_LINES, body


def line_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Rolled hashes of the windows of ``LEAST_LINES`` lines of each text."""
    out = []
    for text in texts:
        lines = _lines(text)
        h = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
        n = max(0, len(h) - LEAST_LINES + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(LEAST_LINES):
            rolled = rolled * np.uint64(_FACTOR) + h[k : k + n]
        out.append(mix(rolled))
    return out


def _hashes(texts: list[str | None]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *line_hashes(texts)])


def _removals(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows dealt to blocks, the packed windows to remove by block, and the names of the block and of the row's hash."""
    text = F.col("text")
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    size, n = small_batches(docs).agg(F.sum(F.octet_length(text)), F.sum(feeds)).first()
    shape = Shape.of(size or 0, n or 0)
    tag, block = unused(docs, "tag"), unused(docs, "block")
    blocks = dealt(docs.withColumn(tag, F.xxhash64("doc_id", "text")), F.struct("doc_id", "text"), shape, block)
    buckets = max(16, -(-(size or 0) // BUCKET_BYTES))

    def firsts(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        """The first occurrence of each chunk and window of the block, by bucket of its bytes; the block's other ones are decided."""
        ids, tags, texts = rows.column("doc_id").to_pylist(), rows.column(tag).to_pylist(), rows.column("text").to_pylist()
        own = line_hashes(texts)
        repeats = may_repeat(np.concatenate([np.zeros(0, np.uint64), *own]), marks, shape)
        ends = np.cumsum([0, *map(len, own)])
        chunks, windows = _Firsts(), _Firsts()
        seen = set()
        for row, (doc, t) in enumerate(zip(ids, tags, strict=True)):
            again = repeats[ends[row] : ends[row + 1]]
            if not again.any() or (doc, t) in seen:
                continue
            seen.add((doc, t))
            again, lines = again.tolist(), _lines(texts[row])
            starts = _starts(own[row])
            for first, end in zip(starts, [*starts[1:], len(again)], strict=True):
                at = (_LEAST_ID if doc is None else doc, t, first)
                if end - first > 1 and all(again[first:end]):
                    chunks.meet(b"\n".join(lines[first : end + 1]), at, None)
                    continue
                for place, _, _, body in _multi(lines[first : end + 1]):
                    if again[first + place]:
                        windows.meet(body, (*at[:2], first + place), None)
        number = key[0].as_py()
        gone = [at for at, _ in windows.later]
        for body, at, _ in chunks.lost():
            gone += _windows_at(body, at)
        out = [*chunks.sent(CHUNK, number, buckets), *windows.sent(WINDOW, number, buckets)]
        if gone:
            out.append((number % buckets, number, GONE, _packed(gone), None))
        release()
        return _rows(out)

    def whole(bucket: pa.Table) -> pa.Table:
        """Chunks that are not the first of their bytes are decided; the first ones send their windows."""
        chunks, out = _Firsts(), []
        for k, block, level, places, bodies in zip(*(bucket.column(c).to_pylist() for c in _SENT), strict=True):
            if level != CHUNK:
                out.append((k, block, level, places, bodies))
                continue
            for at, body in zip(_places(places), _bodies(bodies), strict=True):
                chunks.meet(body, at, block)
        lost: dict[int, list[tuple[int, int, int]]] = {}
        for body, at, block in chunks.lost():
            lost.setdefault(block, []).extend(_windows_at(body, at))
        out += [(block % buckets, block, GONE, _packed(places), None) for block, places in lost.items() if places]
        by_block: dict[int, _Firsts] = {}
        for body, (at, block) in chunks.first.items():
            for place, _, _, window in _multi(body.split(b"\n")):
                by_block.setdefault(block, _Firsts()).meet(window, (*at[:2], at[2] + place), None)
        for block, windows in by_block.items():
            out += windows.sent(WINDOW, block, buckets)
            if windows.later:
                out.append((block % buckets, block, GONE, _packed([at for at, _ in windows.later]), None))
        release()
        return _rows(out)

    def meet(bucket: pa.Table) -> pa.Table:
        """The windows that are not the first of their bytes."""
        windows, out = _Firsts(), []
        for _, block, level, places, bodies in zip(*(bucket.column(c).to_pylist() for c in _SENT), strict=True):
            if level == GONE:
                out.append((block, places))
                continue
            for at, body in zip(_places(places), _bodies(bodies), strict=True):
                windows.meet(body, at, block)
        lost: dict[int, list[tuple[int, int, int]]] = {}
        for at, block in windows.later:
            lost.setdefault(block, []).append(at)
        out += [(block, _packed(places)) for block, places in lost.items()]
        release()
        return pa.table({"block": pa.array([r[0] for r in out], pa.int32()), "places": pa.array([r[1] for r in out], pa.binary())})

    marks = repeat_marks(blocks, block, shape, lambda rows: _hashes(rows.column("text").to_pylist()))
    sent = blocks.groupBy(block).cogroup(marks.groupBy("block")).applyInArrow(firsts, _SENT_SCHEMA)
    windows = sent.groupBy("bucket").applyInArrow(whole, _SENT_SCHEMA)
    return blocks, windows.groupBy("bucket").applyInArrow(meet, "block int, places binary"), [block, tag]


#: What is sent to a bucket: chunks, windows, or windows that are decided.
CHUNK, WINDOW, GONE = 0, 1, 2
_SENT = ("bucket", "block", "level", "places", "bodies")
_SENT_SCHEMA = "bucket long, block int, level int, places binary, bodies binary"


class _Firsts:
    """The first place of each body, and the (place, mark) of all others; a later place's body is the kept one's."""

    def __init__(self) -> None:
        self.first: dict[bytes, tuple[tuple[int, int, int], int | None]] = {}
        self.later: list[tuple[tuple[int, int, int], int | None]] = []
        self._bodies: list[bytes] = []

    def meet(self, body: bytes, at: tuple[int, int, int], mark: int | None) -> None:
        held = self.first.setdefault(body, (at, mark))
        if held[0] != at:
            less, more = (held, (at, mark)) if held[0] < at else ((at, mark), held)
            self.first[body] = less
            self.later.append(more)
            self._bodies.append(body)

    def lost(self) -> Iterator[tuple[bytes, tuple[int, int, int], int | None]]:
        for body, (at, mark) in zip(self._bodies, self.later, strict=True):
            yield body, at, mark

    def sent(self, level: int, number: int, buckets: int) -> list[tuple[int, int, int, bytes, bytes]]:
        by_bucket: dict[int, list[bytes]] = {}
        for body in self.first:
            by_bucket.setdefault(xxhash.xxh3_64_intdigest(body) % buckets, []).append(body)
        return [(k, number, level, _packed([self.first[b][0] for b in bodies]), _packed_bodies(bodies)) for k, bodies in by_bucket.items()]


def _windows_at(chunk: bytes, at: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """Places of a chunk's windows that may be removed."""
    return [(*at[:2], at[2] + place) for place, _, _, _ in _multi(chunk.split(b"\n"))]


def _rows(sent: list[tuple[int, int, int, bytes, bytes | None]]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in sent], t) for i, (n, t) in enumerate(zip(_SENT, kinds, strict=True))})


def _packed(places: list[tuple[int, int, int]]) -> bytes:
    """Places (document, hash of the row, first line)."""
    doc, tag, place = zip(*places, strict=True)
    return pack(np.array(doc, np.int64), np.array(tag, np.int64), np.array(place, np.int32))


def _places(blob: bytes) -> list[tuple[int, int, int]]:
    return list(zip(*(c.tolist() for c in unpack(blob, "<i8", "<i8", "<i4")), strict=True))


def _packed_bodies(bodies: list[bytes]) -> bytes:
    sizes = np.array([len(b) for b in bodies], "<u4")
    return zstandard.ZstdCompressor(1).compress(np.uint32(len(sizes)).tobytes() + sizes.tobytes() + b"".join(bodies))


def _bodies(blob: bytes) -> Iterator[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    at = 4 + 4 * n
    for size in np.frombuffer(data, "<u4", n, 4).tolist():
        yield data[at : at + size]
        at += size


def _with_removals(docs: DataFrame, make: Callable[[pa.Table, list[list[int] | None]], pa.Table], schema: str) -> DataFrame:
    """make(rows of a block without the two helping columns, sorted first lines of the windows to remove or None of each row)."""
    blocks, found, extra = _removals(docs)
    block, tag = extra

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        places: dict[tuple[int, int], set[int]] = {}
        for blob in found.column("places").to_pylist():
            for doc, t, place in _places(blob):
                places.setdefault((doc, t), set()).add(place)
        keys = zip(rows.column("doc_id").to_pylist(), rows.column(tag).to_pylist(), strict=True)
        own = [places.get((_LEAST_ID if doc is None else doc, t)) for doc, t in keys]
        return make(rows.drop_columns(extra), [sorted(p) if p else None for p in own])

    return blocks.groupBy(block).cogroup(found.groupBy("block")).applyInArrow(run, schema)


def kept_lines(text: str | None, places: list[int] | None) -> tuple[bytes, int, int]:
    """The remaining text, the number of lines, and of removed ones."""
    lines = _lines(text)
    if not places:
        return b"\n".join(lines), len(lines), 0
    places, gone = set(places), set()
    for p in places:
        first = p - 1 not in places and p > 0 and lines[p - 1] == lines[p] == lines[p + 1]
        gone.update(range(p + first, p + LEAST_LINES))
    kept = [line for i, line in enumerate(lines) if i not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def repeated_chunks(docs: DataFrame, *, keep_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_chunks, kept_sha256 and, with ``keep_text``, kept_text of each row."""
    names = ["doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "kept_sha256"] + ["kept_text"] * keep_text

    def count(rows: pa.Table, places: list[list[int] | None]) -> pa.Table:
        kept = [kept_lines(t, p) for t, p in zip(rows.column("text").to_pylist(), places, strict=True)]
        columns = [rows.column("doc_id"), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([len(p or ()) for p in places], pa.int64()), pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string())]
        if keep_text:
            columns.append(pa.array([k[0].decode("utf-8", "surrogatepass") for k in kept], pa.string()))
        return pa.table(columns, names=names)

    return _with_removals(docs.select("doc_id", "text"), count, "doc_id long, n_lines long, n_removed_lines long, n_removed_chunks long, kept_sha256 string" + ", kept_text string" * keep_text)


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """The documents with their texts shortened; one that loses every line is left out, and n_chars, if there, follows."""

    def shorten(rows: pa.Table, places: list[list[int] | None]) -> pa.Table:
        texts = rows.column("text").to_pylist()
        short = {i: kept_lines(texts[i], p)[0].decode("utf-8", "surrogatepass") for i, p in enumerate(places) if p}
        changed = {"text": [short.get(i, t) for i, t in enumerate(texts)]}
        if "n_chars" in rows.column_names:
            changed["n_chars"] = [len(short[i]) if i in short else n for i, n in enumerate(rows.column("n_chars").to_pylist())]
        for name, values in changed.items():
            at = rows.column_names.index(name)
            rows = rows.set_column(at, rows.schema.field(at), pa.array(values, rows.schema.field(at).type))
        return rows.take(pa.array([i for i in range(len(texts)) if short.get(i) != ""], pa.int64()))

    return _with_removals(docs, shorten, docs.schema)
