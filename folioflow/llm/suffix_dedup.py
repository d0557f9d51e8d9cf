"""Operator 1: exact repeats of ``LEAST`` bytes by common-prefix interval trees over suffix arrays.

Candidates. In each window of ``LEAST`` bytes the leftmost smallest hash of its ``LEAST / 2``-byte strings
marks an anchor. The mark depends on the window's content alone, so equal windows have an anchor at the same
place, and every repeat shares an anchor string. Anchors are grouped by the hash of their string (64 bits)
and the 128-bit BLAKE2b digest of their context (the bytes that windows around the anchor can reach); a task
sends an equal context once. The digest is cryptographic, so contexts count as equal only if their bytes are.

Resolution. Anchors whose context occurs twice are inside a repeat as far as the context goes. The distinct
contexts of an anchor string are resolved by an enhanced suffix array: suffixes from the anchor are sorted, the
common-prefix intervals are found by a stack scan, and in each interval the contexts are sorted by what stands
to the left. Groups whose left and right neighbours differ are maximal repeats, and all their occurrences of
``LEAST`` bytes or more are marked. A string with more than ``HOT`` distinct contexts would be an unbounded
group; it is split by content down to its windows, whose digests are counted in buckets of their own, so
that the windows that contexts share meet wherever the contexts are.

Defined results: a null text has no bytes; texts under ``LEAST`` bytes lose nothing; windows never cross
texts, may overlap, and count in the same text; rows that share a doc_id are texts of their own, and equal
rows are each other's repeats; other columns are not read; a long text is hashed in segments, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .hashing import mix, prefix_sums, span_hashes

LEAST = 400
#: Distinct contexts of one anchor string up to which a suffix array is built for it.
HOT = 128
#: Bytes hashed at once, records that a task holds before it sends them on, bytes of input a bucket.
SEGMENT, HOLD, BUCKET_BYTES = 1 << 19, 1_000_000, 16 << 20
_NULL_ID = -(1 << 63)


# --- anchors ---------------------------------------------------------------------------------------


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted places that are the leftmost minimum of some ``width`` neighbouring values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    size = -(-len(h) // width) * width
    padded = np.full(size, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    rows = padded.reshape(-1, width)
    place = np.arange(size, dtype=np.int32).reshape(-1, width)
    # forwards: a new minimum is smaller; backwards: smaller or equal, so the leftmost wins
    low = np.minimum.accumulate(rows, axis=1)
    new = np.ones_like(rows, bool)
    new[:, 1:] = rows[:, 1:] < low[:, :-1]
    low_at = np.maximum.accumulate(np.where(new, place, -1), axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]
    new = np.ones_like(rows, bool)
    new[:, :-1] = rows[:, :-1] <= back[:, 1:]
    back_at = np.minimum.accumulate(np.where(new, place, np.int32(size))[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = back_at[:n], low_at[width - 1 : width - 1 + n]
    chosen = np.where(padded[left] <= padded[right], left, right)
    keep = np.ones(n, bool)
    keep[1:] = chosen[1:] != chosen[:-1]
    return np.unique(chosen[keep]).astype(np.int64)


def anchors(data: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchor strings."""
    half, n = least // 2, len(data)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, max(0, n - least + 1), SEGMENT):
        end = min(s + SEGMENT, n - least + 1)  # window starts s..end-1
        low, high = s, min(n, end + 2 * least)
        sums = prefix_sums(data[low:high])
        start = np.arange(s - low, end + least - half - low)
        h = span_hashes(sums, start, start + half)
        at = leftmost_minima((h >> np.uint64(32)).astype(np.uint32), least - half + 1)
        found.append((at + s, h[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, key = (np.concatenate(x) for x in zip(*found, strict=True))
    place, first = np.unique(place, return_index=True)
    return place, key[first]


def digests(parts: Iterator[bytes]) -> np.ndarray:
    """128 bits of each part, as two columns."""
    new = hashlib.blake2b
    return np.frombuffer(b"".join([new(p, digest_size=16).digest() for p in parts]), "<u8").reshape(-1, 2)


# --- suffix arrays ---------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of depth >= least, by a stack scan; lcp[i] is between i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(contexts: list[tuple[bytes, bytes]], least: int = LEAST) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): groups that share just ``left`` bytes before the anchor and ``right`` from it on.

    A context is its bytes before the anchor, nearest first, and those from the anchor on.
    """
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    rank = {c: r for r, c in enumerate(order)}
    lcp = [common_prefix(contexts[a][1], contexts[b][1]) for a, b in zip(order, order[1:], strict=False)]
    for right, first, last in prefix_intervals(lcp, 1):
        members = sorted(order[first : last + 1], key=lambda i: contexts[i][0])
        shared = [common_prefix(contexts[a][0], contexts[b][0]) for a, b in zip(members, members[1:], strict=False)]
        for left, i, j in prefix_intervals(shared, max(0, least - right)):
            group = members[i : j + 1]
            ranks = sorted(rank[g] for g in group)
            if min(lcp[ranks[0] : ranks[-1]]) == right:  # else they go on alike to the right, and a deeper interval has them
                yield left, right, group


# --- records ---------------------------------------------------------------------------------------

_ANCHOR = np.dtype([("key", "<u8"), ("c0", "<u8"), ("c1", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("pos", "<i4"), ("left", "<i2"), ("right", "<i2"), ("many", "<u1")])
_WINDOW = np.dtype([("key", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("pos", "<i4"), ("many", "<u1")])
_REF = np.dtype([("pos", "<i4"), ("key", "<u8"), ("need", "<u1"), ("hot", "<u1")])
_SPAN = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("stop", "<i4")])


def _pack(r: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(np.diff(r[n], prepend=r.dtype[n].type(0)) if n in ("doc", "pos") else r[n]).tobytes() for n in r.dtype.names)
    return zstandard.ZstdCompressor(1).compress(body)


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    body = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.empty(len(body) // kind.itemsize, kind), 0
    for name in kind.names:
        size = len(out) * kind[name].itemsize
        column = np.frombuffer(body[at : at + size], kind[name])
        out[name] = np.cumsum(column, dtype=kind[name]) if name in ("doc", "pos") else column
        at += size
    return out


def _groups(r: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """The records sorted by the names, and for each the number of its group."""
    r = r[np.lexsort([r[n] for n in reversed(names)])]
    new = np.zeros(len(r), bool)
    for n in names:
        new[1:] |= r[n][1:] != r[n][:-1]
    return r, np.cumsum(new)


def _spans_of(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), _SPAN)
    out["doc"], out["tag"] = r["doc"], r["tag"]
    if "left" in r.dtype.names:
        out["start"], out["stop"] = r["pos"] - r["left"], r["pos"] + r["right"]
    else:
        out["start"], out["stop"] = r["pos"], r["pos"] + LEAST
    return out


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans with overlapping ones of a text made one."""
    if not len(spans):
        return spans
    s, text = _groups(spans, "doc", "tag", "start")
    _, text = np.unique(np.stack([s["doc"], s["tag"].astype(np.int64)], axis=1), axis=0, return_inverse=True)
    text = np.ravel(text).astype(np.int64)
    order = np.lexsort((s["start"], text))
    s, text = s[order], text[order]
    reach = np.maximum.accumulate(s["stop"].astype(np.int64) + (text << 33))
    new = np.ones(len(s), bool)
    new[1:] = s["start"][1:].astype(np.int64) + (text[1:] << 33) > reach[:-1]
    out = s[new]
    last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    out["stop"] = (reach[last] - (text[last] << 33)).astype(np.int32)
    return out


def _by_text(r: np.ndarray, columns: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc, tag, packed records) of each text."""
    if not len(r):
        return
    r, _ = _groups(r, "doc", "tag")
    cut = np.flatnonzero((np.diff(r["doc"]) != 0) | (np.diff(r["tag"]) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(r)], strict=True):
        yield int(r["doc"][a]), int(r["tag"][a]), r[columns][a:b]


def _span_rows(spans: np.ndarray, buckets: int) -> list[tuple]:
    """Rows (bucket, spans) of spans packed by bucket of their text."""
    spans = _joined(spans)
    bucket = (mix(spans["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((spans["start"], spans["doc"], bucket))
    spans, bucket = spans[order], bucket[order]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(k, _pack(spans[bounds[k] : bounds[k + 1]]), None, None, None) for k in np.flatnonzero(np.diff(bounds)).tolist()]


def _ref_rows(refs: np.ndarray) -> list[tuple]:
    """Rows (doc, tag, refs) of contexts that are to be resolved."""
    rows = []
    for d, t, x in _by_text(refs, ["pos", "key", "need", "hot"]):
        packed = np.empty(len(x), _REF)
        for n in _REF.names:
            packed[n] = x[n]
        rows.append((None, None, d, t, packed.tobytes()))
    return rows


_FOUND = "bucket long, spans binary, doc long, tag int, refs binary"


def _found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
    for at in range(0, len(rows), 10_000):
        columns = zip(*rows[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "spans", "doc", "tag", "refs"])


def _settle(r: np.ndarray, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of records whose group occurs more than once here, and one record for each group (many: it does)."""
    r, group = _groups(r, *by)
    n = np.bincount(group, weights=1 + r["many"])
    first = np.ones(len(r), bool)
    first[1:] = group[1:] != group[:-1]
    one = r[first].copy()
    one["many"] = n > 1
    return _spans_of(r[n[group] > 1]), one


def _routed(r: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed records)."""
    bucket = (r["key"] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((r["pos"], r["doc"], bucket))
    r, bucket = r[order], bucket[order]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, _pack(r[bounds[k] : bounds[k + 1]])


# --- jobs ------------------------------------------------------------------------------------------


def _identified(docs: DataFrame) -> DataFrame:
    """doc, tag (both never null) and text: the key of a text, and its content."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int").alias("tag"), "doc_id", "text")


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def candidate_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, spans (decided, packed for many texts) or doc, tag, refs (contexts of a text that a suffix array has to resolve)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "records", "spans"]

        def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            spans, one = _settle(np.concatenate(held), ("key", "c0", "c1"))
            rows = [(k, blob, None) for k, blob in _routed(one, buckets)]
            spans = _joined(spans)
            if len(spans):
                rows.append((int(one["key"][0] % np.uint64(buckets)), None, spans.tobytes()))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

        held, n = [], 0
        for batch in batches:
            for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = _bytes(text)
                if len(body) < LEAST:
                    continue
                place, key = anchors(np.frombuffer(body, np.uint8))
                r = np.empty(len(place), _ANCHOR)
                r["left"], r["right"] = np.minimum(place, LEAST // 2), np.minimum(len(body) - place, LEAST)
                # the same bytes at another distance from the text's start are another context
                context = digests(b"%d:" % a + body[p - a : p + b] for p, a, b in zip(place.tolist(), r["left"].tolist(), r["right"].tolist(), strict=True))
                r["key"], r["c0"], r["c1"], r["doc"], r["tag"], r["pos"], r["many"] = key, context[:, 0], context[:, 1], doc, tag, place, 0
                held.append(r)
                n += len(r)
                if n > HOLD:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, spans, refs, n = None, [], [], [], 0

        def close() -> None:
            nonlocal n
            # each task has sent a context once: what stands alone in its group of equal contexts is unresolved
            r, group = _groups(np.concatenate(held), "key", "c0", "c1")
            many = np.bincount(group, weights=1 + r["many"])[group] > 1
            key = np.cumsum(np.concatenate([[False], r["key"][1:] != r["key"][:-1]]))
            first = np.concatenate([[True], group[1:] != group[:-1]])
            different = np.bincount(key, weights=first)[key]
            spans.append(_spans_of(r[many]))
            wanted = first & (different > 1)
            out = np.empty(int(wanted.sum()), [("doc", "<i8"), ("tag", "<i4"), *((x, _REF[x]) for x in _REF.names)])
            for x in ("doc", "tag", "pos", "key"):
                out[x] = r[x][wanted]
            out["need"], out["hot"] = ~many[wanted], different[wanted] > HOT
            refs.append(out)
            n += len(out) + len(spans[-1])

        for batch in batches:
            for bucket, blob, decided in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    if held:
                        close()
                    at, held = bucket, []
                    if n > HOLD:
                        yield from _found(_span_rows(np.concatenate(spans), buckets) + _ref_rows(np.concatenate(refs)))
                        spans, refs, n = [], [], 0
                if blob is not None:
                    held.append(_unpack(blob, _ANCHOR))
                else:
                    spans.append(np.frombuffer(decided, _SPAN))
                    n += len(spans[-1])
        if held:
            close()
        if spans:
            yield from _found(_span_rows(np.concatenate(spans), buckets) + (_ref_rows(np.concatenate(refs)) if refs else []))

    dealt = texts.select("doc", "tag", "text").mapInArrow(collect, "bucket long, records binary, spans binary")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, _FOUND)


def resolved_spans(texts: DataFrame, candidates: DataFrame, buckets: int) -> DataFrame:
    """bucket and spans (packed for many texts) that the suffix arrays, and the windows of hot strings, find."""
    wanted = candidates.where("refs IS NOT NULL").groupBy(F.col("doc").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_list("refs").alias("refs"))
    held = texts.join(wanted, (F.col("doc") == F.col("of")) & (F.col("tag") == F.col("of_tag"))).select("doc", "tag", "text", "refs")
    names = ["route", "doc", "tag", "pos", "left_bytes", "need", "context"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(windows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            spans, one = _settle(np.concatenate(windows), ("key", "more"))
            rows = [(-1 - k, None, None, None, None, None, blob) for k, blob in _routed(one, buckets)]
            spans = _joined(spans)
            if len(spans):
                rows.append((-1 - int(one["key"][0] % np.uint64(buckets)), None, None, None, None, True, spans.tobytes()))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64], strict=True), kinds, strict=True)], names=names)

        windows, n = [], 0
        for batch in batches:
            rows = []
            for doc, tag, text, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = _bytes(text)
                for pos, key, need, hot in np.frombuffer(b"".join(blobs), _REF).tolist():
                    left, right = min(pos, LEAST // 2), min(len(body) - pos, LEAST)
                    context = body[pos - left : pos + right]
                    if hot:
                        start = np.arange(len(context) - LEAST + 1)
                        w = np.empty(len(start), _WINDOW)
                        # a window is counted for this anchor string and place: it may hold other anchors, too
                        found = digests(b"%d:%d:" % (key, left - s) + context[s : s + LEAST] for s in start.tolist())
                        w["key"], w["more"] = found[:, 0], found[:, 1]
                        w["doc"], w["tag"], w["pos"], w["many"] = doc, tag, start + pos - left, not need
                        windows.append(w)
                        n += len(w)
                    else:
                        rows.append((key >> 1, doc, tag, pos, left, bool(need), context))
                if n > HOLD:
                    yield from flush(windows)
                    windows, n = [], 0
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 5000], strict=True), kinds, strict=True)], names=names)
        if n:
            yield from flush(windows)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, windows, spans, n = None, [], [], [], 0

        def close() -> None:
            nonlocal n
            if windows:
                spans.append(_settle(np.concatenate(windows), ("key", "more"))[0])
            if len(group) > 1:
                contexts = [(c[:left][::-1], c[left:]) for _, _, _, left, _, c in group]
                found = [(g[0], g[1], g[2] - l, g[2] + r) for l, r, members in maximal_repeats(contexts) for g in (group[m] for m in members) if g[4]]
                if found:
                    spans.append(np.array(found, _SPAN))
            n += sum(map(len, spans[-2:]))

        for batch in batches:
            for route, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if route != at:
                    close()
                    at, group, windows = route, [], []
                    if n > HOLD:
                        yield from _found(_span_rows(np.concatenate(spans), buckets))
                        spans, n = [], 0
                if route >= 0:
                    group.append(row)
                elif row[4]:
                    spans.append(np.frombuffer(row[5], _SPAN))
                    n += len(spans[-1])
                else:
                    windows.append(_unpack(row[5], _WINDOW))
        close()
        if spans:
            yield from _found(_span_rows(np.concatenate(spans), buckets))

    dealt = held.mapInArrow(extract, "route long, doc long, tag int, pos int, left_bytes int, need boolean, context binary")
    dealt = dealt.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(resolve, _FOUND).select("bucket", "spans")


def spans_by_text(packed: DataFrame) -> DataFrame:
    """doc, tag and spans (32-bit pairs in order) of each text, from buckets of packed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def texts() -> Iterator[pa.RecordBatch]:
            rows = [(d, t, np.stack([x["start"], x["stop"]], axis=1).astype("<i4").tobytes()) for d, t, x in _by_text(_joined(np.concatenate(held)), ["start", "stop"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["doc", "tag", "spans"])

        for batch in batches:
            for bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and held:
                    yield from texts()
                    held = []
                at = bucket
                held.append(_unpack(blob, _SPAN))
        if held:
            yield from texts()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, tag int, spans binary")


def remove_repeated_bytes(docs: DataFrame, *, keep_spans: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_spans``, spans (array of start, stop) of each row."""
    size = small_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, -(-size // BUCKET_BYTES))
    texts = _identified(docs)
    candidates = checkpointed(candidate_texts(texts, buckets))
    packed = candidates.where("spans IS NOT NULL").select("bucket", "spans").union(resolved_spans(texts, candidates, buckets))
    found = spans_by_text(packed).select(F.col("doc").alias("of"), F.col("tag").alias("of_tag"), "spans")
    joined = texts.join(found, (F.col("doc") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans"] * keep_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = _bytes(text)
                own = np.frombuffer(blob or b"", "<i4").reshape(-1, 2).tolist()
                kept = b"".join(body[a:b] for a, b in zip([0, *[s[1] for s in own]], [*[s[0] for s in own], len(body)], strict=True))
                rows.append((len(body), len(body) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in own]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: int, stop: int>>" * keep_spans
    return joined.mapInArrow(run, schema)
