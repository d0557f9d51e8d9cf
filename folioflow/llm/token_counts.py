"""Operator 7: token counts by finite-state transducers.

Two deterministic transducers are compiled from a byte-level BPE file. The first reads character
classes and emits the borders of the pieces that BPE works on; its transitions carry how many borders
they emit and where. Texts are cut into chunks, each chunk becomes a map from every start state to an
end state, and the maps are composed by a parallel prefix scan, so that all chunks are run at once
from their true start states. The second reads a piece's bytes; its transitions carry by how much the
number of tokens changes, and its states are made when they are first reached.

Defined results: a null or empty text has no bytes and no tokens; a special token's string inside a
text counts as one token, as the library's default has it; repeated rows are counted each; columns
other than doc_id and text are not read; a very long text is run in parts that are cut where a piece
must end whatever stands before, and never as a prefix.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe_codec import byte_symbols
from .common import small_batches

#: Characters of a chunk, and of the texts that are scanned together.
CHUNK, SCAN = 128, 2_000_000
#: Pieces whose counts, and states whose transitions, a Python worker keeps.
CACHE_PIECES, CACHE_STATES = 1_000_000, 500_000

FRESH, LETTERS, DIGITS, OTHERS, SPACE, BLANK, SPACES, BLANKS_, APOSTROPHE, AP_R, AP_V, AP_L = range(12)
STATES = 12
C_LETTER, C_STMD, C_R, C_V, C_L, C_E, C_DIGIT, C_SPACE, C_BLANK, C_APOSTROPHE, C_OTHER, C_END = range(12)
CLASSES = 12
HERE, BEFORE_LAST = 1, 2  # a border in front of this character; in front of the one before it

_counters: dict[str, TokenCounter] = {}


def border_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Tables [class, state] of the next state and of the borders that are emitted."""
    begin = {C_DIGIT: DIGITS, C_SPACE: SPACE, C_BLANK: BLANK, C_APOSTROPHE: APOSTROPHE, C_OTHER: OTHERS, C_END: FRESH}
    begin |= dict.fromkeys(range(C_LETTER, C_E + 1), LETTERS)
    run = {LETTERS: range(C_LETTER, C_E + 1), DIGITS: (C_DIGIT,), OTHERS: (C_OTHER, C_APOSTROPHE)}
    after_space = begin | {C_APOSTROPHE: OTHERS}

    def step(state: int, c: int) -> tuple[int, int]:
        if state in run:
            return (state, 0) if c in run[state] else (begin[c], HERE)
        if state in (SPACE, BLANK, SPACES, BLANKS_):
            if c in (C_SPACE, C_BLANK):
                return (SPACES if c == C_SPACE else BLANKS_), 0
            if c == C_END:
                return FRESH, HERE
            many = BEFORE_LAST if state in (SPACES, BLANKS_) else 0
            return (after_space[c], many) if state in (SPACE, SPACES) else (begin[c], HERE | many)
        if state == APOSTROPHE:
            if c in (C_STMD, C_R, C_V, C_L):
                return {C_STMD: FRESH, C_R: AP_R, C_V: AP_V, C_L: AP_L}[c], 0
            return (OTHERS, 0) if c in run[OTHERS] else (begin[c], HERE)
        if state in (AP_R, AP_V, AP_L):
            if c == (C_L if state == AP_L else C_E):
                return FRESH, 0
            to, out = step(LETTERS, c)
            return to, out | BEFORE_LAST
        return begin[c], HERE

    table = [[step(s, c) for s in range(STATES)] for c in range(CLASSES)]
    return np.array([[x[0] for x in r] for r in table], np.uint8), np.array([[x[1] for x in r] for r in table], np.uint8)


def character_classes() -> np.ndarray:
    """The class of every code point; the last entry is the end sign between texts."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110001, C_OTHER, np.uint8)
    for pattern, c in ((r"\p{L}", C_LETTER), (r"\p{N}", C_DIGIT), (r"\p{White_Space}", C_BLANK)):
        out[[ord(x) for x in regex.findall(pattern, every)]] = c
    for chars, c in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E), (" ", C_SPACE), ("'", C_APOSTROPHE)):
        out[[ord(x) for x in chars]] = c
    out[0x110000] = C_END
    return out


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps [chunk, state], in log2(chunks) steps."""
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy().astype(np.intp), axis=1)
        reach *= 2
    return maps


class BorderScanner:
    """Borders of pieces, found in all chunks at once."""

    def __init__(self) -> None:
        self.next, self.out = border_transducer()
        self.classes = character_classes()
        flat = self.next.ravel()
        # two characters at a time: [class, class, state]
        self.pairs = flat[(np.arange(CLASSES)[None, :, None] * STATES) + self.next[:, None, :]].reshape(-1)

    def borders(self, points: np.ndarray) -> np.ndarray:
        """Positions before which a piece begins; points hold 0x110000 as the end of each text."""
        n = len(points)
        chunks = -(-n // CHUNK)
        classes = np.full(chunks * CHUNK, C_END, np.uint8)
        classes[:n] = self.classes[points]
        columns = np.ascontiguousarray(classes.reshape(chunks, CHUNK).T)
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
        for j in range(0, CHUNK, 2):
            base = (columns[j].astype(np.int32) * CLASSES + columns[j + 1]) * STATES
            maps = self.pairs[base[:, None] + maps]
        maps = compose_scan(maps)
        state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
        emitted = np.empty_like(columns)
        after, out = self.next.ravel(), self.out.ravel()
        for j in range(CHUNK):
            at = columns[j].astype(np.int32) * STATES + state
            emitted[j] = out[at]
            state = after[at]
        flat = emitted.T.reshape(-1)[:n]
        found = (flat & HERE).astype(bool)
        found[:-1] |= (flat[1:] & BEFORE_LAST).astype(bool)
        return np.flatnonzero(found)


class PieceTransducer:
    """Tokens of a piece, byte by byte.

    A state holds the longest end of what was read that some token begins with and, at each position in
    it, the last token and the number of tokens of the piece read up to there. Adding a byte ends exactly
    one token that may follow the token before it, which gives the new state and the change in number.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.age = {bytes((b,)): b for b in range(256)}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in merges:
            if a + b not in self.age:
                self.age[a + b] = len(self.age)
                self.halves[a + b] = (a, b)
        self.made = {h: self.age[t] for t, h in self.halves.items()}
        self.begins = {t[:k] for t in self.age for k in range(1, len(t))}
        self.may_follow: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[dict, int]]] = []
        self.start = self.steps[self._state((b"", (b"",), (0,)))]

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.steps.append({-1: (len(self.states), 0)})
            self.states.append(key)
        return self.number[key]

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether BPE leaves the two tokens as they are when they stand side by side.

        Both are taken apart from the youngest merge backwards; a merge across the border that is older
        than the last one taken back would have come first.
        """
        age, before = self.age, 1 << 60
        while True:
            across = self.made.get((a, b))
            if across is not None and across < before:
                return False
            # b's merge comes first where both are the same token: merging goes from left to right
            for side in ("a", "b") if age[a] > age[b] else ("b", "a"):
                if side == "a" and a in self.halves:
                    before, a = age[a], self.halves[a][1]
                    break
                if side == "b" and b in self.halves:
                    before, b = age[b] + 1, self.halves[b][0]
                    break
            else:
                return True

    def _follows(self, a: bytes, b: bytes) -> bool:
        if not a:
            return True
        if (a, b) not in self.may_follow:
            self.may_follow[a, b] = self._apart(a, b)
        return self.may_follow[a, b]

    def _compile(self, state: int, byte: int) -> tuple[dict, int]:
        tail, last, counts = self.states[state]
        tail += bytes((byte,))
        at = next(k for k in range(len(tail)) if tail[k:] in self.age and self._follows(last[k], tail[k:]))
        count = counts[at] + 1
        last, counts = (*last, tail[at:]), (*counts, count)
        keep = next((k for k in range(len(tail)) if tail[k:] in self.begins), len(tail))
        to = self._state((tail[keep:], last[keep:], tuple(c - count for c in counts[keep:])))
        self.steps[state][byte] = step = (self.steps[to], count)
        return step

    def count(self, piece: bytes) -> int:
        if len(self.states) > CACHE_STATES:
            self.clear()
        if len(self.may_follow) > 2 * CACHE_STATES:
            self.may_follow = {}
        state, total = self.start, 0
        for byte in piece:
            step = state.get(byte)
            if step is None:
                step = self._compile(state[-1][0], byte)
            state = step[0]
            total += step[1]
        return total


class TokenCounter:
    """Counts of a tokenizers file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        real = {c: b for b, c in enumerate(byte_symbols())}
        plain = lambda s: bytes(real[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = PieceTransducer([(plain(a), plain(b)) for a, b in merges])
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.scanner = BorderScanner()
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> tuple[list[str], int]:
        """Texts between special tokens, none of them much over SCAN long, and the number of special tokens."""
        parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
        found = len(parts) - 1
        if len(text) <= SCAN:
            return parts, found
        short = []
        safe = regex.compile(r"(?<=\S) ")
        for part in parts:
            at = 0
            while len(part) - at > SCAN and (m := safe.search(part, at + SCAN)):
                short.append(part[at : m.start()])
                at = m.start()
            short.append(part[at:])
        return short, found

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts are scanned together up to SCAN characters."""
        totals = [0] * len(texts)
        block: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            parts, found = self.parts(text)
            totals[i] += found
            for part in parts:
                if block and size + len(part) > SCAN:
                    self._run(block, totals)
                    block, size = [], 0
                block.append((i, part))
                size += len(part) + 1
        if block:
            self._run(block, totals)
        return totals

    def _run(self, block: list[tuple[int, str]], totals: list[int]) -> None:
        joined = "\0".join(p for _, p in block) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(p) + 1 for _, p in block]) - 1
        points[ends] = 0x110000
        borders = self.scanner.borders(points)
        own = np.searchsorted(ends, borders)
        real = borders != ends[own]
        stops = np.append(borders[1:], len(points))[real].tolist()
        pieces = [joined[a:b] for a, b in zip(borders[real].tolist(), stops, strict=True)]
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        known = self.known
        for piece in set(pieces).difference(known):
            known[piece] = self.pieces.count(piece.encode("utf-8", "surrogatepass"))
        counts = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        sums = np.bincount(own[real], counts, len(block)).astype(np.int64)
        for (i, _), n in zip(block, sums.tolist(), strict=True):
            totals[i] += n


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of each row."""
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = own.counts(texts)
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=names)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
