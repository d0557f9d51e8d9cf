"""Count-min sketches of blocks of texts, merged by range of cells.

A table is dealt to blocks by hash, once: Spark reuses that shuffle in every step that reads the blocks, so
texts move once. Each block makes a sketch of its windows: in each of ``ROWS`` rows, the sorted cells that its
windows fall into and whether a cell is met more than once. A row's cells are cut into slices; a slice of all
blocks is merged in one task, which tells each block which of the cells that it sent are counted twice or more
over all blocks. Merged counts are never too low, so a window that is estimated once is unique.

The width follows the input (``CELLS_PER_WINDOW``) without an upper limit, and so does the number of slices
and blocks: a task holds one block or one slice, nothing is collected and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, CELLS_PER_WINDOW = 2, 2
#: Bytes of text a block, windows a slice.
BLOCK_BYTES, SLICE_WINDOWS = 8 << 20, 1 << 21
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    return zstandard.ZstdCompressor(1).compress(planes)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of equal length that were packed."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(planes) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


@dataclass(frozen=True)
class Shape:
    """Sizes of the sketch: blocks of the table, bits of a cell's number, and of the number of its slice."""

    blocks: int
    bits: int
    cut: int

    @classmethod
    def of(cls, size: int, windows: int) -> Shape:
        """For a table of so many bytes of text and windows."""
        cut = max(2, (windows // SLICE_WINDOWS).bit_length())
        return cls(max(16, -(-size // BLOCK_BYTES)), max(cut + 10, (CELLS_PER_WINDOW * max(1, windows) - 1).bit_length()), cut)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return (h * _ODD[row]) >> np.uint64(64 - self.bits)

    def bounds(self, cells: np.ndarray) -> np.ndarray:
        """Where each slice begins in the sorted cells, and their number."""
        return np.searchsorted(cells, np.arange((1 << self.cut) + 1, dtype=np.uint64) << np.uint64(self.bits - self.cut))


def dealt(rows: DataFrame, by: Column, shape: Shape, name: str) -> DataFrame:
    """The rows with their block in a column of that name, dealt by it."""
    # twice as many partitions as blocks: few hold more than one or two
    return rows.withColumn(name, F.pmod(F.xxhash64(by), F.lit(shape.blocks)).cast("int")).repartition(2 * shape.blocks, name)


def _edges(values: np.ndarray) -> np.ndarray:
    """True where a sorted array has a new value."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def repeat_marks(blocks: DataFrame, name: str, shape: Shape, hashes: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """block, slice and marks (bits for the block's distinct cells in the slice: counted twice or more) from the windows' hashes of each block."""

    def sketch(key: tuple, block: pa.Table) -> pa.Table:
        number, h = key[0].as_py(), hashes(block)
        slices, blobs = [], []
        for row in range(ROWS):
            cell = np.sort(shape.cells(h, row))
            new = np.flatnonzero(_edges(cell))
            again = np.diff(np.append(new, len(cell))) > 1
            cell = cell[new]
            bounds = shape.bounds(cell)
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[k], bounds[k + 1])
                offset = (cell[part] & np.uint64((1 << (shape.bits - shape.cut)) - 1)).astype("<u4")
                slices.append((row << shape.cut) + k)
                blobs.append(pack(np.diff(offset, prepend=np.uint32(0)), again[part].view(np.uint8)))
        return pa.table({"slice": pa.array(slices, pa.int64()), "block": pa.array([number] * len(slices), pa.int32()), "cells": pa.array(blobs, pa.binary())})

    def merge(block: pa.Table) -> pa.Table:
        once, twice = (np.zeros(1 << (shape.bits - shape.cut), bool) for _ in range(2))
        own = []
        for blob in block.column("cells").to_pylist():
            gaps, again = unpack(blob, "<u4", "u1")
            at = np.cumsum(gaps, dtype=np.int64)
            twice[at] |= once[at] | again.view(bool)
            once[at] = True
            own.append(blob)
        marks = [np.packbits(twice[np.cumsum(unpack(b, "<u4", "u1")[0], dtype=np.int64)]).tobytes() for b in own]
        return pa.table({"block": block.column("block"), "slice": block.column("slice"), "marks": pa.array(marks, pa.binary())})

    cells = blocks.groupBy(name).applyInArrow(sketch, "slice long, block int, cells binary")
    return cells.groupBy("slice").applyInArrow(merge, "block int, slice long, marks binary")


def may_repeat(h: np.ndarray, marks: pa.Table, shape: Shape) -> np.ndarray:
    """Whether each of the block's windows may occur twice; h are all hashes of the block."""
    found = dict(zip(marks.column("slice").to_pylist(), marks.column("marks").to_pylist(), strict=True))
    out = np.ones(len(h), bool)
    for row in range(ROWS):
        cell = shape.cells(h, row)
        order = np.argsort(cell)
        cell = cell[order]
        new = _edges(cell)
        sizes = np.diff(shape.bounds(cell[new])).tolist()
        flags = [np.unpackbits(np.frombuffer(found[(row << shape.cut) + k], np.uint8), count=n).astype(bool) for k, n in enumerate(sizes) if n]
        if flags:
            out[order] &= np.concatenate(flags)[np.cumsum(new) - 1]
    return out
