"""Words of texts found on their UTF-8 bytes: a table of 256 entries tells which bytes stand in words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are cut into words at once; a longer text is cut by itself, whole.
CHUNK_BYTES = 1 << 22


def word_table(*outside: tuple[int, int]) -> np.ndarray:
    """By byte: 0 for bytes in the closed ranges outside words, else the byte, with A-Z as lower-case letters.

    Ranges are of ASCII, so that all bytes of another character stand in words; byte 0 must be outside.
    """
    table = np.arange(256, dtype=np.uint8)
    for low, high in outside:
        table[low : high + 1] = 0
    table[65:91] = table[97:123]
    return table


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts without nulls, concatenated as they stand, and where each begins and ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 outside words), and start, end and text of each word; no word spans two texts."""
    low = table[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    # Where a text begins, a word that goes on from the text before is cut.
    edge = offsets[1:-1]
    cut = edge[inside[edge] & inside[edge + 1]]
    starts[cut] = ends[cut] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return low, start, end, np.searchsorted(offsets, start, side="right") - 1


def flat(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start .. start + length - 1 of every span, one after the other."""
    first = np.cumsum(length) - length
    return np.arange(int(length.sum()), dtype=np.int64) + np.repeat(start - first, length)
