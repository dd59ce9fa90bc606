"""Vectorised views of text columns inside Arrow batches.

A text column arrives as one byte buffer plus offsets; the helpers here find and hash its words with numpy, so no
operator loops over characters in Python. A word is a maximal run of ASCII letters, digits and non-ASCII bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18

_ASCII = np.arange(256)
WORD = ((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 65) & (_ASCII <= 90)) | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint64) + np.uint64(1)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def with_doc_columns(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as bigint and text as string, without whatever other columns docs has."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in the one column of ids; all columns stay, whatever their names. Rows with a null doc_id stay."""
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = ids.toDF(name)
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[name], "left_anti")


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        out = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, np.uint64(base), np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: Any) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    buffers = column.buffers()
    if buffers[1] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole rows of about limit bytes; one long row is a run by itself."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, bounds) of the words: bounds[r]:bounds[r + 1] are the words of row r."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    start[cut] = inside[cut]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & ~inside[1:]
    cut = cut[cut > 0]
    stop[cut] |= inside[cut - 1]
    first, last = np.flatnonzero(start[:n]), np.flatnonzero(stop)
    up, down = _power_table(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER[data] * up[:n], out=total[1:])
    return first, last, mix((total[last] - total[first]) * down[first]), np.searchsorted(first, offsets)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, row bounds): a row's grams of n words; a row with fewer words has the one gram of all of them, none if it has no word."""
    counts = np.diff(bounds)
    if len(hashes) >= n:
        grams = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            grams = mix(grams * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - n + 1 + k])
    else:
        grams = np.zeros(0, np.uint64)
    keep = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(keep)])
    row = np.repeat(np.arange(len(counts)), keep)
    at = np.arange(out_bounds[-1]) - out_bounds[row] + bounds[row]
    out = np.zeros(len(at), np.uint64)
    long = counts[row] >= n
    out[long] = grams[at[long]]
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        value = hashes[bounds[r] : bounds[r] + 1]
        for k in range(bounds[r] + 1, bounds[r + 1]):
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + 1])
        out[out_bounds[r]] = mix(value ^ np.uint64(counts[r]))[0]
    return out, out_bounds
