"""Arrow batches in pieces: what Python holds is bounded by these, not by Spark's batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Bytes and rows of a piece; a longer row is a piece by itself.
BYTES, ROWS = 2 << 20, 256


def pieces(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of few rows each where rows are long. Rows aren't copied."""
    rows = max(1, min(ROWS, BYTES * len(part) // max(1, part.nbytes)))
    for first in range(0, len(part), rows):
        piece = part.slice(first, rows)
        if len(piece) > 1 and piece.nbytes > 2 * BYTES:  # lengths differ much
            yield from pieces(piece)
        else:
            yield piece


def mapped(column: pa.Array, one: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """one of each value, as an array of a kind; Python has the values of one piece at a time."""
    done = [pa.array([one(x.as_py()) for x in piece.column(0)], kind) for piece in pieces(pa.RecordBatch.from_arrays([column], ["v"]))]
    return pa.concat_arrays(done) if done else pa.array([], kind)
