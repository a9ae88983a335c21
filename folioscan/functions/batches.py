"""Arrow batches by bytes: a batch is bounded by its number of rows only, which says little of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a piece.
PIECE = 1 << 20


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[pa.Array]:
    """A batch's texts or binary values, some at a time: so many bytes, but at least one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield column.slice(start, stop - start)
        start = stop
