"""Arrow batches cut so that the text in a piece stays within a few megabytes."""

from collections.abc import Iterator

import pyarrow as pa

PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str = "text",
           limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def ragged(starts, lengths):
    """Indices of the concatenated ranges ``start .. start + length``."""
    import numpy as np

    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts) - (ends - lengths), lengths)
