"""Arrow batches of bounded size for functions that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: A run holds about this many bytes of text and at most so many rows, so that what Python makes of it stays small.
RUN_BYTES, RUN_ROWS = 1 << 20, 4096


def runs(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in runs of about ``RUN_BYTES`` bytes of the columns ``texts``; no empty runs."""
    for batch in batches:
        sizes = [pc.fill_null(pc.binary_length(batch.column(t)), 0).cast(pa.int64()).to_pylist() for t in texts]
        start = held = 0
        for i, size in enumerate(map(sum, zip(*sizes, strict=True))):
            if i > start and (held + size > RUN_BYTES or i - start >= RUN_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
