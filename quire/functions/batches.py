"""Text functions in Python, a slice of rows at a time.

An Arrow batch holds 10,000 rows or 64 MB of them, whichever comes first.  Made into Python objects and back at once, it takes several times that in each of an executor's workers; so rows go through in
slices of SLICE_BYTES, and each slice's result is sent on before the next one is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of text in a slice; a longer text is one of its own.
SLICE_BYTES = 1 << 18


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The rows of texts, in order, in slices of `size` bytes at most or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield texts.slice(a, b - a)
        a = b


def by_slice(f: Callable[[list], list]):
    """A UDF of texts from a function of lists of them (nulls included), of which it gets a slice at a time."""

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for some in slices(batch):
                yield pa.array(f(some.to_pylist()), pa.string())

    return run
