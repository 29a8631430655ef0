"""Python functions over a column's Arrow batches, a few megabytes of values at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: About so many bytes of a batch are Python objects at once; a batch itself has spark.sql.execution.arrow.maxBytesPerBatch.
SLICE_BYTES = 1 << 20


def slices(batch: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A batch in slices of about so many bytes; a longer value stands alone or with short ones."""
    rows = max(1, len(batch) * most // max(batch.nbytes, 1))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def each(column: Column, f: Callable[[str | None], object], kind: str) -> Column:
    """f of each value, null as None; kind is string or array<string>. What is made is sent slice by slice, so a worker holds a batch and one slice's objects."""
    made = {"string": pa.string(), "array<string>": pa.list_(pa.string())}[kind]

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([f(x) for x in part.to_pylist()], made)

    return run(column)
