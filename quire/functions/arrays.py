"""Array expressions that Spark has no linear-time form of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def in_blocks(batches, most: int, column: str):
    """Arrow batches cut into pieces of about `most` bytes of a text column, so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


@F.arrow_udf(ArrayType(IntegerType()))
def running_sums(values: pa.Array) -> pa.Array:
    """The inclusive running sums of an array of numbers. A fold that appends to an array copies it at each step, so it would be quadratic.

    One running sum goes over all arrays of a batch, less what it was at the start of each; no array becomes a Python object.
    """
    flat = values.flatten()
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    total = np.cumsum(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    before = np.r_[0, total][ends - sizes]
    total -= np.repeat(before, sizes)
    offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[values.is_null().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(offsets, pa.array(total.astype(np.int32)))
