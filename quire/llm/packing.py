"""Operator 7, packing into optimal length buckets.

Lengths are counted in words (runs of anything but 0x20 and 0x09 to 0x0D). One global histogram of lengths, of bounded
size because lengths above 1,024 share logarithmic bins, goes to the driver, where dynamic programming chooses the
bucket boundaries that leave the least padding; above 1,024 words a boundary is the greatest length of its bin, which is
less than 0.6 % from any length in it, so no more padding than that can be lost. Inside each bucket, batches fill a token
budget of padded tokens.

Defined results: a null or empty text has length 0 and lies in the first bucket; repeated rows each take a place of
their own; rows of one length are ordered by doc_id; a text longer than the budget is a batch of its own; of equally good
boundaries the first counts; columns besides doc_id and text are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import columns, cut

#: Rows whose places are counted together; the shards of a bucket follow its size.
SHARD_ROWS = 4096
EXACT_TO, PER_OCTAVE = 1024, 128


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bin(length):
    """Exact lengths at first, then PER_OCTAVE bins to a doubling; larger lengths never have smaller bins."""
    return F.when(length <= EXACT_TO, length).otherwise(EXACT_TO + 1 + F.floor(F.log2(length / EXACT_TO) * PER_OCTAVE)).cast("long")


def boundaries(longest: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most `buckets` groups of adjacent bins that leave the least padding.

    longest and rows: the greatest length in each bin, ascending, and the number of rows. Padding up to a bin's own
    greatest length can't be avoided, so only rows times boundary matters.
    """
    n = len(longest)
    if not n:
        return []
    before = np.r_[0.0, np.cumsum(rows)]
    cost = before[1:] * longest  # one bucket
    choice = [np.zeros(n, dtype=int)]
    for _ in range(min(buckets, n) - 1):
        last, cost = cost, np.empty(n)
        pick = np.zeros(n, dtype=int)
        for j in range(n):  # the last bucket holds bins i..j
            total = np.r_[0.0, last[:j]] + (before[j + 1] - before[: j + 1]) * longest[j]
            pick[j] = total.argmin()
            cost[j] = total[pick[j]]
        choice.append(pick)
    out, j = [], n - 1
    for pick in reversed(choice):
        out.append(int(longest[j]))
        j = pick[j] - 1
        if j < 0:
            break
    return out[::-1]


def pack(documents: DataFrame, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens (its boundary), batch (within the bucket, from 0) and place in the batch."""
    counted = cut(columns(documents, doc_id="long", text="string").select("doc_id", words(F.col("text")).alias("n_tokens")))
    histogram = counted.groupBy(_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("rows")).orderBy("bin").collect()
    longest, rows = np.array([r.longest for r in histogram], dtype=float), np.array([r.rows for r in histogram], dtype=float)
    ends = boundaries(longest, rows, buckets)
    if not ends:
        ends = [0]
    held = np.bincount(np.searchsorted(ends, longest), rows, minlength=len(ends)).astype(int)
    # The bucket table has one row a bucket, so it stays a literal.
    literal = lambda values: F.array(*(F.lit(int(v)) for v in values))
    bucket = F.array_size(F.filter(literal(ends), lambda e: e < F.col("n_tokens")))
    placed = counted.select("doc_id", "n_tokens", bucket.alias("bucket")).select(
        "*",
        F.element_at(literal(ends), F.col("bucket") + 1).cast("long").alias("bucket_tokens"),
        F.pmod(F.xxhash64("doc_id", "n_tokens"), F.element_at(literal(-(-h // SHARD_ROWS) or 1 for h in held), F.col("bucket") + 1)).alias("shard"),
    )
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n_rows"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).drop("n_rows")
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    at = (F.col("start") + F.col("rank")).cast("long")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_tokens")))).cast("long")
    return (
        placed.withColumn("rank", rank)
        .join(starts, ["bucket", "shard"])
        .select("doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_tokens", F.floor(at / capacity).cast("long").alias("batch"), F.pmod(at, capacity).cast("long").alias("place"))
    )
