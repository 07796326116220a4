"""Operator 11, mining hard negatives by Strassen's multiplication of anchor and candidate tiles.

Components become integers, floor(scale * x), and scores are inner products of integers, so that every comparison is exact.
A task holds a block of anchors and streams one share of the candidates past it, tile by tile: the tile's scores come from
Strassen's recursion over int64 (seven products of half the size, blocks of odd size padded with zeros, small blocks
multiplied directly), and feed a bounded heap for each anchor. Heaps of several shares merge into one.

The first pass keeps each anchor's positives, the best rows of its label. The second keeps, for each positive, the best rows
of other labels whose score lies in the window that the positive's score sets. A candidate travels once for each block of
anchors, an anchor once for each share of the candidates, and what a task returns follows its anchors only.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows without
vec_id; of rows that share a vec_id the least by label, then vector, stands for all; vectors of different lengths are padded
with zeros (an empty one scores 0 with any); equal scores go by vec_id; components of 2**63 / scale or more are held at the
limits of a long, and scores beyond a long wrap around; an anchor without positives, and a positive without rows in its
window, give no rows; columns besides vec_id, embedding and label are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import columns, cut, partitions

#: Blocks of at most this size are multiplied directly.
LEAF = 32
#: Numbers of anchors that a task holds (fewer for vectors of over 512 components), of candidates in a tile, and in a share at least and at most.
ANCHORS, TILE, LEAST, SHARE = 4096, 1024, 2048, 1_000_000
_VALID = "vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
_LOWEST = np.int64(-(2**63))


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), dtype=np.int64)
    out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out


class Heap:
    """For each of n rows, its best `most` (score, id): high scores first, then small ids."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.row, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        #: The score that a new entry must reach at least.
        self.least = np.full(n, _LOWEST)

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray):
        """scores: a row for each row of the heap, a column for each of ids, which ascend."""
        allowed = allowed & (scores >= self.least[:, None])
        some = np.flatnonzero(allowed.any(axis=1))
        if not len(some):
            return
        allowed, held = allowed[some], np.where(allowed[some], scores[some], _LOWEST)
        if held.shape[1] > self.most:
            last = np.partition(held, -self.most, axis=1)[:, -self.most, None]
            over, level = allowed & (held > last), allowed & (held == last)
            room = self.most - over.sum(axis=1, keepdims=True)
            allowed = over | level & (np.cumsum(level, axis=1, dtype=np.int32) <= room)
        row, column = np.nonzero(allowed)
        self.merge(some[row], held[row, column], ids[column])

    def merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray):
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, row))  # ~ turns the order around and can't overflow
        row, score, ids = row[order], score[order], ids[order]
        starts = np.searchsorted(row, row)
        keep = np.arange(len(row)) - starts < self.most
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.arange(len(self.row)) - np.searchsorted(self.row, self.row) == self.most - 1)
        self.least[self.row[full]] = self.score[full]


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """A row of `width` integers for each list, padded with zeros."""
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    x = np.floor(scale * np.asarray(column.flatten(), dtype=np.float64))
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = np.where(x >= 2.0**63, 2**63 - 1, np.clip(x, -(2.0**63), 2.0**63 - 2048).astype(np.int64))
    return out


def _tiles(batches, width: int, scale: int):
    """(block of anchors as a table, its integers, then an iterator of candidates' ids, labels and integers by rising id) of each group."""
    held: list[pa.RecordBatch] = []
    which, start = None, True
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("block", "share")])
        role = batch.column("role").to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (role[1:] != role[:-1])) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if role[a] == 0:
                if which != tuple(keys[a]) or not start:
                    held, which, start = [], tuple(keys[a]), True
                held.append(part)
                continue
            if which != tuple(keys[a]):
                continue  # a share without anchors
            if start:
                anchors = pa.Table.from_batches(held).combine_chunks()
                yield anchors, _integers(anchors.column("v").chunk(0), width, scale), None
                start = False
            for k in range(0, part.num_rows, TILE):
                tile = part.slice(k, TILE)
                ids = tile.column("id").to_numpy()
                order = np.argsort(ids)
                yield ids[order], tile.column("label").to_numpy()[order], np.ascontiguousarray(_integers(tile.column("v"), width, scale)[order].T)
    return


def _positives(width: int, scale: int, most: int):
    def run(batches):
        heap = anchors = None

        def out():
            ids = anchors.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[heap.row]), pa.array(heap.score), pa.array(heap.id)], ["anchor_id", "score", "id"])

        for one, two, three in _tiles(batches, width, scale):
            if three is None:
                if heap:
                    yield from out()
                anchors, x, heap = one, two, Heap(one.num_rows, most)
                mine, labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
            else:
                heap.add(strassen(x, three), one, (labels[:, None] == two) & (mine[:, None] != one))
        if heap:
            yield from out()

    return run


def _negatives(width: int, scale: int, most: int, low: tuple[int, int], high: tuple[int, int]):
    """low and high: the window's ends as fractions of the positive's score."""
    bound = lambda p, part, whole: part * (p // whole) + part * (p % whole) // whole  # noqa: E731  floor(p * part / whole) without overflow

    def run(batches):
        heaps = anchors = None

        def out():
            ids = anchors.column("id").to_numpy()
            for k, heap in enumerate(heaps):
                row = heap.row
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(positive[row, k, 1]), pa.array(positive[row, k, 0]), pa.array(heap.score), pa.array(heap.id)], ["anchor_id", "positive_id", "positive_score", "score", "id"])

        for one, two, three in _tiles(batches, width, scale):
            if three is None:
                if heaps:
                    yield from out()
                anchors, x = one, two
                found = anchors.column("positives").to_pylist()
                deepest = max(map(len, found))
                positive = np.zeros((anchors.num_rows, deepest, 2), dtype=np.int64)
                given = np.zeros((anchors.num_rows, deepest), dtype=bool)
                for r, rows in enumerate(found):
                    for k, p in enumerate(rows):
                        positive[r, k], given[r, k] = (p["score"], p["id"]), True
                least, greatest = -bound(-positive[:, :, 0], *low), bound(positive[:, :, 0], *high)
                heaps, labels = [Heap(anchors.num_rows, most) for _ in range(deepest)], anchors.column("label").to_numpy()
            else:
                scores, other = strassen(x, three), labels[:, None] != two
                for k, heap in enumerate(heaps):
                    heap.add(scores, one, other & given[:, k, None] & (scores >= least[:, k, None]) & (scores <= greatest[:, k, None]))
        if heaps:
            yield from out()

    return run


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, shares: int) -> DataFrame:
    """Each block of anchors (role 0) with each share of the candidates (role 1)."""
    asked = anchors.selectExpr("0 role", f"pmod(xxhash64(id, 1), {blocks}L) block", f"explode(sequence(0L, {shares - 1}L)) share", "id", "label", "v", *(["positives"] if "positives" in anchors.columns else []))
    base = rows.selectExpr("1 role", f"explode(sequence(0L, {blocks - 1}L)) block", f"pmod(xxhash64(id, 2), {shares}L) share", "id", "label", "v")
    key = ["block", "share"]
    both = asked.unionByName(base, allowMissingColumns=True)
    return both.repartition(max(partitions(anchors.sparkSession), min(blocks * shares, 20_000)), *key).sortWithinPartitions(*key, "role")


def _best(heaps: DataFrame, most: int, *group: str) -> DataFrame:
    """Heaps of one group merged, with rank from 1."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(
    embeddings: DataFrame, anchors: str = "id % 100 = 0", scale: int = 256, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchors: SQL over id and label that tells which rows ask. Of each anchor's best `positives` other rows of its label, the
    best `negatives` rows of other labels that score within low to high (fractions) of what the positive scores.
    """
    valid = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter(_VALID)
    kind = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    rows = cut(valid.groupBy("vec_id").agg(F.min(F.struct("label", F.col("embedding").cast(f"array<{kind}>").alias("v"))).alias("r")).selectExpr("vec_id id", "r.label label", "r.v v"))
    asked = rows.filter(anchors)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.expr(anchors)).alias("asked"), F.max(F.size("v")).alias("width")).first()
    width = max(1, sizes.width or 0)
    blocks = max(1, -(-sizes.asked // max(1, min(ANCHORS, ANCHORS * 512 // width))))
    shares = max(1, min(-(-2 * partitions(embeddings.sparkSession) // blocks), -(-sizes.n // LEAST)), -(-sizes.n // SHARE))
    near = _met(asked, rows, blocks, shares).mapInArrow(_positives(width, scale, positives), "anchor_id long, score long, id long")
    chosen = _best(near, positives, "anchor_id").groupBy("anchor_id").agg(F.expr("transform(array_sort(collect_list(struct(rank, score, id))), p -> struct(p.score, p.id)) positives"))
    with_positives = cut(asked.join(chosen, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "positives"))
    far = _met(with_positives, rows, blocks, shares).mapInArrow(_negatives(width, scale, negatives, low, high), "anchor_id long, positive_id long, positive_score long, score long, id long")
    return _best(far, negatives, "anchor_id", "positive_id").selectExpr("anchor_id", "positive_id", "rank", "id negative_id", "positive_score", "score negative_score")


def relabelled(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding and label, where the label of each seventh vec_id is the next one of ten."""
    return columns(embeddings, vec_id="long", embedding=dict(embeddings.dtypes)["embedding"], label="long").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))


#: The contract in DuckDB, by comparing each anchor with all rows.
ORACLE = """
with r as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
a as (select * from r where vec_id % 100 = 0),
s as (select a.vec_id anchor_id, a.label al, r.vec_id, r.label, cast(list_sum(list_transform(range(1, least(len(a.v), len(r.v)) + 1), lambda i: a.v[i] * r.v[i])) as bigint) score from a join r on a.vec_id <> r.vec_id),
p as (select * from (select anchor_id, vec_id positive_id, score positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) k from s where label = al) where k <= 5),
n as (select p.anchor_id, positive_id, vec_id negative_id, positive_score, score negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) k
  from p join s on p.anchor_id = s.anchor_id and label <> al and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(k as integer) as rank, negative_id, positive_score, negative_score from n where k <= 10
"""
