"""Operator 3, near-duplicate vectors by sorted projection passes.

Equal vectors become one class. Each pass orders the classes lexicographically by 64 concatenated random hashes (the
sides of 64 random hyperplanes) and compares every vector with a bounded window of its neighbours; pairs at or above the
cosine, in double precision, are links, and the links of all passes are united into components. The number of passes
follows the number of vectors, so that a pair right at the threshold is missed with a probability of about `miss`.

That holds while a window reaches past what is near. Where vectors are crowded it doesn't: vectors that are still near
each other at the far end of a window form a crowd. In a crowd, what lies outside the largest component is compared with
all, in square blocks whose tasks return only links between components, or, where that would copy a vector more often,
by more passes over the crowd's vectors less their mean, as many as its size and spread call for.

A bounded window can't hold all links of a dense group, so these are then counted exactly inside each component. With
the angles a(x) to a pivot, x and y are surely linked if a(x) + a(y) is within the linking angle: a vector for which that
holds with the farthest member has all members as its links. The others are compared with each other in square blocks
whose tasks only return counts.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component is linked with nothing, and
vectors of different lengths aren't linked; rows with one vec_id count as so many vectors; a row without vec_id has no
links and no component; columns besides vec_id and embedding are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  _counts uses it
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, groups, partitions
from quire.llm.graph import components

BITS, WINDOW, BLOCK = 64, 16, 1024
#: Vectors within this many linking angles of each other are near: 47 degrees at a cosine of 0.95. Wider cones part at their
#: first hashes, so that windows hold the pairs at the threshold; narrower ones fill the windows and count as crowds.
NEAR = 2.6
_VALID = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"


def _matrix(column) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def n_passes(vectors: int, cosine: float, window: int = WINDOW, miss: float = 1e-4) -> int:
    """So many passes that a pair at the cosine shares, but for `miss`, some prefix that parts it from all but a window."""
    agree = 1 - np.arccos(cosine) / np.pi
    # A tenth is left for pairs that a border between partitions parts.
    found = 0.9 * agree ** max(1.0, log2(max(2, vectors) / window) + 1)
    return max(8, ceil(log(miss) / log(1 - found)))


def _keys(batches):
    """A row for each pass of each vector with its key: the sides of 64 hyperplanes through the crowd's centre."""
    for batch in batches:
        crowd, dim, passes = (batch.column(c).to_numpy() for c in ("crowd", "dim", "passes"))
        for c, d in np.unique(np.column_stack([crowd, dim]), axis=0):
            at = (crowd == c) & (dim == d)
            part = batch.filter(pa.array(at))
            x, centre = _matrix(part.column("v")), part.column("centre")[0].as_py()
            if centre is not None:
                x = x - np.array(centre)
            for p in range(passes[at][0]):
                planes = np.random.Generator(np.random.PCG64([int(d), p])).standard_normal((int(d), BITS))
                side = np.packbits(x @ planes > 0, axis=1).view(">u8").astype(np.uint64).ravel()
                key = (side ^ np.uint64(1 << 63)).view(np.int64)  # signed order is lexicographic
                yield pa.RecordBatch.from_arrays([part.column("crowd"), pa.array(np.full(len(key), p, dtype=np.int32)), part.column("dim"), pa.array(key), part.column("id"), part.column("v")], ["crowd", "pass", "dim", "key", "id", "v"])


def _neighbours(cosine: float, window: int):
    """Links (far false) within windows, and pairs that are near each other at the far end of a window."""
    near = float(np.cos(NEAR * np.arccos(cosine)))

    def run(batches):
        last, held, ids_held = None, None, None
        for batch in batches:
            which = np.column_stack([batch.column(c).to_numpy() for c in ("crowd", "pass", "dim")]).astype(np.int64)
            cuts = [0, *(np.flatnonzero((which[1:] != which[:-1]).any(axis=1)) + 1), len(which)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                x, ids = _matrix(part.column("v")), part.column("id").to_numpy()
                known = 0
                if last == tuple(which[a]):
                    known = len(ids_held)
                    x, ids = np.concatenate([held, x]), np.concatenate([ids_held, ids])
                for s in range(1, min(window, len(ids) - 1) + 1):
                    skip = max(0, known - s)  # pairs within what was carried over have been seen
                    dots = np.einsum("ij,ij->i", x[skip:-s], x[skip + s :])
                    for far, found in ((False, dots >= cosine), (True, dots >= near if s == window else None)):
                        if found is not None and found.any():
                            one, other = ids[skip:-s][found], ids[skip + s :][found]
                            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other), pa.array(np.full(len(one), far))], ["a", "b", "far"])
                last, held, ids_held = tuple(which[a]), x[-window:], ids[-window:]

    return run


def _passes(vectors: DataFrame, cosine: float, window: int) -> DataFrame:
    """vectors: crowd, passes, centre, dim, id, v -> a, b, far."""
    n, kind = partitions(vectors.sparkSession), vectors.schema["v"].dataType.simpleString()
    order = "crowd", "pass", "dim", "key", "id"
    keyed = vectors.select("crowd", "passes", "centre", "dim", "id", "v").mapInArrow(_keys, f"crowd long, pass int, dim int, key long, id long, v {kind}")
    return keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(cosine, window), "a long, b long, far boolean")


def _sums(batches):
    """Of each group in a batch, the sum of its unit vectors."""
    for batch in batches:
        group, dim = batch.column("g").to_numpy(), batch.column("dim").to_numpy()
        for d in np.unique(dim):
            at = dim == d
            x, (names, place) = _matrix(batch.column("v").filter(pa.array(at))), np.unique(group[at], return_inverse=True)
            out = np.zeros((len(names), int(d)))
            np.add.at(out, place, x)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(place)), pa.array(list(out), pa.list_(pa.float64()))], ["g", "n", "s"])


def _means(vectors: DataFrame, group: str) -> DataFrame:
    """g, n (members) and mean of the unit vectors of each group; batches are summed before anything is shuffled."""
    partial = vectors.select(F.col(group).alias("g"), "dim", "v").mapInArrow(_sums, "g long, n long, s array<double>").selectExpr("g", "n", "posexplode(s) as (i, s)")
    sums = partial.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.groupBy("g").agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(i, s / n m))), x -> x.m)").alias("mean"))


def _angles(batches):
    for batch in batches:
        sizes = batch.column("dim").to_numpy()
        angle = np.empty(len(sizes))
        for d in np.unique(sizes):
            at = sizes == d
            x, p = _matrix(batch.column("v").filter(pa.array(at))), np.asarray(batch.column("pivot").filter(pa.array(at)).flatten()).reshape(at.sum(), -1)
            norm = np.sqrt(np.einsum("ij,ij->i", p, p))
            # A mean of zero gives no direction: then every vector counts as far away, which only costs comparisons.
            angle[at] = np.where(norm > 1e-9, np.arccos(np.clip(np.einsum("ij,ij->i", x, p) / np.maximum(norm, 1e-9), -1, 1)), np.pi)
        yield pa.RecordBatch.from_arrays([batch.column("component_id"), batch.column("id"), batch.column("copies"), pa.array(angle)], ["component_id", "id", "copies", "angle"])


def _pairs_of(batches, keys: list[str]):
    """The asked and the base rows (role 0 and 1) of each block, and which of them are one vector."""
    for group in groups(batches, keys):
        query, base = (group.filter(pa.compute.field("role") == r) for r in (0, 1))
        if query.num_rows and base.num_rows:
            yield query, base, query.column("id").to_numpy(), base.column("id").to_numpy()


def _counts(cosine: float):
    def run(batches):
        for query, base, q, b in _pairs_of(batches, ["component_id", "qb", "bb"]):
            near = _matrix(query.column("v")) @ _matrix(base.column("v")).T >= cosine
            near &= q[:, None] != b[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(near @ base.column("copies").to_numpy())], ["id", "near"])

    return run


def _search(cosine: float):
    """In each block: links of each asked vector to one vector of every other component, as far as there are any."""

    def run(batches):
        for query, base, q, b in _pairs_of(batches, ["crowd", "qb", "bb"]):
            mine, theirs = query.column("c").to_numpy(), base.column("c").to_numpy()
            i, j = np.nonzero((_matrix(query.column("v")) @ _matrix(base.column("v")).T >= cosine) & (mine[:, None] != theirs[None, :]))
            first = np.unique(np.column_stack([i, theirs[j]]), axis=0, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(q[i[first]]), pa.array(b[j[first]])], ["a", "b"])

    return run


def _blocks(asked: DataFrame, base: DataFrame, group: str, n: int, *shares: str) -> DataFrame:
    """Asked and base rows, with qn and bn (their numbers of blocks) and h (a hash), dealt to all blocks of their group."""
    key = [group, "qb", "bb"]
    sides = asked.selectExpr(group, *shares, "0 role", "pmod(h, qn) qb", "explode(sequence(0L, bn - 1)) bb").union(base.selectExpr(group, *shares, "1 role", "explode(sequence(0L, qn - 1)) qb", "pmod(h, bn) bb"))
    return sides.repartition(n, *key).sortWithinPartitions(*key, "role")


def _crowd_links(classes: DataFrame, far: DataFrame, seen: DataFrame, cosine: float, window: int) -> DataFrame:
    """Links (a, b) that join components within crowds, which the pairs in `far` make up."""
    placed = cut(classes.join(components(far).withColumnRenamed("component_id", "crowd"), "id").join(seen.withColumnRenamed("component_id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id")))
    largest = placed.groupBy("crowd", "c").agg(F.count("*").alias("n_main")).groupBy("crowd").agg(F.max("n_main").alias("n_main"), F.max_by("c", F.struct("n_main", -F.col("c"))).alias("main"))
    # Of a pair at the threshold, what is left of its cosine without the crowd's mean.
    passes = F.udf(lambda n, mean: n_passes(n, max(0.3, (cosine - sum(x * x for x in mean)) / max(1e-9, 1 - sum(x * x for x in mean))), window), "int")
    crowds = _means(placed, "crowd").join(largest, F.col("g") == F.col("crowd")).filter("n > n_main").select("crowd", "n", "n_main", "main", F.col("mean").alias("centre"), passes("n", "mean").alias("passes"))
    crowds = cut(crowds.withColumn("bn", F.ceil(F.col("n") / BLOCK)).withColumn("qn", F.ceil((F.col("n") - F.col("n_main")) / BLOCK)))
    members = placed.join(crowds, "crowd").withColumn("h", F.xxhash64("id"))
    compared = members.filter("bn <= passes")
    blocks = _blocks(compared.filter("c != main"), compared, "crowd", partitions(classes.sparkSession), "id", "c", "v")
    passed = _passes(members.filter("bn > passes"), cosine, window).filter("not far").select("a", "b")
    return blocks.mapInArrow(_search(cosine), "a long, b long").union(passed)


def link(embeddings: DataFrame, cosine: float = 0.95, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of each row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    valid = rows.filter(_VALID).filter("vec_id is not null")
    classes = cut(valid.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).selectExpr("id", "copies", "size(embedding) dim", "embedding v"))
    everyone = classes.withColumns({"crowd": F.lit(0).cast("long"), "passes": F.lit(n_passes(classes.count(), cosine, window)), "centre": F.lit(None).cast("array<double>")})
    met = cut(_passes(everyone, cosine, window).distinct())
    links = met.filter("not far").select("a", "b")
    more = _crowd_links(classes, met.filter("far").select("a", "b"), components(links), cosine, window)
    seen = components(links.union(more))
    linked = cut(classes.join(seen, "id"))
    pivots = _means(linked, "component_id").selectExpr("g component_id", "mean pivot")
    angles = cut(linked.join(pivots, "component_id").mapInArrow(_angles, "component_id long, id long, copies long, angle double"))
    limit = float(np.arccos(cosine)) - 1e-7
    widest = angles.groupBy("component_id").agg(F.max("angle").alias("widest"))
    judged = angles.join(widest, "component_id").withColumn("sure", F.col("angle") + F.col("widest") <= limit)
    sizes = judged.groupBy("component_id").agg(
        F.sum("copies").alias("all_copies"), F.sum(F.when(F.col("sure"), F.col("copies")).otherwise(0)).alias("sure_copies"), F.sum(F.when(F.col("sure"), 0).otherwise(1)).alias("unsure")
    )
    judged = cut(judged.join(sizes, "component_id"))
    unsure = judged.filter("not sure").join(classes.select("id", "v"), "id").selectExpr("*", f"ceil(unsure / {BLOCK}) qn", f"ceil(unsure / {BLOCK}) bn", "xxhash64(id) h")
    blocks = _blocks(unsure, unsure, "component_id", partitions(embeddings.sparkSession), "id", "copies", "v")
    counted = blocks.mapInArrow(_counts(cosine), "id long, near long").groupBy("id").agg(F.sum("near").alias("near"))
    links = judged.join(counted, "id", "left").selectExpr("id", "component_id", "if(sure, all_copies, sure_copies + copies + coalesce(near, 0)) - 1 n_links")
    by_class = classes.join(links, "id", "left").selectExpr("v embedding", "coalesce(component_id, id) component_id", "coalesce(n_links, copies - 1) n_links")
    found = valid.join(by_class, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.filter(f"not ({_VALID}) or vec_id is null").selectExpr("vec_id", "0L n_links", "vec_id component_id")
    return found.union(rest).selectExpr("vec_id", "n_links", "component_id", "vec_id = component_id kept")


#: The contract in DuckDB, by comparing all pairs; for small tables.
ORACLE = """
with recursive good as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id a, vec_id b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
n as (select a, count(*) n from links group by a)
select vec_id, coalesce(max(n.n), 0) n_links, min(reach.b) component_id, vec_id = min(reach.b) kept from embeddings join reach on vec_id = reach.a left join n on vec_id = n.a group by vec_id
"""
