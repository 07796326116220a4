"""Operator 5, near-duplicates by b-bit MinHash.

A document's set holds its distinct shingles of five words (ASCII letters lower-cased; a shorter text is one shingle).
Documents with equal sets become one class before anything else. For the classes, 128 minima give 32 bands of four for
candidates and, of each minimum, two bits, packed into planes of 64 lanes: the share of equal lanes, corrected for chance
equality, estimates the similarity of a candidate pair, and pairs well below the threshold go. What is left is confirmed
on the full sets. Classes that resemble some bucket's leader form a family; each class is first compared with its
likeliest leader, and then those outside a family's largest component with the whole family, in blocks whose tasks
return only links. Pairs that share a bucket but no family come last, so no link between candidates is lost.

Defined results: a null text, or one without words, has an empty set and is linked with nothing (component_id is its own
doc_id); a very long text takes part whole, with all its shingles; rows with one doc_id count as that document once per
distinct set; in filtering, rows that share doc_id and text stay or go together, and other texts of that doc_id are
judged apart; a row without doc_id gets no component and stays; columns besides doc_id and text are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  in_blocks uses it
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import columns, cut, groups, hash_words, in_blocks, joined_bytes, mix, partitions
from quire.llm.graph import components

WORDS, HASHES, ROWS = 5, 128, 4
BANDS = HASHES // ROWS
#: Buckets from this size on get a central leader, found from about so many of their members, chosen by hash.
LARGE, MAJORITY_OF = 8, 64
#: Classes on a side of a block in which all are compared.
BLOCK = 512
#: Tasks over which the members of one family are dealt.
SALTS = 32
_PICK = np.random.Generator(np.random.PCG64(2024))
_A = _PICK.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _PICK.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, end to end, and the n + 1 offsets of the texts."""
    data, offsets = joined_bytes(texts)
    h, at = hash_words(data, offsets)
    n, count = len(at) - 1, np.diff(at)
    whole = (count < words) & (count > 0)
    windows = np.where(count >= words, count - words + 1, whole)
    of = np.repeat(np.arange(n), windows)
    first = np.repeat(at[:-1] - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(len(of))
    value = np.zeros(len(of), dtype=np.uint64)
    short = whole[of]
    length = count[of]
    for k in range(words):
        use = ~short | (k < length)
        value[use] = mix(value[use] * _STEP + h[first[use] + k] + np.uint64(k + 1))
    value[short] = mix(value[short] + length[short].astype(np.uint64))
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    keep = np.ones(len(of), dtype=bool)
    keep[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    of, value = of[keep], value[keep]
    return value, np.searchsorted(of, np.arange(n + 1))


def sign(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text with shingles: BANDS band keys, and four words that hold two bits of each minimum in two planes of 64 lanes."""
    some = np.flatnonzero(np.diff(offsets))
    minima = np.empty((len(some), HASHES), dtype=np.uint64)
    if len(some):
        for k in range(HASHES):
            minima[:, k] = np.minimum.reduceat(value * _A[k] + _B[k], offsets[some])
    keys = np.zeros((len(some), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * _STEP + minima[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
    bits = mix(minima)
    lanes = np.uint64(1) << np.arange(64, dtype=np.uint64)
    planes = np.column_stack([(((bits[:, half] >> np.uint64(p)) & np.uint64(1)) * lanes).sum(axis=1, dtype=np.uint64) for half in (slice(0, 64), slice(64, 128)) for p in (0, 1)])
    return keys.view(np.int64), planes.view(np.int64)


def _signatures(batches):
    for batch in in_blocks(batches, 4_000_000):
        value, offsets = shingles(batch.column("text"))
        size = np.diff(offsets)
        some = np.flatnonzero(size)
        keys, planes = sign(value, offsets)
        sums = []
        for salt in (1, 2):
            total = np.r_[np.uint64(0), np.cumsum(mix(value ^ np.uint64(salt)))]
            sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
        row = np.full(len(size), -1)
        row[some] = np.arange(len(some))
        # Arrays only where there are shingles.
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(size > 0, x.shape[1], 0))].astype(np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("fingerprint"), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists(keys), lists(planes)],
            ["doc_id", "fingerprint", "n_shingles", "k1", "k2", "bands", "planes"],
        )


def _sets(batches):
    for batch in in_blocks(batches, 4_000_000):
        value, offsets = shingles(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.view(np.int64)))], ["id", "s"])


def _majority(batches):
    """For each bucket the planes that hold the more frequent bit of each place."""
    for batch in batches:
        out = []
        for planes in batch.column("all").to_pylist():
            bits = np.unpackbits(np.array(planes, dtype=np.int64).view(np.uint8).reshape(len(planes), -1), axis=1)
            out.append(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(planes)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("band"), pa.array(out, pa.list_(pa.int64()))], ["band", "planes"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("s"), batch.column("t")
            x, xo, y, yo = left.flatten().to_numpy(), left.offsets.to_numpy(), right.flatten().to_numpy(), right.offsets.to_numpy()
            xo, yo = xo - xo[0], yo - yo[0]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _search(percent: int, floor: float):
    """In each block: links of each asked class to one class of every other component, as far as there are any."""

    def run(batches):
        for group in groups(batches, ["family", "qb", "bb"]):
            role, ids, c = (group.column(n).to_numpy() for n in ("role", "id", "c"))
            planes = group.column("planes").combine_chunks().flatten().to_numpy().reshape(-1, 4)
            sets = group.column("s").combine_chunks()
            value, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy()
            offsets = offsets - offsets[0]
            of = lambda i: value[offsets[i] : offsets[i + 1]]
            base = np.flatnonzero(role == 1)
            pairs = []
            for i in np.flatnonzero(role == 0):
                apart = planes[base] ^ planes[i]
                equal = 128 - np.bitwise_count((apart[:, 0] | apart[:, 1]).view(np.uint64)).astype(int) - np.bitwise_count((apart[:, 2] | apart[:, 3]).view(np.uint64))
                estimate = (equal / 128 - 0.25) / 0.75
                near = np.flatnonzero((estimate >= floor) & (c[base] != c[i]))
                linked = set()
                for j in base[near[np.argsort(-estimate[near], kind="stable")]]:
                    if c[j] not in linked:
                        both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                        if 100 * both >= percent * (len(of(i)) + len(of(j)) - both):
                            linked.add(c[j])
                            pairs.append((ids[i], ids[j]))
            if pairs:
                a, b = np.array(pairs, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def similarity(a: str, b: str) -> str:
    """SQL: the estimate from the planes of rows a and b; two bits of different minima agree in a quarter of all cases."""
    equal = " - ".join(["128", *(f"bit_count(({a}.planes[{i}] ^ {b}.planes[{i}]) | ({a}.planes[{i + 1}] ^ {b}.planes[{i + 1}]))" for i in (0, 2))])
    return f"(({equal}) / 128.0 - 0.25) / 0.75"


def link(documents: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of each document."""
    return _linked(documents, percent).drop("fingerprint")


def _linked(documents: DataFrame, percent: int) -> DataFrame:
    """link, with the fingerprint of each row's text."""
    docs = columns(documents, doc_id="long", text="string")
    marked = docs.withColumn("fingerprint", F.xxhash64("text"))
    rows = cut(marked.mapInArrow(_signatures, "doc_id long, fingerprint long, n_shingles long, k1 long, k2 long, bands array<long>, planes array<long>"))
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    # One class for each set: its least document stands for it. Equal sets have equal signatures, so any row's will do.
    classes = cut(full.groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("planes").alias("planes")))
    # Two standard errors of the estimate at the threshold are 0.09; nothing within four is dropped.
    floor = percent / 100 - 0.19
    banded = classes.select("id", F.explode("bands").alias("band"))
    bits = classes.select("id", "planes")
    leads = banded.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    # Of a larger bucket, the member nearest to what most of some members have leads: it is likelier to link the others.
    large = banded.join(leads.filter(f"n >= {LARGE}").select("band", "n"), "band").join(bits, "id")
    some = large.filter(f"pmod(xxhash64(id, band), n) < {MAJORITY_OF}")
    middle = some.groupBy("band").agg(F.collect_list("planes").alias("all")).mapInArrow(_majority, "band long, planes array<long>")
    central = large.alias("a").join(middle.alias("b"), "band").groupBy("band").agg(F.expr(f"max_by(a.id, struct({similarity('a', 'b')}, -a.id)) central"))
    leads = leads.join(central, "band", "left").select("band", F.coalesce("central", "lead").alias("lead"))
    buckets = cut(banded.join(leads, "band").select("band", "id", "lead"))
    stars = buckets.filter("id != lead").select(F.col("id").alias("x"), F.col("lead").alias("y")).distinct()
    a, b = bits.alias("a"), bits.alias("b")
    stars = stars.join(a, F.col("x") == F.col("a.id")).join(b, F.col("y") == F.col("b.id")).selectExpr("a.id a", "b.id b", f"{similarity('a', 'b')} est").filter(f"est >= {floor}")
    stars = cut(stars)
    # Classes that some leader resembles are a family; only their full sets are needed, and only once.
    families = components(stars.select("a", "b"))
    sets = cut(_sets_of(docs, families.select("id")))
    # First the likeliest leader of each class: most classes need no other comparison.
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b")).selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    seen = components(_verify(best, sets, percent))
    # Then, in families that are still apart, each class outside the largest component is compared with all, in blocks.
    placed = cut(families.select("id", F.col("component_id").alias("family")).join(seen, "id", "left").selectExpr("id", "family", "coalesce(component_id, id) c"))
    sizes = placed.groupBy("family", "c").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"))
    # A family may hold a third of all classes, so it is dealt over several tasks.
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    open_ = sizes.filter("n > n_main").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    apart = salted.join(open_, ["family", "salt"]).drop("salt").join(bits, "id").join(sets, "id")
    apart = apart.selectExpr("id", "family", "c", "planes", "s", "c != main as minor", f"ceil((n - n_main) / {BLOCK}) qn", f"ceil(n / {BLOCK}) bn", "xxhash64(id) h")
    shares = "id", "family", "c", "planes", "s"
    asked = apart.filter("minor").selectExpr(*shares, "0 role", "pmod(h, qn) qb", "explode(sequence(0L, bn - 1)) bb")
    base = apart.selectExpr(*shares, "1 role", "explode(sequence(0L, qn - 1)) qb", "pmod(h, bn) bb")
    key = ["family", "qb", "bb"]
    blocks = asked.union(base).repartition(partitions(documents.sparkSession), *key).sortWithinPartitions(*key, "role")
    seen = _joined(placed.select("id", "c"), blocks.mapInArrow(_search(percent, floor), "a long, b long"))
    # Last, pairs that share a bucket but no family, though neither's leader showed it.
    at = classes.select("id").join(families.select("id", F.col("component_id").alias("family")), "id", "left").join(seen, "id", "left").selectExpr("id", "coalesce(family, id) family", "coalesce(c, id) c")
    at = cut(at)
    mixed = buckets.select("band", "id").join(at, "id")
    mixed = mixed.join(mixed.groupBy("band").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).filter("lo < hi").select("band"), "band").join(bits, "id")
    sides = mixed.alias("a").join(mixed.alias("b"), F.expr(f"a.band = b.band and a.family < b.family and a.c != b.c and {similarity('a', 'b')} >= {floor}"))
    rest = cut(sides.selectExpr("greatest(a.id, b.id) a", "least(a.id, b.id) b").distinct())
    if not rest.isEmpty():
        more = cut(_sets_of(docs, rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct()))
        at = _joined(at.select("id", "c"), _verify(rest, more, percent))
    seen = at.select("id", F.col("c").alias("component_id"))
    # Texts without words are one huge key of the join, and linked with nothing.
    members = rows.filter("n_shingles > 0").join(classes.select("n_shingles", "k1", "k2", "id"), ["n_shingles", "k1", "k2"], "left").join(seen, "id", "left")
    members = members.select("doc_id", "fingerprint", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    members = members.union(rows.filter("n_shingles = 0").select("doc_id", "fingerprint", "n_shingles", F.col("doc_id").alias("component_id")))
    return members.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _joined(at: DataFrame, edges: DataFrame) -> DataFrame:
    """at: id and c, its component. The same with the components that edges (a, b) between ids join; loops are harmless."""
    ends = edges.join(at.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(at.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    over = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("c"), F.col("component_id").alias("over"))
    return at.join(over, "c", "left").select("id", F.coalesce("over", "c").alias("c"))


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and s, the full set, of the documents with these ids."""
    # The hint keeps one plan at every size: how many documents are wanted follows the data.
    texts = docs.join(ids.hint("merge"), docs["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text")
    return texts.mapInArrow(_sets, "id long, s array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), "s"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(_confirm(percent), "a long, b long")


def deduplicate(documents: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, in their own columns, without the near-copies of a document with a smaller doc_id."""
    gone = _linked(documents, percent).filter("not kept").select(F.col("doc_id").alias("_gone"), F.col("fingerprint").alias("_text")).distinct()
    return documents.join(gone, (documents["doc_id"] == gone["_gone"]) & (F.xxhash64(documents["text"].cast("string")) == gone["_text"]), "left_anti")


#: The contract in DuckDB, by joining all shared shingles; for small tables.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from w),
x as (select doc_id, unnest(s) g from s),
p as (select a.doc_id a, b.doc_id b, count(*) c from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
k as (select a, b from p join s sa on a = sa.doc_id join s sb on b = sb.doc_id where 100 * c >= 75 * (len(sa.s) + len(sb.s) - c)),
links as (select a, b from k union all select b, a from k),
reach as (select doc_id a, doc_id b from documents union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, cast(len(s) as bigint) n_shingles, m component_id, doc_id = m kept from s join (select a, min(b) m from reach group by a) on a = doc_id
"""
