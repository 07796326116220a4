"""Operator 12, the prefix trie of conversations by vertical bitmaps.

Conversations are dealt over shards by a hash of their ids. A shard indexes each (position, turn) by the set of its
conversations that have this turn there, a bitmap, and walks depth first from the root: intersecting a node's bitmap with
the postings of the next position yields the children, whose ones are counted, and the conversations that end at a node.
Nodes of several shards merge by depth and a digest of the path. Turns are 128-bit hashes of role and text from the start, so
texts don't travel. A long conversation is cut into bands of positions; a band's walk starts from the digests at its top.

Sums over subtrees need no walk: each node belongs to its smallest member, so a conversation owns a stretch at the end of
its path, and what it owns counts for all nodes of the path above. Those are running sums along each conversation, added up
by node.

Defined results: rows without conv_id are left out; null role or text is empty; turns go by number (null first), equal ones
by role, the first 64 characters of the text and a hash of both; a turn that occurs several times counts as often; a
conversation without turns ends at the root; texts count whole, whatever their length; columns besides conv_id, turn, role
and text are ignored, whatever their names; an empty table gives no nodes. One task orders a conversation's turns, and one
streams the ids that end at a node into its digest; both sort on disk where memory is short.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import columns, cut, groups, partitions

#: About so many conversations in a shard, so many positions in a band.
SHARD, BAND = 2048, 1024
_NODE = ["depth", "d1", "d2"]


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), k1, k2 (hashes of role and text) and size (bytes of the text) of each turn."""
    rows = columns(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null")
    rows = rows.selectExpr("conv_id", "turn", "coalesce(role, '') role", "coalesce(text, '') text")
    rows = rows.selectExpr("conv_id", "turn", "role", "substr(text, 1, 64) head", "xxhash64(role, text) k1", "xxhash64(1, text, role) k2", "octet_length(text) size")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "k1", "k2")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "k1", "k2", "size")


def rebuilt(turns: DataFrame, step: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another does: (turns, ids).

    Conversation c takes the first h turns of c - c % step, h = crc32(c) % spread, and then its own turns after its first h.
    """
    turns = cut(turns)
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = turns.filter(f"place < {spread - 1}").selectExpr("conv_id base", "place", "k1", "k2", "size")
    ids = counts.selectExpr("conv_id", f"conv_id - conv_id % {step} base", f"cast(crc32(cast(conv_id as string)) % {spread} as int) h")
    ids = ids.join(counts.selectExpr("conv_id base", "n"), "base", "left").selectExpr("conv_id", "base", "h", "least(h, coalesce(n, 0)) taken")
    ids = cut(ids)
    own = turns.join(ids.drop("base"), "conv_id").filter("place >= h").selectExpr("conv_id", "cast(place - h + taken as int) place", "k1", "k2", "size")
    first = ids.filter("taken > 0").join(heads, "base").filter("place < taken").select("conv_id", "place", "k1", "k2", "size")
    return own.unionByName(first), ids.select("conv_id")


def _paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's nodes: depth, k1, k2, size, whether it ends there, and the digests of the path and of the path above."""
    rows = turns.selectExpr("conv_id", "place + 1 depth", "k1", "k2", "size").union(ids.selectExpr("conv_id", "0", "0L", "0L", "0"))
    rows = rows.selectExpr("*", "xxhash64(depth, k1, k2) e1", "xxhash64(k2, k1, depth, 1) e2")
    along = Window.partitionBy("conv_id").orderBy("depth")
    digest = lambda e: F.bit_xor(e).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", digest("e1").alias("d1"), digest("e2").alias("d2"), F.lead("depth").over(along).isNull().alias("ends"))
    return rows.selectExpr("conv_id", "depth", "k1", "k2", "size", "ends", "d1", "d2", "d1 ^ e1 p1", "d2 ^ e2 p2")


def _bitmap(places: np.ndarray, n: int) -> int:
    bits = np.zeros(n, dtype=np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _ones(bitmap: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap.to_bytes(-(-n // 8), "little"), dtype=np.uint8), bitorder="little"))


def _walk(shard: pa.Table):
    """The nodes of a shard's band: for each the row of its smallest member, the number of members, and those that end there."""
    conv, depth, k1, k2, d1, d2, ends = (shard.column(c).to_numpy() for c in ("conv_id", "depth", "k1", "k2", "d1", "d2", "ends"))
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    n, top = len(starts), int(depth[0])
    stops = np.append(starts[1:], len(conv))
    of = np.repeat(np.arange(n), stops - starts)  # the conversation of each row
    # Postings: rows with one position and turn side by side.
    order = np.lexsort((of, k2, k1, depth))
    fresh = np.concatenate([[True], (depth[order][1:] != depth[order][:-1]) | (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
    bounds = np.append(np.flatnonzero(fresh), len(order))
    shared = np.flatnonzero(np.diff(bounds) > 1)
    posting = np.full(len(conv), -1)  # of each row; a turn that one conversation has there needs no bitmap
    bitmaps = []
    for p, k in enumerate(shared):
        rows = order[bounds[k] : bounds[k + 1]]
        posting[rows] = p
        bitmaps.append(_bitmap(of[rows], n))
    ending = {int(d): _bitmap(of[ends & (depth == d)], n) for d in np.unique(depth[ends])}
    deeper = {int(d): _bitmap(of[depth == d], n) for d in np.unique(depth)}
    tops = np.column_stack([d1[starts], d2[starts]])
    todo = [(_bitmap(np.flatnonzero((tops == t).all(axis=1)), n), top) for t in np.unique(tops, axis=0)]
    rows, members, ended, n_ended = [], [], [], []
    while todo:
        node, d = todo.pop()
        first = (node & -node).bit_length() - 1
        row = int(starts[first]) + d - top
        if node.bit_count() == 1:  # from here on this conversation goes alone
            below = np.arange(row, stops[first])
            rows.append(below)
            members.append(np.ones(len(below), dtype=np.int64))
            n_ended.append(ends[below].astype(np.int64))
            ended.append(conv[below[ends[below]]])
            continue
        over = node & ending.get(d, 0)
        rows.append(np.array([row]))
        members.append(np.array([node.bit_count()]))
        n_ended.append(np.array([over.bit_count()]))
        ended.append(conv[starts[_ones(over, n)]] if over else conv[:0])
        rest = node & deeper.get(d + 1, 0)
        while rest:
            first = (rest & -rest).bit_length() - 1
            p = posting[int(starts[first]) + d + 1 - top]
            child = rest & bitmaps[p] if p >= 0 else 1 << first
            todo.append((child, d + 1))
            rest ^= child
    return np.concatenate(rows), np.concatenate(members), np.concatenate(ended), np.concatenate(n_ended)


def _nodes(batches):
    for shard in groups(batches, ["shard", "band"]):
        shard = shard.combine_chunks()
        rows, members, ended, n_ended = _walk(shard)
        picked = shard.select(["depth", "d1", "d2", "p1", "p2", "conv_id", "size"]).take(pa.array(rows)).combine_chunks()
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_ended)]).astype(np.int32), pa.array(ended))
        yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in picked.columns), pa.array(members), lists], ["depth", "d1", "d2", "p1", "p2", "conv_id", "size", "n", "ends"])


def _hashed(batches):
    """The SHA-256 of each node's ids, comma-joined, from rows sorted by node and id."""
    last, digest = None, None

    def out():
        return pa.RecordBatch.from_pydict({c: [v] for c, v in zip(_NODE, last, strict=True)} | {"ends_sha256": [digest.hexdigest()]}, schema=pa.schema([("depth", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = np.column_stack([batch.column(c).to_numpy() for c in _NODE]), batch.column("member").to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        done = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            text = ",".join(map(str, ids[a:b].tolist())).encode()
            if last == tuple(keys[a]):
                digest.update(b"," + text)
            else:
                if digest:
                    done.append(out())
                last, digest = tuple(keys[a].tolist()), hashlib.sha256(text)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if digest:
        yield out()


def nodes(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of the turns (as from `ordered`) of the conversations `ids`, which may lack turns: (nodes, ends).

    nodes: depth, d1, d2, conv_id, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens. A node's last turn is the
    one at place depth - 1 of conv_id. ends: depth, d1, d2 and member, a row for each conversation.
    """
    spark = turns.sparkSession
    paths = cut(_paths(turns, ids))
    shards = max(1, -(-paths.filter("depth = 0").count() // SHARD))
    dealt = paths.selectExpr(f"cast(pmod(xxhash64(conv_id), {shards}L) as int) shard", f"depth div {BAND} band", "*")
    walked = dealt.repartition(partitions(spark), "shard", "band").sortWithinPartitions("shard", "band", "conv_id", "depth")
    parts = cut(walked.mapInArrow(_nodes, "depth int, d1 long, d2 long, p1 long, p2 long, conv_id long, size int, n long, ends array<long>"))
    merged = parts.groupBy(*_NODE).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("size").alias("size"))
    merged = cut(merged)
    children = merged.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    known = cut(merged.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # What each conversation owns, summed up from the end of its path.
    owned = known.selectExpr("conv_id", "depth", "if(n_children = 0, 1L, 0L) leaf", "(n_convs - 1) * size saved")
    owners = owned.select("conv_id").distinct()
    upwards = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = paths.select("conv_id", *_NODE).join(owners, "conv_id", "left_semi").join(owned, ["conv_id", "depth"], "left")
    sums = held.select(*_NODE, F.sum("leaf").over(upwards).alias("leaf"), F.sum("saved").over(upwards).alias("saved"))
    sums = sums.groupBy(*_NODE).agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    parents = known.selectExpr("depth + 1 depth", "d1 p1", "d2 p2", "conv_id parent_conv_id")
    table = known.join(parents, ["depth", "p1", "p2"], "left").join(sums, _NODE)
    ends = parts.selectExpr(*_NODE, "explode(ends) member")
    return table.select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


def digest(table: DataFrame, ends: DataFrame) -> DataFrame:
    """Of nodes' results: a row for each node, its ends as a SHA-256 of their ids in ascending order, comma-joined."""
    streamed = ends.repartition(partitions(ends.sparkSession), *_NODE).sortWithinPartitions(*_NODE, "member")
    hashed = streamed.mapInArrow(_hashed, "depth int, d1 long, d2 long, ends_sha256 string")
    both = table.join(hashed, _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return both.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The contract in DuckDB, over lists of turns, with crc32 from its bits; for small tables.
ORACLE = """
with own as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) turns from conversations where conv_id is not null group by conv_id),
crc as (select *, xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint)),
  lambda a, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c)), 4294967295::bigint), 4294967295::bigint) % 9 h from own),
s as (select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) turns from crc c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
m as (select conv_id, d, turns[1:d] path, d = len(turns) over_ from (select *, unnest(range(len(turns) + 1)) d from s)),
n as (select d, path, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where over_), '') ends from m group by d, path),
k as (select n.*, p.conv_id parent_conv_id, (select count(*) from n c where c.d = n.d + 1 and c.path[1:n.d] = n.path) n_children from n left join n p on p.d = n.d - 1 and p.path = n.path[1:n.d - 1])
select k.conv_id, k.d as depth, k.parent_conv_id, k.n_convs, k.n_children, count(*) filter (where u.n_children = 0) n_leaves, cast(sum((u.n_convs - 1) * case when u.d = 0 then 0 else strlen(u.path[-1].text) end) as bigint) saved_tokens, sha256(k.ends) ends_sha256
from k join k u on u.d >= k.d and u.path[1:k.d] = k.path group by k.conv_id, k.d, k.parent_conv_id, k.n_convs, k.n_children, k.ends
"""
