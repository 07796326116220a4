"""Operator 6, removal of repeated 50-byte strings with the common-prefix interval tree of a sparse suffix array.

Of each window of LENGTH bytes, the GRAM-byte string with the least hash is the anchor. Equal windows have equal anchors
at equal places, so whatever repeats meets at an anchor, and what lies LENGTH bytes around it decides. Three steps:

1. Anchors are dealt by the hash of their gram. Of equal surroundings (compared by 64-bit hash), all but those in the
   least document are repeats at once. Each task first does this with its own anchors, so large groups of copies shrink
   before the shuffle.
2. Where one gram has different surroundings, the suffixes from the anchors are sorted, and a stack scan over their
   common prefixes yields the intervals of the tree. Inside an interval the preceding bytes, sorted backwards, are scanned
   the same way; an interval whose members are preceded by different bytes is a maximal repeat with all its occurrences.
   Every occurrence outside the least document of its group is a repeat.
3. The members of a gram with very many surroundings are parted, again and again, by where a window may start: those that
   start lo to hi bytes before the gram share lo bytes before it and LENGTH - hi from it on. Of members that agree in all the
   bytes of such windows, all but those in the least document are repeats at once. Parts within one document go, small ones
   take step 2, large ones are halved further. What is still large when two windows are left is dealt over several tasks; the
   windows that these leave open meet by their hash.

Matches never cross documents. Surroundings count as equal if 96 bits of hashes and the length and place in them agree.
Defined results: a null or empty text has no bytes; a very long text takes part whole; rows that share a doc_id are taken
for copies of one text; a row without doc_id is compared with nothing and keeps all its bytes; columns besides doc_id and
text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  in_blocks uses it
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import columns, cut, in_blocks, joined_bytes, mix, partitions, powers

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: More surroundings of one gram than this are dealt over several tasks.
SPLIT = 4096
#: Bytes of text whose anchors one task compares among themselves before it sends them on.
LOCAL = 10_000_000
#: Bytes of the corpus for each bucket of anchors, of which a task holds one.
BUCKET = 20_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of width values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the text, hash of the gram and hash of the surroundings of every anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    up, down = powers(_BASE, len(data)), powers(_INVERSE, len(data))
    total = np.r_[np.uint64(0), np.cumsum(_VALUE[data] * up)]
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    gram[text[: len(gram)] != text[GRAM - 1 :]] = np.uint64(2**64 - 1)
    least = _slide(gram, WINDOW, np.minimum)
    least[text[: len(least)] != text[LENGTH - 1 :]] = 0  # not a window of one text
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == gram)
    at = at[text[at] == text[at + GRAM - 1]]
    lo, hi = np.maximum(at - WINDOW + 1, offsets[text[at]]), np.minimum(at + LENGTH, offsets[text[at] + 1])
    around = mix(mix((total[hi] - total[lo]) * down[lo]) + ((hi - lo) * 128 + (at - lo)).astype(np.uint64))
    return text[at], at - offsets[text[at]], gram[at], around


def _first_in_run(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)


def _deal(buckets: int):
    def flush(held):
        doc, place, gram, around = (np.concatenate(x) for x in zip(*held, strict=True))
        both = mix(gram + around * np.uint64(3))
        order = np.argsort(both, kind="stable")
        first = _first_in_run(both[order])
        least = np.minimum.reduceat(doc[order], first) if len(first) else doc
        beaten = np.empty(len(doc), dtype=bool)
        beaten[order] = doc[order] > np.repeat(least, np.diff(np.r_[first, len(doc)]))
        # Beaten anchors only need to be reported, so they may go anywhere.
        bucket = np.where(beaten, np.arange(len(doc)) % buckets, ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
        order = np.lexsort((doc, beaten, bucket))
        doc, place, gram, around, beaten, bucket = (x[order] for x in (doc, place, gram, around, beaten, bucket))
        ends = np.r_[_first_in_run(bucket), len(bucket)]
        for a, b in zip(ends, ends[1:], strict=False):
            live = a + int((~beaten[a:b]).sum())
            runs = np.r_[_first_in_run(doc[a:b]), b - a]
            yield {
                "bucket": int(bucket[a]),
                "live": live - a,
                "docs": doc[a:b][runs[:-1]].tobytes(),
                "runs": np.diff(runs).astype(np.uint32).tobytes(),
                "low": (place[a:b] & 0xFFFF).astype(np.uint16).tobytes(),
                "high": (place[a:b] >> 16).astype(np.uint32).tobytes(),
                "gram": gram[a:live].astype(np.uint32).tobytes(),
                "around": around[a:live].tobytes(),
            }

    def run(batches):
        held, size = [], 0
        for batch in in_blocks(batches, 2_000_000):
            data, offsets = joined_bytes(batch.column("text"))
            text, place, gram, around = anchors(data, offsets)
            held.append((batch.column("doc_id").to_numpy()[text], place, gram, around))
            size += len(data)
            if size >= LOCAL:
                yield pa.RecordBatch.from_pylist(list(flush(held)), _DEALT)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(flush(held)), _DEALT)

    return run


_DEALT = pa.schema([("bucket", pa.int32()), ("live", pa.int32()), *((c, pa.binary()) for c in ("docs", "runs", "low", "high", "gram", "around"))])


def _meet(split: int):
    """Of each bucket's anchors, one bucket at a time: what is repeated at once, what needs its surroundings compared (with a key), and for what one of these stands."""

    def solve(bucket, held):
        doc, place, gram, around = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(doc):
            return
        order = np.lexsort((doc, around, gram))
        doc, place, gram, around = doc[order], place[order], gram[order], around[order]
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new_around = new_gram | np.r_[True, around[1:] != around[:-1]]
        first = np.flatnonzero(new_around)
        beaten = doc > np.repeat(doc[first], np.diff(np.r_[first, len(doc)]))
        yield _rows(doc[beaten], place[beaten])
        # Different surroundings in different documents are left; a gram in one document only can't repeat across documents.
        start = np.flatnonzero(new_gram)
        size = np.diff(np.r_[start, len(doc)])
        apart = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        kinds = np.add.reduceat(new_around.astype(np.int64), start)
        live = np.repeat(apart & (kinds > 1), size) & ~beaten
        # What is left of one surroundings lies in one document: its first place stands for the others.
        use, others = live & new_around, live & ~new_around
        of = np.repeat(first, np.diff(np.r_[first, len(doc)]))
        yield _rows(doc[others], place[others], stands=place[of[others]])
        members = np.add.reduceat(new_around.astype(np.int64), start)
        pieces = np.repeat(-(-members // split), size)[use]
        salt = (mix(around[use]) % pieces.astype(np.uint64)).astype(np.int32)
        yield _rows(doc[use], place[use], (np.int64(bucket) << 32) | gram[use].astype(np.int64), np.where(pieces > 1, salt, -1).astype(np.int32))

    def run(batches):
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != now and held:
                    yield from solve(now, held)
                    held = []
                now = r["bucket"]
                doc = np.repeat(np.frombuffer(r["docs"], dtype=np.int64), np.frombuffer(r["runs"], dtype=np.uint32))
                place = np.frombuffer(r["low"], dtype=np.uint16).astype(np.int64) | np.frombuffer(r["high"], dtype=np.uint32).astype(np.int64) << 16
                n = r["live"]
                held.append((doc[:n], place[:n], np.frombuffer(r["gram"], dtype=np.uint32), np.frombuffer(r["around"], dtype=np.uint64)))
                if n < len(doc):
                    yield _rows(doc[n:], place[n:])
        if held:
            yield from solve(now, held)

    return run


def _rows(doc, place, key=None, salt=None, stands=None) -> pa.RecordBatch:
    rest = [pa.nulls(len(doc), t) if x is None else pa.array(x) for x, t in ((key, pa.int64()), (salt, pa.int32()), (stands, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), *rest], ["doc_id", "place", "key", "salt", "stands"])


def _squeeze(batches):
    """Texts, compressed: they travel twice."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in in_blocks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([squeeze((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "z"])


def _slices(batches, rows: int = 1000):
    """Pieces of the batches, so that what Python holds of them stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _surroundings(batches):
    """What lies around the anchors."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in _slices(batches):
        out = {c: [] for c in ("key", "salt", "doc_id", "place", "left", "right")}
        for r in batch.to_pylist():
            text = expand(r["z"])
            for a in r["at"]:
                p = a["place"]
                for c, v in zip(out, (a["key"], a["salt"], r["doc_id"], p, text[max(0, p - WINDOW + 1) : p][::-1], text[p : p + LENGTH]), strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["salt"], pa.int32()), pa.array(out["doc_id"], pa.int64()), pa.array(out["place"], pa.int64()), pa.array(out["left"], pa.binary()), pa.array(out["right"], pa.binary())], list(out))


def _sized(members: DataFrame, *by: str) -> DataFrame:
    """Members with the size n of their group and its least and greatest document. Shares of a group (salt) are counted and joined apart."""
    shares = members.groupBy(*by, "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    whole = Window.partitionBy(*by)
    sizes = shares.select(*by, "salt", F.sum("n").over(whole).alias("n"), F.min("least").over(whole).alias("least"), F.max("most").over(whole).alias("most"))
    return members.join(sizes, [*by, "salt"])


def _parted(members: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of the members of very frequent grams: repeats that need no comparison, and what _tree is to compare (salt -1: a whole part)."""
    member = ["key", "salt", "doc_id", "place", "left", "right"]
    repeated, compared = [], []
    left = members.selectExpr(*member, "0 lo", f"{WINDOW - 1} hi")
    for _ in range((WINDOW - 1).bit_length() - 1):
        if left.isEmpty():
            break
        sides = left.selectExpr(*member, "explode(filter(array(struct(lo, (lo + hi) div 2 as hi), struct((lo + hi) div 2 + 1 as lo, hi)), s -> s.lo <= s.hi)) s").selectExpr(*member, "cast(s.lo as int) lo", "cast(s.hi as int) hi")
        windows = sides.filter(f"greatest(lo, {LENGTH} - octet_length(right)) <= least(hi, octet_length(left))")
        agree = windows.selectExpr("*", "substring(left, 1, hi) before", f"substring(right, 1, {LENGTH} - lo) behind")
        agree = cut(_sized(agree, "key", "lo", "hi", "before", "behind").select(*member, "lo", "hi", "least"))
        repeated.append(agree.filter("doc_id > least").selectExpr("doc_id", "place", "place - least(hi, octet_length(left)) start", f"place + least({LENGTH} - lo, octet_length(right)) end"))
        # Parts whose hashes collide are compared together, which changes no result.
        parts = agree.filter("doc_id = least").selectExpr(*member, "lo", "hi", f"xxhash64(lo, hi, substring(left, 1, lo), substring(right, 1, {LENGTH} - hi)) half")
        parts = cut(_sized(parts, "key", "half").filter("least < most").select(*member, "lo", "hi", "half", "n"))
        compared.append(parts.filter(f"n <= {SPLIT}").withColumn("salt", F.lit(-1)).drop("n"))
        left = parts.filter(f"n > {SPLIT}").drop("n")
    return repeated, [*compared, left] if compared else []


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(ordered: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """The common-prefix intervals (depth, first, last) of sorted strings with depth >= least, by a stack scan."""
    out, stack = [], []
    for i in range(1, len(ordered) + 1):
        depth = common(ordered[i - 1], ordered[i]) if i < len(ordered) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i - 1))
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def maximal_repeats(members: list[tuple[bytes, bytes]], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of each group that repeats at least `length` bytes around the anchor.

    members: the bytes before an anchor, backwards, and those from it on. A group's string extends neither way without
    losing a member (or meeting the end of what is known).
    """
    order = sorted(range(len(members)), key=lambda i: members[i][1])
    out = []
    for right, first, last in intervals([members[i][1] for i in order], gram):
        group = sorted(order[first : last + 1], key=lambda i: members[i][0])
        need = max(0, length - right)
        for left, a, b in intervals([members[i][0] for i in group], need):
            part = group[a : b + 1]
            # A part of the interval may go on alike for longer: then a deeper interval has it.
            if len(part) == len(group) or common(min(members[i][1] for i in part), max(members[i][1] for i in part)) == right:
                out.append((left, right, part))
    return out


def _tree(batches):
    """Repeats (h1 null) of the groups of one gram, and the windows that a part of a large group leaves open."""
    group, last = [], None

    def solve(salt):
        spans, n = [], len(group)
        for left, right, members in maximal_repeats([(g[2], g[3]) for g in group]):
            least = min(group[i][0] for i in members)
            spans += [(i, left, right) for i in members if group[i][0] > least]
        # All repeats of a member hold its anchor, so together they are one stretch.
        most: dict[int, tuple[int, int]] = {}
        for i, left, right in spans:
            a, b = most.get(i, (0, 0))
            most[i] = max(a, left), max(b, right)
        for i, (left, right) in most.items():
            doc, place = group[i][:2]
            out["doc_id"].append(doc)
            out["place"].append(place)
            out["start"].append(place - left)
            out["end"].append(place + right)
            out["h1"].append(None)
            out["h2"].append(None)
        if salt >= 0:
            covered = [set() for _ in range(n)]
            for i, left, right in spans:
                covered[i].update(range(max(0, LENGTH - right), left + 1))
            for i, (doc, place, before, after, lo, hi) in enumerate(group):
                whole = before[::-1] + after
                for o in range(max(lo, LENGTH - len(after)), min(hi, len(before)) + 1):
                    if o not in covered[i]:
                        s = len(before) - o
                        h = np.frombuffer(hashlib.blake2b(whole[s : s + LENGTH], digest_size=16).digest(), dtype=np.int64)
                        out["doc_id"].append(doc)
                        out["place"].append(place)
                        out["start"].append(place - o)
                        out["end"].append(place - o + LENGTH)
                        out["h1"].append(int(h[0]))
                        out["h2"].append(int(h[1]))

    fields = ("doc_id", "place", "start", "end", "h1", "h2")
    out = {c: [] for c in fields}
    for batch in batches:
        for key, half, salt, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "half", "salt", "doc_id", "place", "left", "right", "lo", "hi")), strict=True):
            if (key, half, salt) != last:
                if len(group) > 1 or group and last[2] >= 0:
                    solve(last[2])
                group, last = [], (key, half, salt)
            group.append(member)
        if len(out["doc_id"]) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in fields], list(fields))
            out = {c: [] for c in fields}
    if len(group) > 1 or group and last[2] >= 0:
        solve(last[2])
    yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in fields], list(fields))


def _removed(spans, n: int) -> list[tuple[int, int]]:
    """The maximal runs of the spans, within the text's n bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, s["start"]), min(n, s["end"])) for s in spans or []):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finish(batches):
    expand = zstandard.ZstdDecompressor().decompress
    for batch in _slices(batches):
        rows = []
        for r in batch.to_pylist():
            text = expand(r["z"])
            runs, last, kept = _removed(r["spans"], len(text)), 0, []
            for a, b in runs:
                kept.append(text[last:a])
                last = b
            kept.append(text[last:])
            left = b"".join(kept)
            rows.append({"doc_id": r["doc_id"], "n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": len(runs), "kept_sha256": hashlib.sha256(left).hexdigest(), "removed": [{"start": a, "end": b} for a, b in runs]})
        yield pa.RecordBatch.from_pylist(rows, _FINISHED)


_FINISHED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def repeats(documents: DataFrame) -> DataFrame:
    """doc_id, start and end (bytes) of repeated stretches; they may overlap."""
    docs = columns(documents, doc_id="long", text="string").filter("doc_id is not null")
    n = partitions(documents.sparkSession)
    schema = "bucket int, live int, docs binary, runs binary, low binary, high binary, gram binary, around binary"
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = docs.mapInArrow(_deal(max(n, -(-size // BUCKET))), schema).repartition(n, "bucket").sortWithinPartitions("bucket")
    met = cut(dealt.mapInArrow(_meet(SPLIT), "doc_id long, place long, key long, salt int, stands long"))
    at_once = met.filter("key is null and stands is null").selectExpr("doc_id", f"greatest(0, place - {WINDOW - 1}) start", f"place + {LENGTH} end")
    asked = met.filter("key is not null").groupBy("doc_id").agg(F.collect_set(F.struct("key", "salt", "place")).alias("at"))  # as many as the text has anchors at most
    texts = docs.mapInArrow(_squeeze, "doc_id long, z binary")
    around = cut(texts.join(asked, "doc_id").select("doc_id", "z", "at").mapInArrow(_surroundings, "key long, salt int, doc_id long, place long, left binary, right binary"))
    repeated, compared = _parted(around.filter("salt >= 0"))
    members = around.filter("salt < 0").selectExpr("*", "cast(null as long) half", "cast(null as int) lo", "cast(null as int) hi")
    for part in compared:
        members = members.unionByName(part)
    solved = cut(members.repartition(n, "key", "half", "salt").sortWithinPartitions("key", "half", "salt").mapInArrow(_tree, "doc_id long, place long, start long, end long, h1 long, h2 long"))
    shape = "doc_id", "place", "start", "end"
    spans = solved.filter("h1 is null").select(*shape)
    windows = solved.filter("h1 is not null")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    decided = spans.union(windows.join(least, ["h1", "h2"]).filter("doc_id > least").select(*shape))
    for part in repeated:
        decided = decided.union(part)
    others = met.filter("stands is not null").selectExpr("doc_id", "stands place", "place - stands shift")
    copied = others.join(decided, ["doc_id", "place"]).selectExpr("doc_id", "start + shift start", "end + shift end")
    return at_once.union(decided.select("doc_id", "start", "end")).union(copied)


def remove(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (the maximal runs) of each row."""
    spans = repeats(documents).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = columns(documents, doc_id="long", text="string").mapInArrow(_squeeze, "doc_id long, z binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start long, end long>>"
    return texts.join(spans, "doc_id", "left").select("doc_id", "z", "spans").mapInArrow(_finish, schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.drop("removed")


#: The contract in DuckDB, over every window of every text; for small tables.
ORACLE = f"""
with d as (select doc_id, hex(coalesce(text, '')) h, strlen(coalesce(text, '')) n from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) g from (select doc_id, h, unnest(range(0, n - {LENGTH - 1})) p from d where n >= {LENGTH})),
m as (select g, min(doc_id) m from w group by g having min(doc_id) < max(doc_id)),
r as (select doc_id, p from w join m using (g) where m < doc_id),
i as (select *, sum(new) over (partition by doc_id order by p) k from (select *, case when p <= lag(p) over (partition by doc_id order by p) + {LENGTH} then 0 else 1 end new from r)),
s as (select doc_id, min(p) a, max(p) + {LENGTH} b from i group by doc_id, k),
t as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) z from s),
u as (select t.doc_id, count(*) spans, sum(b - a) gone, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) pieces, max(b) last_ from t join d on d.doc_id = t.doc_id group by t.doc_id)
select d.doc_id, n n_bytes, cast(coalesce(gone, 0) as bigint) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(pieces || substr(h, 2 * last_ + 1), h))) kept_sha256 from d left join u on u.doc_id = d.doc_id
"""
