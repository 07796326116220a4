"""Operator 4, benchmark decontamination by spaced seeds, in DataFrame and SQL functions only.

A text's tokens are its lower-cased runs of letters and digits, compared by 64-bit hash. A document holds an item if they
agree, on some diagonal, in at least `least` of some `window` aligned tokens of the item; an item shorter than the window
must agree in the same share of all its tokens. Fixed masks ignore the other token positions: `masks` gives so many of
them that each pattern of substitutions which the rule allows leaves one mask whole, so nothing that it accepts is missed.
Test and training hashes of the masked tokens are joined, and around each hit every window that holds the seed is
compared token by token; a hit costs the same whatever the length of document and item.

A test set of up to BROADCAST_TOKENS tokens is broadcast, and nothing but the findings is shuffled. A larger one is
joined by shuffling the seeds (Spark splits frequent ones, spark.sql.adaptive.skewJoin), and the hits go back to their
documents by doc_id.

Defined results: a null text or one without tokens holds nothing; a very long text costs in proportion to its length;
rows with one doc_id are one document; a row without doc_id is never reported and stays in filtering; of equally good
windows the one that lies first in the document counts; columns besides doc_id, item_id and text are ignored, whatever
their names; an empty table on either side gives no findings.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import columns, cut

#: Up to this many test tokens are broadcast: 8 bytes each, and at most 60 for each of their seeds (three a token at the default rule).
BROADCAST_TOKENS = 200_000
#: Tokens of a piece of a document. A piece also has window - 1 tokens on each side, so a hit is judged within one small row.
PIECE = 64

TOKENS = 200_000

TOKENS = r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), t -> t != '')"


@lru_cache
def masks(size: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Masks (the token positions they look at, from 0) of which each pattern of `wrong` substitutions in `size` tokens leaves one whole somewhere.

    The fewest masks that greedy choice finds among those of half the equal tokens; 13 tokens with 3 wrong have three of
    weight five. Where there are too many patterns to try, one run of tokens that no pattern can break up.
    """
    equal = size - wrong
    if not wrong or comb(size, wrong) > 1000:
        return (tuple(range(-(-equal // (wrong + 1)))),)
    patterns = list(combinations(range(size), wrong))
    weight = max(1, equal // 2)
    left: dict[tuple[int, ...], set[int]] = {}
    for span in range(weight, size + 1):
        for inner in combinations(range(1, span - 1), max(0, weight - 2)):
            mask = tuple(sorted({0, *inner, span - 1}))
            left[mask] = {k for k, gone in enumerate(patterns) if any(not {a + p for p in mask} & set(gone) for a in range(size - span + 1))}
    chosen, open_ = [], set(range(len(patterns)))
    while open_:
        chosen.append(max(left, key=lambda m: (len(left[m] & open_), [-p for p in m])))
        open_ -= left[chosen[-1]]
    return tuple(chosen)


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.selectExpr(key, f"transform({TOKENS}, t -> xxhash64(t)) h")


def _pieces(hashed: DataFrame, window: int) -> DataFrame:
    """doc_id, lo, h (the tokens of a piece and its margins, from token lo of the document on) and start (of the piece in h)."""
    cut_up = hashed.selectExpr("doc_id", "h", f"explode(if(size(h) > 0, sequence(0, (size(h) - 1) div {PIECE}), cast(array() as array<bigint>))) c")
    placed = cut_up.selectExpr("doc_id", "h", f"cast(c * {PIECE} as int) a", f"cast(greatest(0, c * {PIECE} - {window - 1}) as int) lo")
    return placed.selectExpr("doc_id", "lo", "a - lo start", f"slice(h, lo + 1, a - lo + {PIECE + window - 1}) h")


def _seed(mask: tuple[int, ...], at: str) -> str:
    """SQL: the hash of the masked tokens of h from position `at` on, null where the mask doesn't fit."""
    return f"if({at} + {mask[-1]} < size(h), xxhash64('{'.'.join(map(str, mask))}', {', '.join(f'h[{at} + {p}]' for p in mask)}), null)"


#: SQL: equal tokens in the best window of w tokens, from first to last in the test, that holds the seed of a hit (at: in h; item_at: in the test).
_BEST = "array_max(transform(sequence(first, last), k -> aggregate(sequence(k, k + w - 1), 0, (n, j) -> n + if(get(h, at - item_at + j) = item[j - base], 1, 0))))"
#: Room for a diagonal below the count, so that one number holds both and no row is sorted to find the best.
_ROOM = 2**33


def find(documents: DataFrame, benchmark: DataFrame, window: int = 13, least: int = 10) -> DataFrame:
    """doc_id, item_id, at (the document token where the item's first token lies or would lie), same (equal tokens in the best window)."""
    docs = _hashed(columns(documents, doc_id="long", text="string").filter("doc_id is not null"), "doc_id")
    items = cut(_hashed(columns(benchmark, item_id="long", text="string").filter("item_id is not null"), "item_id").filter("size(h) > 0"))
    used, tokens = items.selectExpr(f"collect_set(least(size(h), {window})) used", "coalesce(sum(size(h)), 0) tokens").first()
    of_size = {w: masks(w, w - -(-w * least // window)) for w in used or [window]}
    tests = None
    for w, chosen in sorted(of_size.items()):
        for mask in chosen:
            of = items.filter(f"least(size(h), {window}) = {w}").selectExpr("item_id", "h", "explode(sequence(0, size(h) - 1)) item_at")
            windows = f"greatest(0, item_at + {mask[-1] + 1 - w}) first", f"least(item_at, size(h) - {w}) last", f"{w} w"
            of = of.selectExpr("item_id", "item_at", *windows, f"{_seed(mask, 'item_at')} seed").filter("seed is not null")
            tests = of if tests is None else tests.union(of)
    pieces = _pieces(docs, window)
    # The positions of a piece, their hashes and the probe of a broadcast table are one generated loop.
    seeds = ", ".join(_seed(mask, "at") for mask in sorted({m for chosen in of_size.values() for m in chosen}))
    seeded = pieces.selectExpr("doc_id", "lo", "h", f"explode(sequence(start, least(start + {PIECE}, size(h)) - 1)) at").selectExpr("doc_id", "lo", "h", "at", f"explode(array({seeds})) seed")
    texts = items.selectExpr("item_id", "h item")
    if tokens <= BROADCAST_TOKENS:
        hits = seeded.join(F.broadcast(tests), "seed").join(F.broadcast(texts), "item_id").withColumn("base", F.lit(0))
    else:
        met = seeded.select("doc_id", "lo", "at", "seed").join(tests, "seed").drop("seed").distinct()
        hits = pieces.join(met.join(texts, "item_id").withColumn("item", F.expr("slice(item, first + 1, last + w - first)")).withColumn("base", F.col("first")), ["doc_id", "lo"])
    judged = hits.selectExpr("doc_id", "item_id", "lo + at - item_at diagonal", f"{_BEST} best", "w").filter(f"best * {window} >= w * {least}")
    top = judged.groupBy("doc_id", "item_id").agg(F.expr(f"max(best * {_ROOM} - diagonal)").alias("top")).withColumn("same", F.expr(f"cast((top + {_ROOM // 2}) div {_ROOM} as int)"))
    return top.selectExpr("doc_id", "item_id", f"cast(same * {_ROOM} - top as int) at", "same")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document that holds benchmark passages: doc_id, n_items, items (their ids, comma-joined), same (of the best)."""
    found = find(documents, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.max("same").alias("same"))
    return found.selectExpr("doc_id", "cast(size(ids) as bigint) n_items", "array_join(ids, ',') items", "same")


def remove(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, in their own columns, that hold no benchmark passage."""
    leaks = contaminated(documents, benchmark).select(F.col("doc_id").alias("_leak"))
    return documents.join(leaks, documents["doc_id"] == leaks["_leak"], "left_anti")


#: The rule in DuckDB, without seeds: every diagonal with enough equal tokens, and every window on it.
ORACLE = r"""
with docs as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') h from documents),
items as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') item from benchmark),
dt as (select doc_id, unnest(h) t, unnest(range(len(h))) i from docs),
it as (select item_id, unnest(item) t, unnest(range(len(item))) j, least(13, len(item)) w from items),
hits as (select doc_id, item_id, i - j diagonal, w, list(j order by j) js from dt join it using (t) group by all having count(*) * 13 >= w * 10),
judged as (select doc_id, item_id, w, list_max(list_transform(js, lambda a: len(list_filter(js, lambda b: b >= a and b < a + w)))) best from hits)
select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct item_id)), ',') items, cast(max(best) as integer) same
from judged where best * 13 >= w * 10 group by doc_id
"""
