"""Operator 2, stupid-backoff scores over the corpus's own word n-grams (orders three to one).

The score of a word d after b and c is log(c(bcd) / c(bc)) if the count tables hold bcd, that is if it occurs at least
`least` times in the corpus; else it is log(backoff) plus the score of d after c alone, which is log(c(cd) / c(c)) if cd
is held and else log(backoff * c(d) / N). A text's first word has log(c(d) / N), its second one the score after c alone.
Counts are of all documents.

Exploded n-grams and their counts meet by hash. Each occurrence of a bigram goes once to the bucket of its hash, with the
words on both sides: there the bigram is counted, and so are the trigrams that it begins and ends, so that one shuffle
serves both orders. Counts are joined back at once and summed per document; what needs the count of a rare word is
passed on and meets the unigram table by the word's hash. So that no bucket is hot, bounded tables are broadcast: the
KNOWN most frequent words, and at most HEAVY bigrams and HEAVY trigrams that are frequent in some task, all with exact
counts over the corpus; a trigram between two heavy bigrams goes to the bucket of its own hash. The number of buckets
follows the corpus, and a task holds one bucket at a time.

Defined results: a null or empty text has no words and score 0; a very long text is scored whole; rows that share a doc_id
are summed as one document; rows without doc_id are counted in the corpus and summed under null; columns besides doc_id
and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  in_blocks uses it
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import columns, cut, hash_words, in_blocks, joined_bytes, mix, partitions

#: Bounds of what is broadcast: 16 bytes each.
KNOWN, HEAVY = 524_288, 4096
#: An n-gram with this share of a task's n-grams is a candidate for a heavy table.
SHARE = 1 / 2000
LOCAL = 8_000_000
#: Documents whose sums a task adds up over its buckets before it passes them on.
HELD = 500_000
#: Words of the corpus for each bucket.
BUCKET_WORDS = 2_000_000
_MASK = np.uint64(2**48 - 1)
_NULL = -(2**63)
#: The side of a bigram that lies beyond its text.
_NONE = np.uint32(2**32 - 1)


def _words(batch):
    """Hashes (48 bits) of the words, and the text of each."""
    data, offsets = joined_bytes(batch.column("text"))
    h, at = hash_words(data, offsets)
    return h & _MASK, np.repeat(np.arange(len(at) - 1), np.diff(at)), np.diff(at)


def _pair(v, w):
    return mix(v * np.uint64(0xD6E8FEB86659FD93) + w)


def _blocks(batches):
    """(word hashes, their rows, doc_ids, words per row) of about LOCAL bytes of text at a time."""
    held, size = [], 0
    for batch in in_blocks(batches, 4_000_000):
        h, row, count = _words(batch)
        held.append((h, row, batch.column("doc_id").fill_null(_NULL).to_numpy() if "doc_id" in batch.schema.names else count, count))
        size += batch.column("text").nbytes
        if size >= LOCAL:
            yield _merged(held)
            held, size = [], 0
    if held:
        yield _merged(held)


def _merged(held):
    start = np.cumsum([0, *(len(x[3]) for x in held)])
    return np.concatenate([x[0] for x in held]), np.concatenate([x[1] + s for x, s in zip(held, start, strict=False)]), np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])


def _grams(h, row):
    """Where the second word of each bigram stands, the bigrams' hashes, where the third word of each trigram stands, the trigrams' hashes."""
    two = np.flatnonzero(row[1:] == row[:-1]) + 1
    pairs = _pair(h[two - 1], h[two])
    three = np.flatnonzero(row[2:] == row[:-2]) + 2
    return two, pairs, three, _pair(_pair(h[three - 2], h[three - 1]), h[three])


def _counted(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "h", "n"])


def _tally(batches):
    """Word counts (kind 0), and the counts here of the bigrams (1) and trigrams (2) that are frequent here."""
    for h, row, _, _ in _blocks(batches):
        yield _counted(0, *np.unique(h, return_counts=True))
        _, pairs, _, triples = _grams(h, row)
        for kind, keys in ((1, pairs), (2, triples)):
            keys, n = np.unique(keys, return_counts=True)
            often = n >= max(16, SHARE * len(h))
            yield _counted(kind, keys[often], n[often])


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions in an ascending table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _exact(*candidates: np.ndarray):
    def run(batches):
        for h, row, _, _ in _blocks(batches):
            _, pairs, _, triples = _grams(h, row)
            for kind, (table, keys) in enumerate(zip(candidates, (pairs, triples), strict=True), 1):
                at = _find(table, keys)
                n = np.bincount(at[at >= 0], minlength=len(table))
                yield _counted(kind, table[n > 0], n[n > 0])

    return run


class Model:
    """The broadcast tables (words, bigrams and trigrams by hash, ascending, with their counts) and the two scores."""

    def __init__(self, words, heavy, heavy3, total, least, backoff):
        (self.words, n_words), (self.heavy, self.n_heavy), (self.heavy3, self.n_heavy3) = words, heavy, heavy3
        # By rank, frequent words have small numbers, which pack better than places in the table.
        self.at_rank = np.argsort(-n_words, kind="stable")
        self.rank = np.empty(len(n_words), dtype=np.uint32)
        self.rank[self.at_rank] = np.arange(len(n_words))
        self.log_words, self.log_total, self.least, self.log_backoff = np.log(n_words), np.log(max(1, total)), least, np.log(backoff)

    def _log(self, word):
        return np.where(word >= 0, self.log_words[word], 0.0) if len(self.words) else np.zeros(len(word))

    def after_one(self, count, v, w):
        """Whether the bigram vw is held, and the known part of the score of w after v; a rare word (-1) has its count added later."""
        seen = count >= self.least
        return seen, np.where(seen, np.log(np.maximum(count, 1)) - self._log(v), self.log_backoff + self._log(w) - self.log_total)


def _ids(model: Model, h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """32 bits by which the neighbours of one bigram are told apart: a known word's rank, or bits of a rare word's hash."""
    number = model.rank[known] if len(model.words) else np.zeros(len(known), dtype=np.uint32)
    return np.where(known >= 0, number, (h.astype(np.uint32) & np.uint32(2**30 - 1)) | np.uint32(2**31))


def _packed(bucket: int, payload: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The arrays, the bytes of one significance next to each other, compressed."""
    planes = {k: (x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) for k, x in payload.items()}
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([zstandard.compress(pickle.dumps(planes, 5), 1)], pa.binary())], ["bucket", "payload"])


def _unpacked(packed: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (kind, planes) in pickle.loads(zstandard.decompress(packed)).items():
        size = np.dtype(kind).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()
    return out


def _add_up(rows: np.ndarray, x, n: int) -> np.ndarray:
    """Sums of x (one value, or one for each row) by row number."""
    return np.bincount(rows, np.broadcast_to(x, rows.shape), minlength=n)


def _deal(model: Model, buckets: int):
    """The n-grams of a block, packed for their buckets, and what is known of the documents' sums (bucket -1)."""

    def run(batches):
        for h, row, docs, count in _blocks(batches):
            n, k = len(docs), len(h)
            known = _find(model.words, h)
            same = np.r_[False, row[1:] == row[:-1]] if k else np.zeros(0, dtype=bool)
            second = same & ~np.r_[False, same[:-1]] if k else same  # its bigram has no trigram before it
            value, seen, seen3 = np.zeros(n), np.zeros(n), np.zeros(n)
            asks = []  # (documents, words, times) whose logarithms of counts are still to be added

            def add(at, x, held, held3=0):
                value[:] += _add_up(row[at], x, n)
                seen[:] += _add_up(row[at], held, n)
                seen3[:] += _add_up(row[at], held3, n)

            def score_two(at, counts):
                """Score of the words at these places after the word before them, whose bigrams have these counts."""
                held, x = model.after_one(counts, known[at - 1], known[at])
                for need, where, sign in ((held, at - 1, -1), (~held, at, 1)):
                    rare = where[need & (known[where] < 0)]
                    asks.append((docs[row[rare]], h[rare], np.full(len(rare), sign, dtype=np.int64)))
                return held, x

            first = np.flatnonzero(~same)
            add(first, model._log(known[first]) - model.log_total, 0)
            rare = first[known[first] < 0]
            asks.append((docs[row[rare]], h[rare], np.ones(len(rare), dtype=np.int64)))
            two, pairs, three, triples = _grams(h, row)
            hot = np.full(k, -1)
            hot[two] = _find(model.heavy, pairs)
            between = hot[three] >= 0
            between &= hot[three - 1] >= 0
            hot3 = np.where(between, _find(model.heavy3, triples), -1)
            # Second words of texts and last words of heavy trigrams, after heavy bigrams, are settled here.
            at = np.flatnonzero(second & (hot >= 0))
            held, x = score_two(at, model.n_heavy[hot[at]])
            add(at, x, held)
            at = three[hot3 >= 0]
            add(at, np.log(model.n_heavy3[hot3[hot3 >= 0]]) - np.log(model.n_heavy[hot[at - 1]]), 1, 1)
            # Other trigrams between heavy bigrams go to the bucket of their own hash.
            here = between & (hot3 < 0)
            at, key = three[here], triples[here]
            bucket3 = (key % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((key, bucket3))
            at, key, bucket3 = at[order], key[order], bucket3[order]
            ends3 = np.searchsorted(bucket3, np.arange(buckets + 1))
            # The remaining bigrams go to their buckets with the words on both sides.
            ids = _ids(model, h, known)
            ranks = lambda x: model.rank[x] if len(x) else np.zeros(0, dtype=np.uint32)
            cold = two[hot[two] < 0]
            pair = pairs[hot[two] < 0]
            bucket = (pair % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((row[cold], pair, bucket))
            cold, pair, bucket = cold[order], pair[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            before = np.where(second[cold], _NONE, ids[cold - 2])
            follows = np.r_[same[1:], False] if k else same
            after = np.where(follows[cold], ids[np.minimum(cold + 1, k - 1)], _NONE)
            # A heavy neighbour's count is known here; the two heavy tables settle the trigram from this side alone.
            hot_before = np.where(second[cold], -1, hot[cold - 1])
            hot_after = np.where(follows[cold], hot[np.minimum(cold + 1, k - 1)], -1)
            for b in range(buckets):
                s, t = slice(ends[b], ends[b + 1]), slice(ends3[b], ends3[b + 1])
                if s.start == s.stop and t.start == t.stop:
                    continue
                i, key2 = cold[s], pair[s]
                u = np.flatnonzero(np.r_[True, key2[1:] != key2[:-1]]) if len(i) else np.zeros(0, dtype=np.int64)
                v, w = known[i[u] - 1], known[i[u]]
                lacks = (v < 0) | (w < 0)
                who, local = np.unique(np.r_[row[i], row[at[t]]], return_inverse=True)
                payload = {
                    "docs": docs[who], "doc": local[: len(i)].astype(np.uint32), "runs": np.diff(np.r_[u, len(i)]).astype(np.uint32),
                    "lacks": np.packbits(lacks), "v": ranks(v[~lacks]), "w": ranks(w[~lacks]), "hv": h[i[u][lacks] - 1], "hw": h[i[u][lacks]],
                    "before": before[s], "after": after[s], "hot_before": hot_before[s].astype(np.int16), "hot_after": hot_after[s].astype(np.int16),
                    "doc3": local[len(i) :].astype(np.uint32), "key3": key[t], "left3": hot[at[t] - 1].astype(np.int16), "right3": hot[at[t]].astype(np.int16), "w3": known[at[t] - 1], "hw3": h[at[t] - 1],
                }
                yield _packed(b, payload)
            done = {"docs": docs, "value": value, "seen": seen, "seen3": seen3, "words": count} | dict(zip(("ask_docs", "ask_h", "ask_times"), (np.concatenate(x) for x in zip(*asks, strict=True)), strict=True))
            yield _packed(-1, done)

    return run


_OUT = ["doc_id", "value", "seen", "seen3", "words", "h", "times"]


def _out(doc, value=None, seen=None, seen3=None, words=None, h=None, times=None) -> pa.RecordBatch:
    filled = [pa.nulls(len(doc), t) if x is None else pa.array(x, t) for x, t in ((value, pa.float64()), (seen, pa.int64()), (seen3, pa.int64()), (words, pa.int64()), (h, pa.int64()), (times, pa.int64()))]
    doc = pa.array(doc, mask=np.asarray(doc) == _NULL)
    return pa.RecordBatch.from_arrays([doc, *filled], _OUT)


def _asked(asks):
    """The asks of one bucket, those of one document for one word as one."""
    doc, h, times = (np.concatenate(x) for x in zip(*asks, strict=True))
    order = np.lexsort((h, doc))
    doc, h, times = doc[order], h[order], times[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
    times = np.add.reduceat(times, first) if len(first) else times
    return _out(doc[first], h=h[first].view(np.int64), times=times)


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's combination of the keys, and how many rows have it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new)
    return number, np.bincount(number) if len(number) else np.zeros(0, dtype=np.int64)


def _meet(model: Model):
    """Counts of a bucket's n-grams, joined back to its occurrences and summed per document; asks for rare words go on (h, times)."""

    def solve(held):
        start = np.cumsum([0, *(len(p["docs"]) for p in held)])
        docs = np.concatenate([p["docs"] for p in held])
        get = lambda c: np.concatenate([p[c] for p in held])
        value, seen, seen3, asks = np.zeros(len(docs)), np.zeros(len(docs)), np.zeros(len(docs)), []
        v, w, hv, hw = [], [], [], []
        for p in held:
            n = len(p["runs"])
            lacks = np.unpackbits(p["lacks"], count=n).astype(bool)
            pv, pw, phv, phw = (np.zeros(n, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
            pv[~lacks], pw[~lacks], phv[lacks], phw[lacks] = model.at_rank[p["v"]], model.at_rank[p["w"]], p["hv"], p["hw"]
            if len(model.words):
                phv[~lacks], phw[~lacks] = model.words[pv[~lacks]], model.words[pw[~lacks]]
            pv[lacks], pw[lacks] = _find(model.words, phv[lacks]), _find(model.words, phw[lacks])
            for out, x in zip((v, w, hv, hw), (pv, pw, phv, phw), strict=True):
                out.append(np.repeat(x, p["runs"]))
        v, w, hv, hw = (np.concatenate(x) for x in (v, w, hv, hw))
        doc, before, after = np.concatenate([p["doc"] + s for p, s in zip(held, start, strict=False)]).astype(np.int64), get("before"), get("after")

        def add(at, x, held2, held3=0):
            value[:] += _add_up(at, x, len(docs))
            seen[:] += _add_up(at, held2, len(docs))
            seen3[:] += _add_up(at, held3, len(docs))

        def score_heavy(at, pairs, c, hc):
            """Backed off to a heavy bigram, which is always held, of the word c and the one after it."""
            add(at, model.log_backoff + np.log(model.n_heavy[pairs]) - model._log(c), 1)
            asks.append((docs[at[c < 0]], hc[c < 0], np.full(int((c < 0).sum()), -1, dtype=np.int64)))

        def score_two(counts, v, w, hv, hw, doc):
            held2, x = model.after_one(counts, v, w)
            for need, word, h, sign in ((held2, v, hv, -1), (~held2, w, hw, 1)):
                rare = need & (word < 0)
                asks.append((docs[doc[rare]], h[rare], np.full(int(rare.sum()), sign, dtype=np.int64)))
            return held2, x

        pair, n2 = _group(_pair(hv, hw))
        n2 = n2[pair]
        # From the trigram's end: held ones don't need the score after one word, all others do.
        number, n3 = _group(pair, before)
        ends = (before != _NONE) & (n3[number] >= model.least)
        rows = np.flatnonzero(~ends)
        held2, x = score_two(n2[rows], v[rows], w[rows], hv[rows], hw[rows], doc[rows])
        add(doc[rows], x + np.where(before[rows] != _NONE, model.log_backoff, 0.0), held2)
        # A held trigram whose first bigram is heavy is settled here; else the bucket of its first bigram does it.
        hot = get("hot_before").astype(np.int64)
        rows = np.flatnonzero(ends)
        add(doc[rows], np.where(hot[rows] >= 0, np.log(n3[number[rows]]) - (np.log(model.n_heavy[hot[rows]]) if len(model.heavy) else 0), 0.0), 1, 1)
        # From the trigram's beginning: log c(bcd) - log c(bc), and where cd is heavy, all that its own bucket would add.
        hot = get("hot_after").astype(np.int64)
        number, n3 = _group(pair, after)
        begins = (after != _NONE) & (n3[number] >= model.least)
        rows = np.flatnonzero(begins)
        add(doc[rows], np.log(n3[number[rows]]) - np.log(n2[rows]), hot[rows] >= 0, hot[rows] >= 0)
        rows = np.flatnonzero((after != _NONE) & ~begins & (hot >= 0))
        if len(rows):  # cd is heavy and bcd isn't held
            score_heavy(doc[rows], hot[rows], w[rows], hw[rows])
        # Trigrams between heavy bigrams.
        key3 = get("key3")
        if len(key3):
            doc3 = np.concatenate([p["doc3"] + s for p, s in zip(held, start, strict=False)]).astype(np.int64)
            number, n3 = _group(key3)
            n3, left, right = n3[number], get("left3").astype(np.int64), get("right3").astype(np.int64)
            held3 = n3 >= model.least
            add(doc3[held3], np.log(n3[held3]) - np.log(model.n_heavy[left[held3]]), 1, 1)
            rows = np.flatnonzero(~held3)
            score_heavy(doc3[rows], right[rows], get("w3")[rows], get("hw3")[rows])
        return [docs, value, seen, seen3], asks

    def by_document(sums):
        docs, *values = (np.concatenate(x) for x in zip(*sums, strict=True))
        who, at = np.unique(docs, return_inverse=True)
        return [who, *(np.bincount(at, x, minlength=len(who)) for x in values)]

    def run(batches):
        sums, held, now = [], [], None

        def settle(last):
            """Settle the bucket at hand; what it adds to the documents waits for that of other buckets."""
            nonlocal sums, held
            if held:
                added, asks = solve(held)
                held = []
                yield _asked(asks)
                sums.append(added)
            if sums and (last or sum(len(s[0]) for s in sums) > HELD):
                sums = [by_document(sums)]
            if sums and (last or len(sums[0][0]) > HELD):
                docs, value, seen, seen3 = sums.pop()
                yield _out(docs, value, seen.astype(np.int64), seen3.astype(np.int64))

        for batch in batches:
            for b, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                p = _unpacked(payload.as_py())
                if b == -1:
                    yield _out(p["docs"], p["value"], p["seen"].astype(np.int64), p["seen3"].astype(np.int64), p["words"])
                    yield _asked([(p["ask_docs"], p["ask_h"], p["ask_times"])])
                    continue
                if b != now:
                    yield from settle(False)
                now = b
                held.append(p)
        yield from settle(True)

    return run


def _top(counts: DataFrame, kind: int, most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    table = counts.filter((F.col("kind") == kind) & (F.col("n") >= least)).orderBy(F.desc("n"), "h").limit(most).select("h", "n").toArrow()
    h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(float)


def score(documents: DataFrame, least: int = 2, backoff: float = 0.4, known: int = KNOWN, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_seen (words scored by a held bigram or trigram), n_seen3 (by a held trigram), score (sum of logs) and mean_score (by word)."""
    docs = columns(documents, doc_id="long", text="string")
    n = partitions(documents.sparkSession)
    tally = "kind int, h long, n long"
    counts = cut(docs.select("text").mapInArrow(_tally, tally).groupBy("kind", "h").agg(F.sum("n").alias("n")))
    total = counts.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = _top(counts, 0, min(known, KNOWN))
    heavy2, heavy3 = _top(counts, 1, heavy), _top(counts, 2, heavy)
    if len(heavy2[0]) or len(heavy3[0]):
        exact = cut(docs.select("text").mapInArrow(_exact(heavy2[0], heavy3[0]), tally).groupBy("kind", "h").agg(F.sum("n").alias("n")))
        heavy2, heavy3 = _top(exact, 1, heavy, least), _top(exact, 2, heavy, least)  # so every heavy n-gram is held
    model = Model(words, heavy2, heavy3, total, least, backoff)
    buckets = max(n, -(-total // BUCKET_WORDS))
    dealt = docs.mapInArrow(_deal(model, buckets), "bucket int, payload binary").withColumn("at", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("payload"), F.lit(buckets)).cast("int")))
    met = dealt.repartition(n, "at").sortWithinPartitions("bucket").select("bucket", "payload").mapInArrow(_meet(model), "doc_id long, value double, seen long, seen3 long, words long, h long, times long")
    met = cut(met)
    nothing = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    rare = met.filter("h is not null").select("doc_id", "h", "times").join(counts.filter("kind = 0").select("h", "n"), "h").select("doc_id", (F.col("times") * F.log("n")).alias("value"), *nothing("seen", "seen3", "words"))
    parts = met.filter("h is null").select("doc_id", "value", "seen", "seen3", "words").union(rare)
    sums = parts.groupBy("doc_id").agg(F.sum("words").alias("n_words"), F.sum("seen").alias("n_seen"), F.sum("seen3").alias("n_seen3"), F.sum("value").alias("s"))
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sums.select("doc_id", whole("n_words"), whole("n_seen"), whole("n_seen3"), F.round("s", 6).alias("score"), F.when(F.col("n_words") > 0, F.round(F.col("s") / F.col("n_words"), 6)).otherwise(0.0).alias("mean_score"))
