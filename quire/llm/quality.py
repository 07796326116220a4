"""Operator 10, quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text come from array operations over the bytes of many texts at once; the boosted trees are fitted
with histograms of binned statistics and kept as flat arrays, through which numpy moves all rows a level at a time.

Defined results: a null text is an empty text, and both get the score of all-zero statistics; a very long text is scored
whole, in memory that follows its length; repeated rows give repeated results, and a doc_id with several texts is learnt
from once; texts with equal statistics get equal scores; columns with clashing names are carried along; an empty table
gives no rows; without labels of both classes the score is the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  in_blocks uses it
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.common import columns, hash_words, in_blocks, joined_bytes

#: Byte classes whose shares are statistics.
_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "pipe", "shout", "symbol", "other_ascii", "high"]
_CLASS = np.full(256, _CLASSES.index("other_ascii"), dtype=np.int64)
for _name, _bytes in {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "newline": b"\r\n",
    "stop": b".,;:?'\"()-",
    "pipe": b"|",
    "shout": b"!",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
_CLASS[128:] = _CLASSES.index("high")
STATISTICS = [
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "bytes_per_word", "words_per_line", "distinct_words", "distinct_pairs", "same_as_last", "top_word",
]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group: how many values are distinct, and how often the most frequent one occurs."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    runs = np.diff(np.r_[first, len(g)])
    most = np.zeros(n)
    np.maximum.at(most, g[first], runs)
    return np.bincount(g[first], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = joined_bytes(texts)
    n, k = len(offsets) - 1, len(_CLASSES)
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * k + _CLASS[data], minlength=n * k).reshape(n, k)
    words, at = hash_words(data, offsets)
    n_words = np.diff(at)
    of = np.repeat(np.arange(n), n_words)
    distinct, top = _distinct(of, words, n)
    inside = of[1:] == of[:-1]
    pairs, _ = _distinct(of[1:][inside], (words[1:] * np.uint64(3) + words[:-1])[inside], n)
    same = np.bincount(of[1:][inside & (words[1:] == words[:-1])], minlength=n)
    some = np.maximum(n_words, 1)
    return np.column_stack([
        counts / np.maximum(size, 1)[:, None],
        np.log1p(size), np.log1p(n_words), size / some, n_words / (counts[:, _CLASSES.index("newline")] + 1),
        distinct / some, pairs / np.maximum(n_words - 1, 1), same / some, top / some,
    ])


@dataclass(frozen=True)
class Trees:
    """Perfect binary trees of one depth, each a row of arrays; node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.leaf))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(trees) else 0
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.zeros((len(part), len(trees)), dtype=np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            if len(trees):
                out[a : a + 4096] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boost trees on the logistic loss; every split is found in the histograms of gradients over binned statistics."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    limit = np.full((x.shape[1], bins), np.inf)
    for j, e in enumerate(edges):
        limit[j, : len(e)] = e
    n, m = x.shape
    inner = 2**depth - 1
    features, thresholds, leaves, margin = [], [], [], np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, dtype=int), np.full(inner, np.inf), np.zeros(n, dtype=int)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            local = node - start
            gain_best, choice = np.full(width, 1e-9), [None] * width
            for j in range(m):
                key = local * bins + binned[:, j]
                g, h, c = (np.bincount(key, w, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(c < least) | (ct - c < least) | ~np.isfinite(limit[j])] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for w in np.flatnonzero(top > gain_best):
                    gain_best[w], choice[w] = top[w], (j, limit[j, at[w]])
            for w, c in enumerate(choice):
                if c:
                    feature[start + w], threshold[start + w] = c
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf_of = node - inner
        g, h = np.bincount(leaf_of, grad, minlength=inner + 1), np.bincount(leaf_of, hess, minlength=inner + 1)
        leaf = -rate * g / (h + ridge)
        margin += leaf[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


#: Bytes of text at a time; the arrays over them take some sixty times as much.
_BLOCK = 3_000_000


def _statistics_of(batches):
    for batch in in_blocks(batches, _BLOCK):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def train(documents: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> Trees:
    """Fit on at most `sample` labelled rows that aren't held out: those with the smallest hash of doc_id.

    The bound makes the broadcast of the chosen labels and the collected statistics small whatever the input's size; of
    several texts of one doc_id, that with the least statistics is taken, so repeated rows don't add to what is collected.
    """
    known = columns(labels, doc_id="long", quality="int").filter("quality in (0, 1) and doc_id is not null")
    chosen = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).select("doc_id", F.col("quality").alias("y"))
    texts = columns(documents, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    found = texts.mapInArrow(_statistics_of, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0), **options)
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(-1, len(STATISTICS))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T[::-1]))  # the order of arrival must not change the sums
    return fit(x[order], y[order], **options)


def score(documents: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """Append each text's score, 0 to 1; a higher score means that label 1 is likelier. No shuffle takes place."""
    schema = StructType([*documents.schema.fields, StructField(column, DoubleType())])

    def scored(batches):
        for batch in in_blocks(batches, _BLOCK):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(statistics(batch.column("text"))))], [*batch.schema.names, column])

    return documents.mapInArrow(scored, schema)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is at least `threshold`) of every document."""
    rows = score(columns(documents, doc_id="long", text="string"), train(documents, labels, sample))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """The documents, in their own columns, that the classifier doesn't reject."""
    name = "score"
    while name in documents.columns:
        name = f"_{name}"
    return score(documents, train(documents, labels, sample), name).filter(F.col(name) >= threshold).drop(name)
