"""Operator 13, encoding and decoding with a SentencePiece vocabulary of the merge type.

A text's characters are its first symbols. An agenda holds the adjacent pairs that make a piece of the vocabulary, ordered
by the piece's score and then from left to right: the best pair is merged, and its new neighbours enter the agenda. What is
no piece in the end is spelled in bytes. A text is first cut where no piece can go across, as the pairs of characters within
the vocabulary's pieces show; a chunk has the same pieces wherever it occurs, so a worker keeps those it has met, up to a
number of characters. New short chunks of an Arrow batch go through their agendas in lock step, long ones through a heap.
Decoding puts the pieces' texts together again.

Each Arrow batch can be held against the sentencepiece library (`check`): a difference raises an error.

Defined results: a null or empty text has the end id alone and decodes to the empty text; U+2581, which stands for the
space, comes back as a space, as from the library; a text of any length is encoded whole; rows that share a doc_id or lack
one are encoded one by one; columns besides doc_id and text (decode: ids) are ignored, whatever their names; an empty table
gives no rows; null ids decode to the empty text. Vocabularies with user-defined or unused pieces, with a character map, or
without bytes are refused.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
import struct
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  in_blocks uses it too
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import columns, in_blocks

SPACE = "▁"
#: Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_SYMBOLS = 1 << 24
#: Chunks of up to 32 characters are merged in lock step, with others of about their length; longer ones (0) by a heap.
_LENGTH = [next(m for m in (6, 9, 12, 20, 32) if n <= m) for n in range(33)] + [0]
#: A worker keeps the parts of texts that it has met until they hold so many characters.
KEPT_CHARS = 4_000_000
#: Bytes of text that are encoded at a time, or numbers of ids decoded.
BLOCK = 1_500_000


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message: an integer, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """What a model file holds, and the encoder and decoder over it."""

    def __init__(self, model: bytes):
        message, texts, scores, kinds = list(_fields(model)), [], [], []
        for part in (dict(_fields(v)) for f, v in message if f == 1):
            texts.append(part.get(1, b"").decode())
            scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
            kinds.append(part.get(3, _NORMAL))
        trainer, normal = (dict(x for f, v in message if f == number for x in _fields(v)) for number in (2, 3))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only vocabularies of the merge type with bytes for unknown characters, without user-defined or unused pieces or a character map")
        self.texts = texts
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.end = trainer.get(42, 2)
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == _NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        #: Pieces by falling score; equal scores have one rank.
        self.ranks = {t: order[scores[i]] for t, i in self.ids.items()}
        byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == _BYTE}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)])
        self._of_char = (len(texts) + np.arange(0x110000)).astype(np.int32)
        for t, i in self.ids.items():
            if len(t) == 1:
                self._of_char[ord(t)] = i
        symbol = lambda t: self.ids.get(t, int(self._of_char[ord(t)]) if len(t) == 1 else None)
        halves = [(a, b, self.ranks[t], i) for t, i in self.ids.items() for k in range(1, len(t)) if (a := symbol(t[:k])) is not None and (b := symbol(t[k:])) is not None]
        table = np.array(halves or [(-2, 0, 0, 0)], dtype=np.int64)
        table = table[np.argsort(table[:, 0] * _SYMBOLS + table[:, 1])]
        self._codes, self._code_ranks, self._code_ids = table[:, 0] * _SYMBOLS + table[:, 1], table[:, 2].copy(), table[:, 3].copy()
        self._chunks = self._cut().findall
        unknown = trainer.get(44, " ⁇ ".encode())
        of = {_NORMAL: lambda t: t.replace(SPACE, " ").encode(), _UNKNOWN: lambda t: unknown, _CONTROL: lambda t: b"", _BYTE: lambda t: bytes([int(t[3:5], 16)])}
        self.surfaces = [of[k](t) for t, k in zip(texts, kinds, strict=True)]
        self.control = np.array(kinds) == _CONTROL
        self.opens = np.array([k == _NORMAL and t.startswith(SPACE) for t, k in zip(texts, kinds, strict=True)])
        self._forget()

    def _cut(self) -> re.Pattern:
        """Chunks across whose borders no piece goes: the character pairs within pieces lead from none outside `opening` into it."""
        pairs = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        inside = {c for p in pairs for c in p}
        later = {c for c in inside if c.isalpha()}
        while more := {b for a, b in pairs if a in later} - later:
            later |= more
        classes = ["".join(re.escape(" " if c == SPACE else c) for c in sorted(x)) or "(?!)" for x in (inside - later, later, inside)]
        opening, rest, known = (c if c == "(?!)" else f"[{c}]" for c in classes)
        return re.compile(f"{opening}*{rest}+|{opening}+|{'.' if known == '(?!)' else '[^' + known[1:]}", re.DOTALL)

    def _forget(self):
        self._kept, self._places = 0, {}
        self._flat, self._start, self._size = array("i"), array("q"), array("q")

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of symbols: the rank of the piece that they make (or one that no piece has) and its id."""
        code = left * _SYMBOLS + right
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._code_ranks[at], len(self.texts)), self._code_ids[at]

    def merge(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk and their number, by a heap whose entries are rank * n + left, so that equal scores go from left to right."""
        symbols, n, rank = list(chunk), len(chunk), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r * n + k for k in range(n - 1) if (r := rank(chunk[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, left = divmod(heapq.heappop(agenda), n)
            right = after[left]
            # A symbol that is gone is empty; an entry stands as long as the pair at its place still has its rank.
            if right == n or not symbols[left] or rank(both := symbols[left] + symbols[right]) != r:
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (r := rank(both + symbols[right])) is not None:
                    heapq.heappush(agenda, r * n + left)
            left = before[left]
            if left >= 0 and (r := rank(symbols[left] + both)) is not None:
                heapq.heappush(agenda, r * n + left)
        return self._spelled(np.array([self.ids.get(s, len(self.texts) + ord(s[0])) for s in symbols if s], dtype=np.int64), np.array([sum(map(bool, symbols))]))

    def _spelled(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With bytes for the characters that are no pieces; sizes: of the chunks."""
        odd = symbols >= len(self.texts)
        if not odd.any():
            return symbols, sizes
        chars = symbols[odd] - len(self.texts)
        width = np.ones(len(symbols), dtype=np.int64)
        width[odd] += (chars >= 0x80).astype(int) + (chars >= 0x800) + (chars >= 0x10000)
        out = np.repeat(symbols, width)
        out[np.repeat(odd, width)] = self.byte_ids[np.frombuffer("".join(map(chr, chars.tolist())).encode(), dtype=np.uint8)]
        return out, np.diff(np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])])

    def merge_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short chunks end to end and the number of each, in lock step: each round takes the best entry of every chunk's agenda, an array of ranks."""
        n, size = len(self.texts), np.array(list(map(len, chunks)))
        most = int(size.max())
        symbols = np.full((len(chunks), most), -1, dtype=np.int64)
        place = np.arange(most)
        symbols[place < size[:, None]] = self._of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)]
        agenda, _ = self._agenda(symbols[:, :-1], symbols[:, 1:])
        active = np.arange(len(chunks))
        while most > 1 and len(active):
            best = agenda[active].argmin(axis=1)
            go = agenda[active, best] < n
            active, best = active[go], best[go, None]
            if not len(active):
                break
            old = symbols[active]
            k = np.arange(len(active))
            merged = self._agenda(old[k, best[:, 0]], old[k, best[:, 0] + 1])[1]
            fresh = np.where(place <= best, old, np.column_stack([old[:, 1:], np.full(len(active), -1)]))
            fresh[k, best[:, 0]] = merged
            symbols[active] = fresh
            ranks = agenda[active]
            ranks = np.where(place[:-1] < best, ranks, np.column_stack([ranks[:, 1:], np.full(len(active), n)]))
            for beside in (best[:, 0] - 1, best[:, 0]):
                inside = (beside >= 0) & (beside < most - 1)
                ranks[k[inside], beside[inside]] = self._agenda(fresh[k[inside], beside[inside]], fresh[k[inside], beside[inside] + 1])[0]
            agenda[active] = ranks
        return self._spelled(symbols[symbols >= 0], (symbols >= 0).sum(axis=1))

    def _learn(self, chunks: set[str]):
        """Encode chunks that the worker hasn't met."""
        by_size = {}
        for c in chunks:
            by_size.setdefault(_LENGTH[min(len(c), len(_LENGTH) - 1)], []).append(c)
        for most, group in by_size.items():
            spaced = [c.replace(" ", SPACE) for c in group]
            for part, (ids, sizes) in [(group, self.merge_all(spaced))] if most else (([c], self.merge(x)) for c, x in zip(group, spaced, strict=True)):
                self._places.update(zip(part, range(len(self._start), len(self._start) + len(part)), strict=True))
                self._start.frombytes((len(self._flat) + np.cumsum(sizes) - sizes).tobytes())
                self._size.frombytes(sizes.astype(np.int64).tobytes())
                self._flat.frombytes(ids.astype(np.int32).tobytes())
        self._kept += sum(map(len, chunks))

    def normal(self, text: str) -> str:
        text = text.replace(SPACE, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return f" {text}" if self.prefix and text else text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each text, and the n + 1 offsets of the texts."""
        if self._kept > KEPT_CHARS:
            self._forget()
        found = [self._chunks(self.normal(t)) for t in texts]
        counts, chunks = list(map(len, found)), list(chain.from_iterable(found))
        if missing := set(chunks).difference(self._places):
            self._learn(missing)
        place = np.fromiter(map(self._places.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        size, start, flat = np.array(self._size), np.array(self._start), np.array(self._flat)
        sizes = size[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(start[place] - ends[:-1], sizes) + np.arange(ends[-1])]
        lasts = ends[np.cumsum(counts)]
        return np.insert(ids, lasts, np.int32(self.end)), np.concatenate([[0], lasts + np.arange(1, len(texts) + 1)])

    def decode(self, ids: np.ndarray) -> str:
        hidden = self.control[ids]
        if hidden[:-1].any():  # bytes on both sides of a control piece are no character
            runs = np.split(ids, np.flatnonzero(hidden))
        else:
            runs = [ids]
        text = "".join(b"".join(map(self.surfaces.__getitem__, r.tolist())).decode(errors="quire-each-byte") for r in runs)
        shown = ids[~hidden][:1]
        return text[1:] if (self.prefix or self.squeeze) and self.opens[shown].any() else text


codecs.register_error("quire-each-byte", lambda e: ("�", e.start + 1))


@functools.lru_cache(maxsize=2)
def _vocabulary(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as f:
        return Vocabulary(f.read())


@functools.lru_cache(maxsize=2)
def _library(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))


def _added(spark, model: str) -> str:
    """The model's file name, under which each executor finds it."""
    name = model.rsplit("/", 1)[-1]
    if name not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(model)
    return name


def encode(documents: DataFrame, model: str, check: bool = False) -> DataFrame:
    """doc_id and ids of each row. model: the path of a model file, which is sent to the executors."""
    name = _added(documents.sparkSession, model)

    def run(batches):
        vocabulary = _vocabulary(name)
        for batch in in_blocks(batches, BLOCK):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, offsets = vocabulary.encode(texts)
            if check:
                for k, want in enumerate(_library(name).encode(texts, num_threads=1, add_eos=True)):
                    if not np.array_equal(ids[offsets[k] : offsets[k + 1]], want):
                        raise ValueError(f"the sentencepiece library encodes the text of document {batch.column('doc_id')[k]} otherwise")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets.astype(np.int32), ids)], ["doc_id", "ids"])

    return columns(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def _slices(batches):
    """Arrow batches cut into pieces of about BLOCK ids."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0).to_numpy().astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1), len(sizes)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def decode(tokens: DataFrame, model: str, check: bool = False) -> DataFrame:
    """doc_id, ids and the decoded text of each row."""
    name = _added(tokens.sparkSession, model)

    def run(batches):
        vocabulary = _vocabulary(name)
        for batch in _slices(batches):
            column = batch.column("ids")
            ids, sizes = column.flatten().to_numpy(), pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
            rows = [ids[e - n : e] for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
            texts = list(map(vocabulary.decode, rows))
            if check:
                for k, want in enumerate(_library(name).decode([r.tolist() for r in rows], num_threads=1)):
                    if texts[k] != want:
                        raise ValueError(f"the sentencepiece library decodes the ids of document {batch.column('doc_id')[k]} otherwise")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return columns(tokens, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Of decode's rows: doc_id, n_tokens and the SHA-256 of the ids, joined by spaces, and of the text."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
