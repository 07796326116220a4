"""Lines, pages, words and text quality."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import in_blocks, running_sums
from quire.functions.sequences import diff, edit_distances
from quire.functions.strings import SPACE, WHITE, norm_text
from quire.functions.words import WORD, WORD_DUCK
from quire.sources.tables import spread, table


def explode_lines(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per line, in reading order, with a number from 0."""
    return documents.selectExpr("doc_id", *keep, r"posexplode(split(text, '\n')) as (line_no, line)")


def page_text(conversations: DataFrame) -> DataFrame:
    """The pages of a document in reading order, as one text; failed pages (null) are left out."""
    return conversations.groupBy("conv_id").agg(F.expr(r"listagg(text, '\n') within group (order by turn)").alias("text"))


def error_rate(pairs: DataFrame, group: str, reference: str = "line", output: str = "got", limits: dict[str, float] | None = None) -> DataFrame:
    """Edit distance over reference length by group, over all lines; null where the group has no reference."""
    rows = pairs.filter(f"{reference} is not null and {output} is not null").select(group, F.length(reference).alias("n"), edit_distances(reference, output).alias("d"))
    sums = rows.groupBy(group).agg(F.sum("d").alias("edits"), F.sum("n").alias("n_ref"))
    out = sums.withColumn("rate", F.expr("try_divide(edits, n_ref)"))
    if limits:
        most = F.coalesce(*(F.when(F.col(group) == k, F.lit(v)) for k, v in limits.items()), F.lit(0.02))
        out = out.withColumn("status", F.when(F.col("rate") <= most, "PASS").otherwise("FAIL"))
    return out


def word_diff(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """Words that occur more often on one side, with the signed difference (output less reference); order isn't kept.

    Equal lines and equal words at the same place of a line cancel, so only the other words are exploded and shuffled.
    """
    changed = pairs.filter(f"{reference} <> {output}")
    places = changed.selectExpr(key, f"explode(filter(zip_with(split({reference}, '{WHITE}+'), split({output}, '{WHITE}+'), (a, b) -> struct(a, b)), p -> not p.a <=> p.b)) p")
    sides = places.selectExpr(key, "stack(2, p.a, -1, p.b, 1) as (word, n)")
    return sides.filter("word <> ''").groupBy(key, "word").agg(F.sum("n").alias("diff")).filter("diff <> 0")


#: What Python's split takes for white space and Unicode doesn't.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _split(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in _BLANKS.split(text) if w] if _SEPARATORS.search(text) else text.split()


#: Runs that a batch of edit scripts holds before it is sent on, and characters of texts that Python takes at once.
_RUNS, _CHARACTERS = 20_000, 1_000_000


def _scripts(batches):
    out = [[] for _ in range(8)]

    def batch_of(key_type):
        schema = pa.schema([pa.field("key", key_type), ("run", pa.int32()), ("kind", pa.string()), *((c, pa.int32()) for c in ("from_ref", "to_ref", "from_out", "to_out")), ("words", pa.string())])
        done = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)
        for c in out:
            c.clear()
        return done

    for batch in batches:
        kind = batch.column(0).type
        for piece in in_blocks([batch], _CHARACTERS, "a"):
            for k, a, b in zip(*(piece.column(c).to_pylist() for c in range(3)), strict=True):
                x, y = _split(a), _split(b)
                for n, (what, p, q, r, s) in enumerate(diff(x, y)):
                    for c, v in zip(out, (k, n, what, p, q, r, s, None if what == "equal" else " ".join(x[p:q] if what == "deleted" else y[r:s])), strict=True):
                        c.append(v)
                if len(out[0]) > _RUNS:
                    yield batch_of(kind)
        if out[0]:
            yield batch_of(kind)


def word_script(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """A shortest edit script of each page's words, as runs in order.

    key, run (from 0), kind (equal, deleted or inserted), the word places from and to (exclusive) on either side, and the
    words deleted or inserted. Words are what white space parts; null counts as a page without words. Between two equal runs
    the deleted words come first. Equal texts don't go to Python.
    """
    kind = pairs.select(key).schema[0].dataType.simpleString()
    texts = pairs.select(F.col(key).alias("key"), F.expr(f"coalesce({reference}, '')").alias("a"), F.expr(f"coalesce({output}, '')").alias("b"))
    changed = texts.filter("a <> b").mapInArrow(_scripts, f"key {kind}, run int, kind string, from_ref int, to_ref int, from_out int, to_out int, words string")
    same = texts.filter("a = b").selectExpr("key", f"size(filter(split(a, '{WHITE}+'), w -> w <> '')) n").filter("n > 0")
    whole = same.selectExpr("key", "0 run", "'equal' kind", "0 from_ref", "n to_ref", "0 from_out", "n to_out", "cast(null as string) words")
    return changed.unionByName(whole).withColumnRenamed("key", key)


def grapheme_starts(documents: DataFrame, *key: str) -> DataFrame:
    """The offsets at which grapheme clusters start."""
    key = key or ("doc_id",)
    sizes = r"transform(regexp_extract_all(text, '(\\X)', 1), g -> length(g))"
    before = documents.selectExpr(*key, f"{sizes} n").selectExpr(*key, "if(size(n) > 0, concat(array(0), slice(n, 1, size(n) - 1)), n) n")
    return before.select(*key, running_sums("n").alias("starts"))


def word_bounds(documents: DataFrame, *key: str) -> DataFrame:
    """key and spans: start and end of each word by the rules of quire.functions.words."""
    pieces = documents.selectExpr(*key, f"regexp_extract_all(text, '({WORD})', 1) words", f"split(text, '{WORD}', -1) gaps")
    # Both arrays are arguments here: within a lambda, Spark would evaluate what makes them once for each element.
    ends = pieces.select(*key, running_sums(F.expr("flatten(zip_with(slice(gaps, 1, size(words)), words, (g, w) -> array(length(g), length(w))))")).alias("at"))
    return ends.selectExpr(*key, "if(size(at) > 0, transform(sequence(1, size(at) div 2), k -> struct(at[2 * k - 2] b, at[2 * k - 1] e)), array()) spans")


def word_spans(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each of the word_bounds."""
    return word_bounds(documents, key).selectExpr(key, "posexplode(spans) as (word_no, span)").selectExpr(key, "word_no", "span.b start", "span.e end")


def align_pairs(truth: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """Reference and output of the same page side by side, and whether they agree."""
    return truth.join(output.withColumnRenamed("text", "got"), keys).withColumn("same", F.col("text").eqNullSafe(F.col("got")))


def roundtrip_compare(before: DataFrame, after: DataFrame, key: str, page: str) -> DataFrame:
    """Per document: pages before and after, pages whose text differs (null-safe), and the verdict."""
    b, a = before.select(key, page, F.col("text").alias("b"), F.lit(1).alias("in_b")), after.select(key, page, F.col("text").alias("a"), F.lit(1).alias("in_a"))
    both = b.join(a, [key, page], "full_outer")
    sums = both.groupBy(key).agg(
        F.count("in_b").alias("n_before"), F.count("in_a").alias("n_after"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed")
    )
    return sums.withColumn("status", F.when((F.col("n_before") == F.col("n_after")) & (F.col("n_changed") == 0), "PASS").otherwise("FAIL"))


#: The stand-in for a recognised text: the reference with two letters swapped.
MUTATED = "replace(line, ' the ', ' teh ')"


def _pairs(s, d):
    return explode_lines(spread(table(s, d, "documents"))).selectExpr("*", f"{MUTATED} got")


def _texts(s, d):
    return spread(table(s, d, "documents")).selectExpr("doc_id", "text", f"{MUTATED.replace('line', 'text')} got")


#: The corpus has letters and plain marks only: some texts get numbers, apostrophes and other scripts.
_MIXED = "case conv_id % 11 when 3 then replace(text, 'e ', '\u2019s 3.5,6 _x1 漢字 カナー ') when 4 then replace(text, 'a', '.a:') else text end"
_LINES = "lines as (select doc_id, lang, unnest(range(len(parts))) line_no, parts from (select doc_id, lang, string_split(text, chr(10)) parts from documents))"
_LINE = f"{_LINES}, line as (select doc_id, lang, cast(line_no as integer) line_no, parts[line_no + 1] line from lines)"
_AFTER = "if(conv_id % 5 = 0 and turn = 1, concat(text, '.'), text) text"
_WORDS = "list_filter(regexp_split_to_array({}, '" + SPACE.replace("{", "{{").replace("}", "}}") + "+'), lambda w: w <> '')"

QUERIES = {
    "explode_lines": (lambda s, d: explode_lines(table(s, d, "documents")), f"with {_LINE} select doc_id, line_no, line from line"),
    "page_text": (lambda s, d: page_text(table(s, d, "conversations")), "select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id"),
    "norm_text": (
        lambda s, d: table(s, d, "documents").select("doc_id", norm_text(F.col("text")).alias("t")).selectExpr("doc_id", "length(t) n_norm", "md5(t) norm_md5"),
        f"select doc_id, cast(length(t) as integer) n_norm, md5(t) norm_md5 from (select doc_id, trim(regexp_replace(nfc_normalize(text), '{SPACE}+', ' ', 'g')) t from documents)",
    ),
    "edit_distance": (
        lambda s, d: _pairs(s, d).filter("line <> got").select("doc_id", "line_no", edit_distances("line", "got").alias("distance")),
        f"with {_LINE} select doc_id, line_no, levenshtein(line, {MUTATED}) distance from line where line <> {MUTATED}",
    ),
    "cer_by_group": (
        lambda s, d: error_rate(explode_lines(spread(table(s, d, "documents")).join(table(s, d, "labels").filter("quality = 1").select("doc_id").distinct(), "doc_id"), "lang").selectExpr("*", f"{MUTATED} got"), "lang", limits={"en": 0.01}),
        f"with {_LINE}, e as (select lang, sum(levenshtein(line, {MUTATED})) edits, sum(length(line)) n_ref from line where doc_id in (select doc_id from labels where quality = 1) group by lang) select lang, cast(edits as bigint) edits, cast(n_ref as bigint) n_ref, edits / n_ref rate, case when edits / n_ref <= case when lang = 'en' then 0.01 else 0.02 end then 'PASS' else 'FAIL' end status from e",
    ),
    "word_diff": (
        lambda s, d: word_diff(_pairs(s, d), "doc_id", "line", "got"),
        rf"with {_LINE}, w as (select doc_id, unnest({_WORDS.format('line')}) word, -1 n from line union all select doc_id, unnest({_WORDS.format(MUTATED)}), 1 from line) select doc_id, word, cast(sum(n) as bigint) as diff from w group by all having sum(n) <> 0",
    ),
    "word_script": (lambda s, d: word_script(_texts(s, d), "doc_id", "text", "got"), None),
    # No stand-in word occurs in the reference, so as many words are equal as stand in their old places.
    "word_script_counts": (
        lambda s, d: word_script(_texts(s, d), "doc_id", "text", "got").groupBy("doc_id").agg(*(F.expr(f"coalesce(sum(if(kind = '{k}', {n}, 0)), 0L) n_{k}") for k, n in (("equal", "to_ref - from_ref"), ("deleted", "to_ref - from_ref"), ("inserted", "to_out - from_out")))),
        f"with w as (select doc_id, {_WORDS.format('text')} a, {_WORDS.format(MUTATED.replace('line', 'text'))} b from documents), c as (select doc_id, cast(len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i])) as bigint) e, len(a) n from w where len(a) > 0) select doc_id, e n_equal, n - e n_deleted, n - e n_inserted from c",
    ),
    "grapheme_starts": (
        lambda s, d: grapheme_starts(table(s, d, "conversations").selectExpr("conv_id * 1000 + turn doc_id", "text")).selectExpr("doc_id", "size(starts) n_graphemes", "starts[size(starts) - 1] last_start", "md5(array_join(starts, ',')) starts_md5"),
        "select conv_id * 1000 + turn doc_id, cast(length_grapheme(text) as integer) n_graphemes, cast(length(text) - 1 as integer) last_start, md5(array_to_string(range(length(text)), ',')) starts_md5 from conversations",
    ),
    "word_spans": (
        lambda s, d: word_spans(spread(table(s, d, "conversations")).selectExpr("conv_id * 1000 + turn doc_id", f"{_MIXED} text")),
        f"""with w as (select conv_id * 1000 + turn doc_id, regexp_extract_all(text, '{WORD_DUCK}') words, regexp_split_to_array(text, '{WORD_DUCK}') gaps from (select conv_id, turn, {_MIXED} text from conversations)),
e as (select doc_id, unnest(range(len(words))) k, words, gaps from w),
f as (select doc_id, k, coalesce(list_sum(list_transform(words[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1:k + 1], lambda x: length(x))), 0) a, length(words[k + 1]) n from e)
select doc_id, cast(k as integer) word_no, cast(a as integer) as start, cast(a + n as integer) as "end" from f""",
    ),
    "align_pairs": (
        lambda s, d: align_pairs(table(s, d, "conversations").select("conv_id", "turn", "text"), table(s, d, "conversations").selectExpr("conv_id", "turn", _AFTER), ["conv_id", "turn"]).select("conv_id", "turn", "same"),
        "select conv_id, turn, not (conv_id % 5 = 0 and turn = 1) same from conversations",
    ),
    "roundtrip_compare": (
        lambda s, d: roundtrip_compare(table(s, d, "conversations"), table(s, d, "conversations").filter("not (conv_id % 7 = 0 and turn = 0)").selectExpr("conv_id", "turn", _AFTER), "conv_id", "turn"),
        "select conv_id, count(*) n_before, count(*) filter (not (conv_id % 7 = 0 and turn = 0)) n_after, count(*) filter (conv_id % 5 = 0 and turn = 1) n_changed, case when count(*) filter ((conv_id % 7 = 0 and turn = 0) or (conv_id % 5 = 0 and turn = 1)) = 0 then 'PASS' else 'FAIL' end status from conversations group by conv_id",
    ),
}
