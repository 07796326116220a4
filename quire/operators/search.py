"""Literal search: occurrences, excerpts, match ids, navigation, summaries and recall."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.arrays import running_sums
from quire.functions.strings import INK, SPACE
from quire.operators.text import _LINE, explode_lines
from quire.sources.tables import spread, table

#: The search terms of the registered queries, by language.
TERMS = {"en": ["THE", "tion of", "handed", "no-such-text"], "fr": ["les", "ellement"], "de": ["Der", "schlich"], "es": ["que", "ción de"]}
#: Lines that make up a page, the columns at which a line is wrapped on it, and those that the crop box shows.
LINES_PER_PAGE, WRAP, CROP = 40, 83, (4, 79)


def term_table(spark: SparkSession, terms: dict[str, list[str]] = TERMS) -> DataFrame:
    """lang and term, lower-cased; empty terms find nothing and are left out."""
    rows = [{"lang": lang, "term": t.lower()} for lang, found in terms.items() for t in found if t]
    # From Arrow, Spark knows the table's size and can broadcast it; of rows from Python it knows nothing, and the texts would be shuffled by their few languages.
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([("lang", pa.string()), ("term", pa.string())])))


#: SQL: lengths of what lies before each literal, non-overlapping match of term in low: running sums of them are the offsets.
_BEFORE = r"""transform(slice(split(low, concat('\\Q', replace(term, '\\E', '\\E\\\\E\\Q'), '\\E'), -1), 1, cast(n as int)), (p, i) -> length(p) + if(i > 0, length(term), 0))"""
#: SQL: how many such matches there are.
_MATCHES = "(length(low) - length(replace(low, term, ''))) div length(term)"


def occurrences(lines: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """doc_id, line_no, term and at (offset in the lowered line) of every literal, case-insensitive match; matches never cross lines.

    A small term table is broadcast by Spark's own threshold; each line is lowered once, whatever the number of terms.
    """
    hits = lines.withColumn("low", F.lower("line")).join(terms, "lang").filter("contains(low, term)")
    found = hits.selectExpr("doc_id", "line_no", "term", *keep, "low", f"{_MATCHES} n").select("doc_id", "line_no", "term", *keep, running_sums(F.expr(_BEFORE)).alias("found"))
    return found.selectExpr("doc_id", "line_no", "term", *keep, "explode(found) at")


#: SQL: 22 characters on each side with simplified white space; an ellipsis where text was left out.
EXCERPT = r"""concat(if(at > 22, '…', ''), trim(regexp_replace(substring(line, greatest(at - 22, 0) + 1, length(term) + 44), '(?U)\\s+', ' ')), if(greatest(at - 22, 0) + length(term) + 44 < length(line), '…', ''))"""


def match_ids(hits: DataFrame, lines_per_page: int = LINES_PER_PAGE, wrap: int = WRAP, crop: tuple[int, int] = CROP) -> DataFrame:
    """Adds page and id = page << 32 | ordinal. hits need their line.

    Ordinals count the matches of a page from 1, those outside the crop box included, so gaps occur. A line is wrapped at
    `wrap` columns; a match goes only if none of its inked characters lies in the columns that the crop box shows.
    """
    paged = hits.withColumn("page", F.expr(f"cast(line_no div {lines_per_page} as bigint)"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "term", "page").orderBy("line_no", "at"))
    visible = rf"exists(sequence(at, at + length(term) - 1), k -> k % {wrap} >= {crop[0]} and k % {wrap} < {crop[1]} and substring(line, k + 1, 1) rlike '(?U)\\S')"
    return paged.withColumn("id", F.shiftleft("page", 32).bitwiseOR(ordinal.cast("long"))).filter(visible)


def navigation(matches: DataFrame) -> DataFrame:
    """Next and previous match of each match within its document and term; the ends wrap, which is reported."""
    w = Window.partitionBy("doc_id", "term").orderBy("id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return matches.select(
        "doc_id", "term", "id",
        F.coalesce(F.lead("id").over(w), F.first("id").over(whole)).alias("next_id"), F.lead("id").over(w).isNull().alias("next_wraps"),
        F.coalesce(F.lag("id").over(w), F.last("id").over(whole)).alias("previous_id"), F.lag("id").over(w).isNull().alias("previous_wraps"),
    )


def summary(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Per term: documents looked at, documents without text, failed ones (null text), documents with a match, and matches.

    Matches are counted within lines; a failed document is counted and the others go on.
    """
    lowered = documents.selectExpr("lang", "text is null failed", r"not coalesce(text, 'x') rlike '(?U)\\S' textless", "lower(coalesce(text, '')) low")
    counted = lowered.join(terms, "lang").selectExpr("lang", "term", "failed", "textless", f"{_MATCHES} n")
    return counted.groupBy("lang", "term").agg(
        F.count("*").alias("n_docs"), F.count_if("textless").alias("n_textless"), F.count_if("failed").alias("n_failed"),
        F.count_if(F.col("n") > 0).alias("n_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"),
    )


def recall(documents: DataFrame, terms: DataFrame, split: DataFrame, allowed_misses: int = 1) -> DataFrame:
    """Per language, the terms found in at least one document of the evaluation split; PASS with at most the allowed misses."""
    # The terms are looked for first, so that no text is moved to meet the split (Spark would let a semi join go before it).
    hits = documents.selectExpr("doc_id", "lang", "lower(text) low").join(terms, "lang").filter("contains(low, term)").select("doc_id", "lang", "term")
    found = hits.join(split.select("doc_id").distinct(), "doc_id").select("lang", "term").distinct().withColumn("hit", F.lit(1))
    sums = terms.join(found, ["lang", "term"], "left").groupBy("lang").agg(F.count("*").alias("n_terms"), F.count("hit").alias("n_found"))
    return sums.withColumn("status", F.when(F.col("n_found") >= F.col("n_terms") - allowed_misses, "PASS").otherwise("FAIL"))


def position_delta(source: DataFrame, output: DataFrame, terms: DataFrame, pitch: float = 6.6, leading: float = 18.0) -> DataFrame:
    """First hit of each term in the output page against the first in the source page: greatest edge difference in mm, null if not in the source."""
    def first(lines, name):
        w = Window.partitionBy("doc_id", "term").orderBy("line_no", "at")
        hits = occurrences(lines, terms).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
        return hits.selectExpr("doc_id", "term", f"48 + at * {pitch}D {name}_x0", f"48 + (at + length(term)) * {pitch}D {name}_x1", f"769.89D - line_no * {leading}D {name}_y")

    both = first(output, "o").join(first(source, "s"), ["doc_id", "term"], "left")
    return both.selectExpr("doc_id", "term", "round(greatest(abs(o_x0 - s_x0), abs(o_x1 - s_x1), abs(o_y - s_y)) * 25.4 / 72, 6) delta_mm")


#: The corpus has plain spaces only: some documents get wide ones instead, or nothing but these.
_WIDE = "case when doc_id % 7 = 0 then replace(line, ' ', '\u3000') else line end"
_BLANK = "case when doc_id % 17 = 3 then '\u3000\u00a0' when doc_id % 17 = 4 then null else text end"


def _lines(s, d):
    return explode_lines(spread(table(s, d, "documents")), "lang")


def _hits(s, d):
    return occurrences(_lines(s, d), term_table(s), "line")


_T = "terms as (select * from (values " + ", ".join(f"('{lang}', '{t.lower()}')" for lang, ts in TERMS.items() for t in ts) + ") t(lang, term))"


def _hit_sql(line: str = "line", name: str = "hit") -> str:
    return f"""{name}0 as (select doc_id, line_no, term, line, string_split(lower(line), term) p from {line} join terms using (lang) where contains(lower(line), term)),
{name}1 as (select *, unnest(range(1, len(p))) k from {name}0),
{name} as (select doc_id, line_no, term, line, cast(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(term) as integer) at_ from {name}1)"""


_HIT = f"{_LINE}, {_T}, {_hit_sql()}"
_ID = f"""{_HIT}, idd as (select *, (line_no // {LINES_PER_PAGE}) page, row_number() over (partition by doc_id, term, line_no // {LINES_PER_PAGE} order by line_no, at_) o from hit),
ids as (select doc_id, term, line_no, at_, cast(page as bigint) page, cast(page as bigint) * 4294967296 + o as id from idd
  where len(list_filter(range(at_, at_ + length(term)), lambda k: k % {WRAP} between {CROP[0]} and {CROP[1] - 1} and not regexp_matches(substr({_WIDE}, k + 1, 1), '{SPACE}'))) > 0)"""

QUERIES = {
    "search_occurrences": (lambda s, d: _hits(s, d).drop("line"), f"with {_HIT} select doc_id, line_no, term, at_ as at from hit"),
    "search_excerpt": (
        lambda s, d: _hits(s, d).withColumn("line", F.expr(_WIDE)).selectExpr("doc_id", "line_no", "term", "at", f"{EXCERPT} excerpt"),
        rf"""with {_HIT}, wide as (select * replace ({_WIDE} as line) from hit) select doc_id, line_no, term, at_ as at, concat(case when at_ > 22 then '…' else '' end, trim(regexp_replace(substr(line, greatest(at_ - 22, 0) + 1, length(term) + 44), '{SPACE}+', ' ', 'g')), case when greatest(at_ - 22, 0) + length(term) + 44 < length(line) then '…' else '' end) excerpt from wide""",
    ),
    "search_match_id": (lambda s, d: match_ids(_hits(s, d).withColumn("line", F.expr(_WIDE))).select("doc_id", "term", "line_no", "at", "page", "id"), f"with {_ID} select doc_id, term, line_no, at_ as at, page, id from ids"),
    "next_match": (
        lambda s, d: navigation(match_ids(_hits(s, d).withColumn("line", F.expr(_WIDE)))),
        f"""with {_ID} select doc_id, term, id, coalesce(lead(id) over w, first_value(id) over w) next_id, lead(id) over w is null next_wraps,
coalesce(lag(id) over w, last_value(id) over (partition by doc_id, term order by id rows between unbounded preceding and unbounded following)) previous_id, lag(id) over w is null previous_wraps
from ids window w as (partition by doc_id, term order by id)""",
    ),
    "search_summary": (
        lambda s, d: summary(spread(table(s, d, "documents")).withColumn("text", F.expr(_BLANK)), term_table(s)),
        rf"""with {_T}, documents as (select * replace ({_BLANK} as text) from documents) select lang, term, count(*) n_docs, count(*) filter (text is not null and not regexp_matches(text, '{INK}')) n_textless, count(*) filter (text is null) n_failed,
count(*) filter (contains(lower(text), term)) n_found, cast(coalesce(sum(len(string_split(lower(text), term)) - 1), 0) as bigint) n_hits from documents join terms using (lang) group by lang, term""",
    ),
    "term_recall": (
        lambda s, d: recall(table(s, d, "documents"), term_table(s), table(s, d, "labels").filter("quality = 1")),
        f"""with {_T}, f as (select distinct lang, term, 1 hit from documents join terms using (lang) where doc_id in (select doc_id from labels where quality = 1) and contains(lower(text), term))
select lang, count(*) n_terms, count(hit) n_found, case when count(hit) >= count(*) - 1 then 'PASS' else 'FAIL' end status from terms left join f using (lang, term) group by lang""",
    ),
    "match_position_delta": (
        lambda s, d: position_delta(_lines(s, d), _lines(s, d).selectExpr("doc_id", "lang", "line_no", "if(doc_id % 3 = 0, concat('> ', line), if(doc_id % 7 = 1 and line_no = 0, concat('handed ', line), line)) line"), term_table(s)),
        f"""with {_HIT}, line2 as (select doc_id, lang, line_no, case when doc_id % 3 = 0 then concat('> ', line) when doc_id % 7 = 1 and line_no = 0 then concat('handed ', line) else line end line from line), {_hit_sql('line2', 'out')},
f1 as (select * from (select *, row_number() over (partition by doc_id, term order by line_no, at_) rn from hit) where rn = 1),
f2 as (select * from (select *, row_number() over (partition by doc_id, term order by line_no, at_) rn from out) where rn = 1)
select f2.doc_id, f2.term, case when f1.doc_id is not null then round(greatest(abs((48 + f2.at_ * 6.6::double) - (48 + f1.at_ * 6.6::double)), abs((48 + (f2.at_ + length(f2.term)) * 6.6::double) - (48 + (f1.at_ + length(f1.term)) * 6.6::double)), abs((769.89::double - f2.line_no * 18::double) - (769.89::double - f1.line_no * 18::double))) * 25.4 / 72, 6) end delta_mm
from f2 left join f1 using (doc_id, term)""",
    ),
}
