"""Choosing and classifying pages, restrictions, stamps, and copying ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.strings import INK, split_columns
from quire.sources.tables import table


def select_pages(specs: DataFrame) -> DataFrame:
    """key, spec, n_pages -> key, position, page (0-based, in the order of the spec), error.

    An invalid spec gives one row with an error and no page: blank, or what is wrong with its first faulty part: syntax,
    range (outside 1..n_pages, or its end before its start; numbers beyond an integer count as 0), or duplicate (a page that
    the part shares with an earlier one).
    """
    pattern = r"^\\s*([0-9]+)(?:\\s*-\\s*([0-9]+))?\\s*$"
    number = lambda k: f"coalesce(try_cast(regexp_extract(p, '{pattern}', {k}) as int), 0)"
    part = f"transform(split(coalesce(spec, ''), ',', -1), p -> struct(p rlike '{pattern}' ok, {number(1)} a, if(regexp_extract(p, '{pattern}', 2) = '', {number(1)}, {number(2)}) b))"
    parts = specs.selectExpr("key", "n_pages", r"coalesce(spec, '') rlike '(?U)\\S' inked", f"{part} parts")
    fault = "case when not p.ok then 'syntax' when p.a < 1 or p.b < p.a or p.b > n_pages then 'range' when exists(slice(parts, 1, i), q -> q.a <= p.b and p.a <= q.b) then 'duplicate' end"
    judged = parts.selectExpr("key", "parts", f"if(inked, get(filter(transform(parts, (p, i) -> {fault}), x -> x is not null), 0), 'blank') error")
    pages = "flatten(transform(parts, p -> transform(sequence(p.a, p.b), x -> cast(x - 1 as bigint))))"
    return judged.selectExpr("key", "error", f"posexplode_outer(if(error is null, {pages}, null)) as (position, page)").select("key", "position", "page", "error")


def textless_pages(pages: DataFrame, key: str) -> DataFrame:
    """Per document: pages, and pages without any character that isn't white space (failed pages are not textless)."""
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.count_if(~F.col("text").rlike(r"(?U)\S")).alias("n_textless"))


def restriction_class(objects: DataFrame, key: str, order: str, default: str = "none") -> DataFrame:
    """objects: key, order, the document's flag encrypted, and the object's flags signature, byte_range, xfa, field, actions.

    The last object that says signed or dynamic form decides, the latter where it says both; without one, encryption counts.
    """
    reason = F.expr("case when xfa or (field and actions) then 'dynamic form' when signature or byte_range then 'signed' end")
    last = F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col(order)))
    return objects.withColumn("reason", reason).groupBy(key).agg(F.coalesce(last, F.when(F.bool_or("encrypted"), "encrypted"), F.lit(default)).alias("restriction"))


#: SQL over has_hidden_text, has_images, has_visible_text and recognised (the recognised text).
PAGE_STATUS = r"case when has_hidden_text then 'kept' when not has_images then if(has_visible_text, 'not needed', 'no text') when coalesce(recognised, '') rlike '(?U)\\S' then 'processed' else 'no text' end"


def stamp_violations(stamps: DataFrame) -> DataFrame:
    """Adds the rules that a stamp (text, size, x0..y1 in a page of w by h) breaks."""
    rules = {
        "empty": r"not coalesce(text, '') rlike '(?U)\\S'",
        "long": "length(text) > 2000",
        "size": "size is null or size < 6 or size > 144",
        "outside": "not (x0 >= 0 and y0 >= 0 and x1 <= w and y1 <= h and x0 < x1 and y0 < y1)",
    }
    return stamps.withColumn("violations", F.expr(f"array_compact(array({', '.join(f'''if({c}, '{n}', null)''' for n, c in rules.items())}))"))


def uncovered_characters(texts: DataFrame, key: str, covered: DataFrame) -> DataFrame:
    """key and U+XXXX of each character outside the coverage table (code), but for line ends; a small coverage table is broadcast by Spark's own threshold."""
    chars = texts.selectExpr(key, "explode(array_distinct(split(text, ''))) ch").filter(r"ch not in ('', '\r', '\n')").selectExpr(key, "ascii(ch) code")
    return chars.join(covered, "code", "left_anti").selectExpr(key, "concat('U+', lpad(hex(code), 4, '0')) character").distinct()


def extract_stamps(annotations: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Stamps among annotations: JSON of version 1 with a rectangle of four numbers; anything else is not a stamp. A missing size is 0."""
    parsed = annotations.withColumn("s", F.from_json(payload, "version int, rect array<double>, text string, size double, color string"))
    return parsed.filter("s.version = 1 and size(s.rect) = 4 and forall(s.rect, x -> x is not null)").selectExpr(key, "s.rect[0] x0", "s.rect[1] y0", "s.rect[2] x1", "s.rect[3] y1", "s.text text", "coalesce(s.size, 0D) size", "s.color color")


def copy_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages: key, page, text. ranges: key, p1, o1, p2, o2 (ends in either order), allowed -> key, copied, status.

    Pieces of the pages are joined by a blank line and empty ones are dropped; a missing or failed page in the range
    leaves nothing to copy, and so does a document that doesn't allow it.
    """
    ends = ranges.selectExpr("key", "allowed", "least(struct(p1 p, o1 o), struct(p2 p, o2 o)) a", "greatest(struct(p1 p, o1 o), struct(p2 p, o2 o)) b")
    inside = ends.join(pages, "key", "left").selectExpr("key", "allowed", "a", "b", "if(page between a.p and b.p, page, null) page", "text")
    piece = "substring(text, if(page = a.p, a.o, 0) + 1, if(page = b.p, b.o, length(text)) - if(page = a.p, a.o, 0))"
    rows = inside.selectExpr("key", "allowed", "a", "b", "page", f"if(page is not null, {piece}, null) piece")
    sums = rows.groupBy("key", "allowed", "a", "b").agg(F.expr(r"listagg(nullif(piece, ''), '\n\n') within group (order by page)").alias("joined"), F.count("piece").alias("n"))
    whole = sums.selectExpr("key", "case when not allowed then 'denied' when n < b.p - a.p + 1 then 'failed' else 'copied' end status", "joined")
    return whole.selectExpr("key", "status", "if(status = 'copied', coalesce(joined, ''), null) copied")


def progress(selected: DataFrame, key: str, order: str) -> DataFrame:
    """Running count of finished pages over the selected ones, with the constant total."""
    w = Window.partitionBy(key)
    return selected.withColumn("done", F.row_number().over(w.orderBy(order))).withColumn("total", F.count("*").over(w))


def status_counts(statuses: DataFrame, key: str) -> DataFrame:
    """Pages per outcome and whether anything was processed."""
    w = Window.partitionBy(key)
    counts = statuses.groupBy(key, "status").agg(F.count("*").alias("n"))
    return counts.withColumn("changed", F.max(F.when(F.col("status") == "processed", True).otherwise(False)).over(w))


#: A spec of each kind, by conv_id % 20; {n} is the number of pages.
_SPECS = ["'1-2, 1'", "'2,1'", "''", "'3-1'", "'x'", "concat('1-', {n})", "concat({n}, ',1')", "'1,99'", "'99,x'", "'x,99'", "'1,1,99'", "'1,1,x'", "concat('1', chr(9), '-', chr(9), '2')", "'0000000001'", "'99999999999'", "'1,'", "'\u3000 '", "'\u30001'", "' 2 , 1 '", "'2,1-2'"]
_SPEC = "case conv_id % 20 " + " ".join(f"when {k} then {x}" for k, x in enumerate(_SPECS)) + " end"
_FLAGS = "doc_id % 11 = 0 has_hidden_text, doc_id % 3 = 0 has_images, n_chars > 600 has_visible_text, case when doc_id % 6 = 0 then text when doc_id % 6 = 3 then '\u3000\u00a0' else '  ' end recognised"
#: A part of a spec, as DuckDB matches it.
_PART = r"[\t-\r ]*([0-9]+)(?:[\t-\r ]*-[\t-\r ]*([0-9]+))?[\t-\r ]*"
_STATUS_SQL = rf"case when has_hidden_text then 'kept' when not has_images then case when has_visible_text then 'not needed' else 'no text' end when regexp_matches(coalesce(recognised, ''), '{INK}') then 'processed' else 'no text' end"
_BLANKED = "case when doc_id % 13 = 0 then ' ' when doc_id % 13 = 1 then '\u3000\u00a0\u0085' else text end"
_STAMP = "conv_id, turn, case when turn % 4 = 3 then concat(' ', chr(10), chr(9)) when turn % 5 = 2 and conv_id % 2 = 0 then concat(repeat('x', 1999), '  ') when turn % 5 = 2 then repeat(text, 12) else text end text, 4 + (conv_id * 7 + turn * 13) % 150 size, cast((conv_id * 37 + turn * 11) % 600 - 20 as double) x0, cast((conv_id * 17) % 700 as double) y0"
_PAYLOAD = "concat('{\"version\":', {k} % 3, ',\"rect\":[', {k}, ',', {k} + 1, ',', {k} + 20, case when {k} % 5 = 0 then '' else concat(',', {k} + 30) end, '],\"text\":\"', event_type, '\"}')"
_OBJECTS = "user_id, event_id, user_id % 3 = 0 encrypted, event_type = 'purchase' signature, value > 190 byte_range, value < 1 or value > 195 xfa, event_type = 'click' field, value < 20 actions"
_RANGE = "conv_id, case when conv_id % 2 = 0 then 1 else 3 end p1, case when conv_id % 2 = 0 then 5 else 12 end o1, case when conv_id % 2 = 0 then 3 else 1 end p2, case when conv_id % 2 = 0 then 12 else 5 end o2, conv_id % 7 <> 0 allowed"


def _sized(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_pages")).selectExpr("conv_id key", "n_pages", f"{_SPEC.format(n='n_pages')} spec")


def _statuses(s, d):
    return table(s, d, "documents").selectExpr("doc_id", "source", *split_columns(_FLAGS)).selectExpr("doc_id", "source", f"{PAGE_STATUS} status")


QUERIES = {
    "select_pages": (
        lambda s, d: select_pages(_sized(s, d)),
        rf"""with c as (select conv_id key, count(*) n from conversations group by 1), sp as (select key, n, {_SPEC.format(n='n').replace('conv_id', 'key')} spec from c),
p as (select key, n, i, string_split(spec, ',')[i] part from (select *, unnest(range(1, len(string_split(spec, ',')) + 1)) i from sp where regexp_matches(spec, '{INK}'))),
q as (select key, n, i, regexp_full_match(part, '{_PART}') ok, coalesce(try_cast(regexp_extract(part, '{_PART}', 1) as integer), 0) a, coalesce(try_cast(case when regexp_extract(part, '{_PART}', 2) = '' then regexp_extract(part, '{_PART}', 1) else regexp_extract(part, '{_PART}', 2) end as integer), 0) b from p),
x as (select q.key, q.i, case when not ok then 'syntax' when a < 1 or b < a or b > n then 'range' when exists (select 1 from q e where e.key = q.key and e.i < q.i and e.a <= q.b and q.a <= e.b) then 'duplicate' end fault from q),
f as (select key, arg_min(fault, i) error from x where fault is not null group by key),
g as (select key, i, unnest(range(a, b + 1)) - 1 page from q where key not in (select key from f))
select key, cast(row_number() over (partition by key order by i, page) - 1 as integer) "position", page, null error from g union all select key, null, null, error from f
union all select key, null, null, 'blank' from sp where not regexp_matches(spec, '{INK}')""",
    ),
    "textless_pages": (
        lambda s, d: textless_pages(table(s, d, "documents").selectExpr("source", f"{_BLANKED} text"), "source"),
        f"select source, count(*) n_pages, count(*) filter (not regexp_matches({_BLANKED}, '{INK}')) n_textless from documents group by source",
    ),
    "restriction_class": (
        lambda s, d: restriction_class(table(s, d, "events").selectExpr(*split_columns(_OBJECTS)), "user_id", "event_id"),
        f"""with o as (select {_OBJECTS} from events), r as (select user_id, event_id, encrypted, case when xfa or (field and actions) then 'dynamic form' when signature or byte_range then 'signed' end reason from o)
select user_id, coalesce(arg_max(reason, event_id) filter (reason is not null), case when bool_or(encrypted) then 'encrypted' end, 'none') restriction from r group by user_id""",
    ),
    "page_status": (lambda s, d: _statuses(s, d).select("doc_id", "status"), f"select doc_id, {_STATUS_SQL} status from (select doc_id, {_FLAGS} from documents)"),
    "status_counts": (
        lambda s, d: status_counts(_statuses(s, d), "source"),
        f"select source, status, count(*) n, bool_or(status = 'processed') over (partition by source) changed from (select source, {_STATUS_SQL} status from (select source, {_FLAGS} from documents)) group by source, status",
    ),
    "stamp_rules": (
        lambda s, d: stamp_violations(table(s, d, "conversations").selectExpr(*split_columns(_STAMP)).selectExpr("*", "x0 + 60 x1", "y0 + 20 y1", "595D w", "842D h", )).selectExpr("conv_id", "turn", "array_join(violations, ',') violations"),
        f"""with s as (select *, x0 + 60 x1, y0 + 20 y1 from (select {_STAMP} from conversations))
select conv_id, turn, concat_ws(',', case when not regexp_matches(text, '\\S') then 'empty' end, case when length(text) > 2000 then 'long' end, case when size < 6 or size > 144 then 'size' end, case when not (x0 >= 0 and y0 >= 0 and x1 <= 595 and y1 <= 842) then 'outside' end) violations from s""",
    ),
    "uncovered_chars": (
        lambda s, d: uncovered_characters(table(s, d, "documents"), "doc_id", s.range(32, 127).selectExpr("cast(id as int) code")),
        "select distinct doc_id, concat('U+', lpad(upper(to_hex(unicode(ch))), 4, '0')) as \"character\" from (select doc_id, unnest(list_distinct(string_split(text, ''))) ch from documents) where ch not in ('', chr(10), chr(13)) and not unicode(ch) between 32 and 126",
    ),
    "extract_stamps": (
        lambda s, d: extract_stamps(table(s, d, "events").selectExpr("event_id", "event_type", "cast(get_json_object(props, '$.k') as int) k").selectExpr("event_id", f"{_PAYLOAD.replace('{k}', 'k').replace('{string}', 'string')} payload"), "event_id"),
        f"""with p as (select event_id, {_PAYLOAD.replace('{k}', 'k').replace('{string}', 'varchar')} payload from (select event_id, event_type, cast(json_extract(props, '$.k') as integer) k from events))
select event_id, cast(payload->'$.rect[0]' as double) x0, cast(payload->'$.rect[1]' as double) y0, cast(payload->'$.rect[2]' as double) x1, cast(payload->'$.rect[3]' as double) y1, payload->>'$.text' as text, coalesce(cast(payload->'$.size' as double), 0) size, payload->>'$.color' color
from p where cast(payload->'$.version' as integer) = 1 and json_array_length(payload, '$.rect') = 4""",
    ),
    "copy_range": (
        lambda s, d: copy_ranges(table(s, d, "conversations").selectExpr("conv_id key", "turn page", "if(conv_id % 9 = 4 and turn = 2, null, text) text"), table(s, d, "conversations").select("conv_id").distinct().selectExpr(*split_columns(_RANGE)).withColumnRenamed("conv_id", "key")),
        rf"""with r as (select {_RANGE} from (select distinct conv_id from conversations)),
i as (select r.conv_id, allowed, turn, case when r.conv_id % 9 = 4 and turn = 2 then null else text end t from r left join conversations c on r.conv_id = c.conv_id and turn between 1 and 3),
g as (select conv_id, allowed, count(t) n, string_agg(nullif(case turn when 1 then substr(t, 6) when 3 then substr(t, 1, 12) else t end, ''), chr(10) || chr(10) order by turn) joined from i group by all)
select conv_id key, case when not allowed then 'denied' when n < 3 then 'failed' else 'copied' end status, case when allowed and n = 3 then coalesce(joined, '') end copied from g""",
    ),
    "progress_running": (
        lambda s, d: progress(table(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").selectExpr("conv_id", "turn", "cast(done as bigint) done", "total"),
        "select conv_id, turn, row_number() over (partition by conv_id order by turn) done, count(*) over (partition by conv_id) total from conversations",
    ),
}
