"""Page labels, outlines, destinations and links."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.numbers import ROMAN, number_text
from quire.functions.strings import split_columns
from quire.operators.asof import asof
from quire.operators.layout import page_label_text
from quire.sources.sinks import written
from quire.sources.tables import table


def label_pages(pages: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """pages: key, page. ranges: key, start_page, style, prefix, start_number. Each page takes the last range at or before it.

    A range ends where the next one starts, valid or not; one that starts before the document or with a number below 1
    labels nothing. Of ranges with one start, the greatest by style, prefix and number counts. A page without a range, or
    whose number its style can't write, has an empty label.
    """
    starts = ranges.groupBy(key, F.col("start_page").alias("page")).agg(F.max(F.struct("style", "prefix", "start_number")).alias("r")).selectExpr(key, "page", "r.*")
    met = asof(pages.select(key, "page"), starts, [key], "page", 4096).selectExpr(key, "page", "if(before.page >= 0 and before.start_number >= 1, before, null) r")
    number = number_text("r.style", "(page - r.page + r.start_number)")
    return met.selectExpr(key, "page", f"coalesce(concat(coalesce(r.prefix, ''), {number}), '') label")


#: SQL over kind, page, n_pages, x0, y0, x1, y1, zoom: the notice of an unusable destination, in the order of the checks.
DESTINATION_NOTICE = """case when kind is null or kind not in ('XYZ', 'Fit', 'FitH', 'FitV', 'FitR') then 'unsupported type'
  when page is null or page < 0 or page >= n_pages then 'page out of range'
  when exists(array(x0, y0, x1, y1, zoom), v -> v is not null and (isnan(v) or abs(v) = double('infinity'))) then 'infinite coordinate'
  when kind = 'FitR' and (x0 is null or y0 is null or x1 is null or y1 is null or not (x1 > x0 and y1 > y0)) then 'empty rectangle' end"""


def resolve_names(names: DataFrame, starts: DataFrame, limit: int = 64) -> DataFrame:
    """names: name, next (another name) or page. starts: name -> name, page, notice.

    A chain ends at a page; a name that isn't there is missing, one with neither next nor page has no page, and a chain
    of more than `limit` names (missing ones count) or with a repeated name is a cycle. Each round doubles the distance
    that every name looks ahead, so log2(limit) joins replace a walk.
    """
    known = names.select(F.col("name").alias("to"), F.lit(True).alias("_there"))
    # Steps taken, where they lead, and whether that name is there; an end leads to itself in no steps.
    jump = names.selectExpr("name", "if(page is null, coalesce(next, name), name) to", "if(page is null and next is not null, 1, 0) steps")
    jump = jump.join(known, "to", "left").selectExpr("name", "to", "steps", "coalesce(_there, false) there")
    reach = 1
    while reach < limit:
        ahead = jump.selectExpr("name to", "to far", "steps more", "there far_there")
        # A missing name has no row of its own, so what jumps to it stays there.
        jump = jump.join(ahead, "to", "left").selectExpr("name", "coalesce(far, to) to", "steps + coalesce(more, 0) steps", "coalesce(far_there, there) there")
        reach *= 2
    ends = jump.join(names.selectExpr("name to", "page", "next"), "to", "left")
    # The start is a name too, so `limit` names are one step less.
    ends = ends.selectExpr("name", "page", f"case when steps >= {limit} or next is not null and page is null then 'cycle' when not there then 'missing' when page is null then 'no page' end notice")
    return starts.select("name").distinct().join(ends, "name", "left").selectExpr("name", "if(notice is null, page, null) page", "if(page is null and notice is null, 'missing', notice) notice")


def resolve_links(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages: page_id, html. known: path. Every href, its class and notice: internal targets are looked up, external ones only noted."""
    href = r"""regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)"""
    kind = r"case when href = '' then 'none' when href rlike '^[a-z]+:.*\\s' then 'compound' when href rlike '^(https?|mailto):' then 'external' when href rlike '^[a-z]+:' then 'unsupported' else 'internal' end"
    links = pages.selectExpr("page_id", f"posexplode({href}) as (link_no, href)").selectExpr("*", f"{kind} kind")
    paths = known.select("path").distinct().withColumn("_known", F.lit(True))
    both = links.join(paths, F.col("href") == F.col("path"), "left")
    notice = "case kind when 'none' then 'no action' when 'compound' then 'unsupported' when 'unsupported' then 'unsupported' when 'external' then 'external, not opened' when 'internal' then if(_known, null, 'target missing') end"
    return both.selectExpr("page_id", "link_no", "href", "kind", f"{notice} notice")


def _preorder(limit: int, deepest: int):
    def walk(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["level", "rank"])
        below: dict = {}
        for id_, parent, level in zip(nodes["id"], nodes["parent"], nodes["level"], strict=True):
            below.setdefault(None if level == 0 else (level - 1, parent), []).append((id_, level))
        rows, limited = [], False
        todo = [(*x, None) for x in reversed(below[None])]
        while todo:
            id_, level, above = todo.pop()
            if level > deepest or len(rows) == limit:
                limited = True
                if level <= deepest:
                    break
                continue
            rows.append((nodes["tree"].iloc[0], id_, level, len(rows), above))
            todo += [(*x, len(rows) - 1) for x in reversed(below.get((level, id_), ()))]
        out = pd.DataFrame(rows, columns=["tree", "id", "depth", "position", "parent_position"])
        return out.astype({"parent_position": "Int32"}).assign(limited=limited)

    return walk


def bookmark_tree(nodes: DataFrame, limit: int = 10_000, deepest: int = 64) -> DataFrame:
    """nodes: tree, id, parent (null at the top), place (among siblings) -> the preorder walk of each tree.

    Adds depth (0 at the top), position (from 0), parent_position and limited. What lies deeper than `deepest`, or beyond
    `limit` items, is left out and marks its tree as limited; nodes on a cycle are never reached. Levels are opened one by
    one, each by a join with the nodes, and written. Of a level only the first `limit` nodes in the order of the walk, and
    one more to show that there are others, can matter; so a tree of any size is walked from a bounded number of rows.
    """
    rows = nodes.select("tree", "id", "parent", "place")

    def first(level: DataFrame, *order: str) -> DataFrame:
        ranked = level.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
        return written(ranked.filter(F.col("rank") <= limit + 1).selectExpr("tree", "id", "coalesce(parent, id) parent", "rank"))

    level, levels = first(rows.filter("parent is null"), "place", "id"), []
    while not level.isEmpty():
        levels.append(level.withColumn("level", F.lit(len(levels))))
        if len(levels) > deepest + 1:  # one level more shows which trees are cut off
            break
        above = level.select("tree", F.col("id").alias("parent"), F.col("rank").alias("above"))
        level = first(rows.join(above, ["tree", "parent"]), "above", "place", "id")
    kept = reduce(DataFrame.union, levels or [level.withColumn("level", F.lit(0))])
    kind = lambda c: nodes.schema[c].dataType.simpleString()
    return kept.groupBy("tree").applyInPandas(_preorder(limit, deepest), f"tree {kind('tree')}, id {kind('id')}, depth int, position int, parent_position int, limited boolean")


_RANGES = [("0", "'r'", "''", "1"), ("2", "'D'", "'本編-'", "if(conv_id % 5 = 0, 0, 7)"), ("4", "'A'", "cast(null as {string})", "27 + conv_id % 40"), ("5 + conv_id % 3", "'R'", "'§'", "990 + conv_id"), ("99", "'D'", "''", "1"), ("7", "'-'", "'Annex'", "1"), ("8", "'a'", "''", "2601")]


def _ranges(s, d):
    convs = table(s, d, "conversations").select("conv_id").distinct()
    out = None
    for start, style, prefix, number in _RANGES:
        r = convs.selectExpr("conv_id", f"cast({start} as bigint) start_page", f"{style} style", f"{prefix.replace('{string}', 'string')} prefix", f"cast({number} as bigint) start_number")
        out = r if out is None else out.union(r)
    return out


def _label_sql():
    rows = " union all ".join(f"select conv_id, cast({a} as bigint) start_page, {b} style, {c.replace('{string}', 'varchar')} prefix, cast({n.replace('if(conv_id % 5 = 0, 0, 7)', 'case when conv_id % 5 = 0 then 0 else 7 end')} as bigint) start_number from c" for a, b, c, n in _RANGES)
    place = lambda row, power: f"([{', '.join(repr(x) for x in row)}])[cast(n // {power} % 10 as integer) + 1]"
    rom = f"concat(repeat('M', cast(n // 1000 as integer)), {place(ROMAN[2], 100)}, {place(ROMAN[1], 10)}, {place(ROMAN[0], 1)})"
    let = "repeat(chr(65 + cast((n - 1) % 26 as integer)), cast((n - 1) // 26 + 1 as integer))"
    return f"""with c as (select distinct conv_id from conversations), r0 as ({rows}), r1 as (select * from (select *, row_number() over (partition by conv_id, start_page order by style desc) rn from r0) where rn = 1),
v as (select *, lead(start_page) over (partition by conv_id order by start_page) until from r1),
w as (select v.* from v join (select conv_id, max(turn) last_page from conversations group by 1) using (conv_id) where start_page between 0 and last_page and start_number >= 1),
j as (select c.conv_id, c.turn page, style, coalesce(prefix, '') prefix, c.turn - start_page + start_number n from conversations c left join w on c.conv_id = w.conv_id and c.turn >= start_page and (until is null or c.turn < until))
select conv_id, page, coalesce(prefix || (case style when 'D' then cast(n as varchar) when 'R' then case when n between 1 and 100000 then {rom} end when 'r' then case when n between 1 and 100000 then lower({rom}) end when 'A' then case when n between 1 and 2600 then {let} end when 'a' then case when n between 1 and 2600 then lower({let}) end else case when style is not null then '' end end), '') as label from j"""


_DEST = "event_id, case k % 7 when 0 then 'XYZ' when 1 then 'Fit' when 2 then 'FitH' when 3 then 'FitV' when 6 then 'Other' else 'FitR' end kind, cast(k - 3 as bigint) page, 90 n_pages, {inf} x0, cast(k as double) y0, case when k % 4 = 1 then null else value end x1, cast(60 as double) y1, {zoom} zoom"
_NAMES = "c_custkey name, case when c_custkey % 10 = 0 then null when c_custkey > 40 and c_custkey < 130 then c_custkey + 1 else (c_custkey * 7 + 3) % 1600 end as next, case when c_custkey % 20 = 0 and (c_custkey <= 40 or c_custkey >= 130) then c_custkey // 10 end page"


def _destinations(s, d):
    events = table(s, d, "events").selectExpr("event_id", "value", "cast(get_json_object(props, '$.k') as int) k")
    return events.selectExpr(*split_columns(_DEST.format(inf="if(k % 9 = 2, double('infinity'), 5D)", zoom="if(k % 11 = 5, double('-infinity'), null)")))


QUERIES = {
    "label_pages": (lambda s, d: label_pages(table(s, d, "conversations").selectExpr("conv_id", "turn page"), _ranges(s, d), "conv_id"), _label_sql()),
    "page_label_text": (
        lambda s, d: label_pages(table(s, d, "conversations").selectExpr("conv_id", "turn page"), _ranges(s, d), "conv_id").selectExpr("conv_id", "page", f"{page_label_text('label', 'page')} description"),
        f"select conv_id, page, case when label <> '' then concat(label, ' (', page + 1, ')') else cast(page + 1 as varchar) end description from ({_label_sql()})",
    ),
    "destination_valid": (
        lambda s, d: _destinations(s, d).selectExpr("event_id", f"{DESTINATION_NOTICE} notice", f"if({DESTINATION_NOTICE} is null, page, null) page"),
        f"""with d as (select {_DEST.format(inf="case when k % 9 = 2 then 'infinity'::double else 5 end", zoom="case when k % 11 = 5 then '-infinity'::double end")} from (select event_id, value, cast(json_extract(props, '$.k') as integer) k from events)),
n as (select event_id, page, case when kind not in ('XYZ', 'Fit', 'FitH', 'FitV', 'FitR') then 'unsupported type' when page < 0 or page >= n_pages then 'page out of range' when isinf(x0) or coalesce(isinf(zoom), false) then 'infinite coordinate' when kind = 'FitR' and (x1 is null or not (x1 > x0 and y1 > y0)) then 'empty rectangle' end notice from d)
select event_id, notice, case when notice is null then page end page from n""",
    ),
    "resolve_destination": (
        lambda s, d: (lambda names: resolve_names(names, names))(table(s, d, "customer").selectExpr(*[x.strip() for x in _NAMES.replace("//", "div").split(",")])),
        f"""with recursive n as (select {_NAMES} from customer), w as (select name as first_, name, 1 names, false missing from n
  union all select first_, m.next, names + 1, o.name is null from w join n m on m.name = w.name left join n o on o.name = m.next where m.page is null and m.next is not null and names <= 64),
e as (select first_, arg_max(name, names) name, max(names) names, bool_or(missing) missing from w group by first_)
select first_ as name, case when names <= 64 then page end page, case when names > 64 then 'cycle' when missing then 'missing' when page is null then 'no page' end notice from e left join n on n.name = e.name""",
    ),
    "resolve_links": (
        lambda s, d: resolve_links(table(s, d, "pages"), table(s, d, "pages").selectExpr("regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) path").union(table(s, d, "pages").selectExpr("explode(array('/the', '/and', '/que')) path"))),
        r"""with l as (select page_id, unnest(range(len(h))) link_no, h from (select page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) h from pages)),
k as (select page_id, cast(link_no as integer) link_no, h[link_no + 1] href from l),
c as (select *, case when href = '' then 'none' when regexp_matches(href, '^[a-z]+:.*\s') then 'compound' when regexp_matches(href, '^(https?|mailto):') then 'external' when regexp_matches(href, '^[a-z]+:') then 'unsupported' else 'internal' end kind from k),
p as (select regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) path from pages union select unnest(['/the', '/and', '/que']))
select page_id, link_no, href, kind, case kind when 'none' then 'no action' when 'compound' then 'unsupported' when 'unsupported' then 'unsupported' when 'external' then 'external, not opened' else case when path is null then 'target missing' end end notice from c left join p on href = path""",
    ),
    "bookmark_tree": (
        lambda s, d: bookmark_tree(table(s, d, "part").selectExpr("p_partkey % 7 tree", "p_partkey id", "if(p_partkey < 22, null, if(p_partkey % 50 = 49, p_partkey, (p_partkey div 21) * 7 + p_partkey % 7 - 7)) parent", "p_size place")),
        """with recursive nodes as (select p_partkey % 7 tree, p_partkey id, case when p_partkey < 22 then null when p_partkey % 50 = 49 then p_partkey else (p_partkey // 21) * 7 + p_partkey % 7 - 7 end parent, p_size place from part),
walk as (select tree, id, parent, 0 depth, [cast(place as bigint), id] path from nodes where parent is null union all select n.tree, n.id, n.parent, w.depth + 1, list_concat(w.path, [cast(n.place as bigint), n.id]) from walk w join nodes n on n.tree = w.tree and n.parent = w.id where w.depth <= 64),
k as (select *, row_number() over (partition by tree order by path) rn from walk where depth <= 64), z as (select tree, max(depth) > 64 or count(*) > 10000 limited from walk group by tree),
t as (select *, rn - 1 pos from k where rn <= 10000)
select t.tree, t.id, t.depth, cast(t.pos as integer) as "position", cast(u.pos as integer) parent_position, limited from t join z using (tree) left join t u on u.tree = t.tree and u.id = t.parent""",
    ),
}
