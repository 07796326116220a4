"""Glyph boxes and page geometry. Boxes come from a fixed-pitch layout: 11 pt text in 6.6 pt cells, 18 pt leading, first
baseline at 769.89 pt, left edge at 48 pt, lines wrapped at a number of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.sequences import edit_distances
from quire.functions.strings import SPACE, norm_text
from quire.functions.words import WORD_DUCK
from quire.operators.asof import asof
from quire.operators.text import grapheme_starts, word_bounds
from quire.sources.sinks import written
from quire.sources.tables import table

#: Characters whose glyphs one task sorts, some 130 bytes each.
GLYPHS = 2_000_000
LEFT, TOP, LEADING, PITCH, SIZE, WRAP = 48, 769.89, 18, 6.6, 11, 83


def layout_glyphs(pages: DataFrame, *key: str, wrap: int = WRAP) -> DataFrame:
    """key, row (line on the page), col, idx (character of the page), ch and its box; white space has no box."""
    # Partitions are as many as the characters ask for: adaptive execution would go by the far smaller lines, and what sorts or groups glyphs later on takes these partitions as they are.
    chars = pages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    pages = pages.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-chars // GLYPHS)), *key)
    lines = pages.selectExpr(*key, r"posexplode(split(text, '\n')) as (line_no, line)")
    start = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("rows", F.expr(f"greatest(1, ceil(length(line) / {wrap}))"))
    lines = lines.withColumn("row0", F.coalesce(F.sum("rows").over(start), F.lit(0))).withColumn("at0", F.coalesce(F.sum(F.length("line") + 1).over(start), F.lit(0)))
    chars = lines.filter("line <> ''").selectExpr(*key, "row0", "at0", "posexplode(split(line, '')) as (k, ch)")
    placed = chars.selectExpr(*key, f"cast(row0 + k div {wrap} as int) row", f"cast(k % {wrap} as int) col", "cast(at0 + k as int) idx", "ch")
    box = rf"if(ch rlike '(?U)\\s', null, {{}})"
    return placed.selectExpr("*", f"{box.format(f'{LEFT} + col * {PITCH}D')} x0", f"{box.format(f'{TOP}D - row * {LEADING}')} y0", f"{box.format(f'{LEFT} + (col + 1) * {PITCH}D')} x1", f"{box.format(f'{TOP}D - row * {LEADING} + {SIZE}')} y1")


def clean_page_chars(glyphs: DataFrame, key: list[str], crop: tuple[float, float, float, float]) -> DataFrame:
    """Without carriage returns, clipped to the crop box; characters outside go, white space without a box stays, and trailing line ends go."""
    a, b, c, d = (f"{x}D" for x in crop)
    clipped = glyphs.filter(r"ch <> '\r'").selectExpr(*key, "row", "col", "idx", "ch", *(f"if({e} is null, null, {f}({e}, {m})) {e}" for e, f, m in (("x0", "greatest", a), ("y0", "greatest", b), ("x1", "least", c), ("y1", "least", d))))
    inside = clipped.filter(r"if(x0 is null, ch rlike '(?U)\\s', x0 < x1 and y0 < y1)")
    last = F.max(F.when(F.col("ch") != "\n", F.col("idx"))).over(Window.partitionBy(*key).orderBy("row", "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # gap_space_boxes can use this order
    return inside.withColumn("_last", last).filter("idx <= _last").drop("_last")


def gap_space_boxes(glyphs: DataFrame, key: list[str], crop: tuple[float, float, float, float] | None = None) -> DataFrame:
    """White space without a box between two boxes of a line gets the gap between them, if it is positive, over the line's height and within the crop box."""
    line = Window.partitionBy(*key, "row")
    order = line.orderBy("idx")
    seen = glyphs.withColumns({"_x0": F.lag("x1").over(order), "_x1": F.lead("x0").over(order), "_y0": F.min("y0").over(line), "_y1": F.max("y1").over(line)})
    a, b, c, d = (f"{x}D" for x in crop or (float("-1e9"), float("-1e9"), 1e9, 1e9))
    gap = {"x0": f"greatest(_x0, {a})", "y0": f"greatest(_y0, {b})", "x1": f"least(_x1, {c})", "y1": f"least(_y1, {d})"}
    fits = rf"x0 is null and ch rlike '(?U)^\\s$' and _x0 < _x1 and {gap['x0']} < {gap['x1']} and {gap['y0']} < {gap['y1']}"
    return seen.selectExpr(*key, "row", "col", "idx", "ch", *(f"if({fits}, {v}, {e}) {e}" for e, v in gap.items()))


def line_boxes(glyphs: DataFrame, key: list[str]) -> DataFrame:
    """The union of the glyph boxes of each line, with its first and last character."""
    return glyphs.filter("x0 is not null").groupBy(*key, "row").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def page_geometry(pages: DataFrame, scale: float, x: str = "x", y: str = "y") -> DataFrame:
    """Adds width, height (of the crop box in user units, swapped at 90 and 270 degrees) and the device point of (x, y) from the top left."""
    w, h = "((crop_x1 - crop_x0) * user_unit)", "((crop_y1 - crop_y0) * user_unit)"
    px, py = f"(({x} - crop_x0) * user_unit)", f"(({y} - crop_y0) * user_unit)"
    turn = "pmod(rotation, 360)"
    return pages.selectExpr(
        "*", f"if({turn} in (90, 270), {h}, {w}) width", f"if({turn} in (90, 270), {w}, {h}) height",
        f"{scale}D * case {turn} when 90 then {py} when 180 then {w} - {px} when 270 then {h} - {py} else {px} end dev_x",
        f"{scale}D * case {turn} when 90 then {px} when 180 then {py} when 270 then {w} - {px} else {h} - {py} end dev_y",
    )


def delta_mm(a: str, b: str) -> str:
    """SQL: the greatest edge difference of two boxes in mm."""
    return "greatest(" + ", ".join(f"abs({a}_{e} - {b}_{e})" for e in ("x0", "y0", "x1", "y1")) + ") * 25.4 / 72"


def line_texts(glyphs: DataFrame, key: list[str]) -> DataFrame:
    """line_boxes with the text of each line."""
    texts = glyphs.groupBy(*key, "row").agg(F.expr("listagg(ch, '') within group (order by idx)").alias("text"))
    return line_boxes(glyphs, key).join(texts, [*key, "row"])


def line_measurements(reference: DataFrame, output: DataFrame, key: list[str]) -> DataFrame:
    """Lines zipped by rank: line (from 1), in_reference, in_output, greatest edge difference in mm and edit distance of the normalised texts."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("row")).alias("line")
    side = lambda df, p: df.select(*key, rank, F.lit(True).alias(f"in_{p}"), norm_text(F.col("text")).alias(f"{p}_text"), *(F.col(e).alias(f"{p}_{e}") for e in ("x0", "y0", "x1", "y1")))
    both = side(reference, "r").join(side(output, "o"), [*key, "line"], "full_outer")
    return both.select(*key, "line", F.expr("in_r is not null in_reference"), F.expr("in_o is not null in_output"), F.expr(f"round({delta_mm('r', 'o')}, 6) mm"), edit_distances("r_text", "o_text").alias("edits"))


def line_alignment(reference: DataFrame, output: DataFrame, key: list[str], most_mm: float = 2.0) -> DataFrame:
    """Of the zipped lines: line counts, greatest difference in mm, sum of edits; PASS iff the counts agree and all lie within the limit."""
    sums = line_measurements(reference, output, key).groupBy(*key).agg(
        F.count_if("in_reference").alias("n_reference"), F.count_if("in_output").alias("n_output"), F.expr("max(if(in_reference and in_output, mm, null))").alias("max_mm"), F.expr("coalesce(sum(if(in_reference and in_output, edits, null)), 0)").alias("edits")
    )
    return sums.withColumn("status", F.when((F.col("n_reference") == F.col("n_output")) & (F.col("max_mm") <= most_mm), "PASS").otherwise("FAIL"))


#: SQL: whether (x, y) lies in one of the region's quads (four corners each, in order), by the parity of crossed edges.
_IN_REGION = """exists(region, q -> aggregate(sequence(0, 3), false, (s, i) ->
  s != (((q[i].y > y) != (q[(i + 1) % 4].y > y)) and x < coalesce(try_divide((q[(i + 1) % 4].x - q[i].x) * (y - q[i].y), q[(i + 1) % 4].y - q[i].y), 0D) + q[i].x)))"""


#: Cells of the coarse grids have a side of _CELL * 4**level; what is wider than the last level's belongs to one cell that holds all.
_CELL, _LEVELS = 16.0, 8
#: A point may meet so many lines of its page without a grid.
FEW = 64


def _cells(low: list[str], high: list[str], side: str) -> str:
    """SQL: the cells of a box (of two dimensions or one), at the level whose cells are about as wide: at most two for each dimension."""
    level = f"case when {side} <= {_CELL} then 0 when {side} <= {_CELL * 4.0 ** (_LEVELS - 1)} then cast(ceil(log(4, {side} / {_CELL})) as int) else -1 end"
    spans = [f"sequence(floor({a} / ({_CELL} * pow(4, l))), floor({b} / ({_CELL} * pow(4, l))))" for a, b in zip(low, high, strict=True)] + ["array(0L)"]
    grid = f"flatten(transform({spans[0]}, i -> transform({spans[1]}, j -> struct(l, i, j))))"
    return f"flatten(transform(array({level}), l -> if(l < 0, array(struct(l, 0L i, 0L j)), {grid})))"


def _cells_of_point(place: list[str]) -> str:
    """SQL: the cells of all levels that hold a point."""
    at = [f"floor({p} / ({_CELL} * pow(4, l)))" for p in place] + ["0L"]
    return f"transform(sequence(-1, {_LEVELS - 1}), l -> if(l < 0, struct(l, 0L i, 0L j), struct(l, {at[0]} i, {at[1]} j)))"


def _in_cells(points: DataFrame, boxes: DataFrame, key: list[str], place: list[str], low: list[str], high: list[str]) -> DataFrame:
    """Points with the boxes that share a cell with them; both carry their columns."""
    side = f"greatest({', '.join(f'{b} - {a}' for a, b in zip(low, high, strict=True))}, 0D)"
    return points.selectExpr("*", f"explode({_cells_of_point(place)}) _c").join(boxes.selectExpr("*", f"explode({_cells(low, high, side)}) _c"), [*key, "_c"])


def hit_candidates(points: DataFrame, annotations: DataFrame, key: list[str]) -> DataFrame:
    """The pairs that hit_test judges: a point and the boxes, or bounds of the regions, that share a cell of a grid with it."""
    corner = lambda f, e: f"if(size(region) > 0, array_{f}(flatten(transform(region, q -> transform(q, c -> c.{e})))), {e}{0 if f == 'min' else 1})"
    bounds = annotations.filter("not hidden").selectExpr("*", *(f"{corner(f, e)} {n}" for n, f, e in (("_x0", "min", "x"), ("_y0", "min", "y"), ("_x1", "max", "x"), ("_y1", "max", "y"))))
    return _in_cells(points, bounds.filter("_x0 <= _x1 and _y0 <= _y1"), key, ["x", "y"], ["_x0", "_y0"], ["_x1", "_y1"])


def hit_test(points: DataFrame, annotations: DataFrame, key: list[str], crop: tuple[float, float, float, float] | None = None) -> DataFrame:
    """points: key, point_id, x, y. annotations: key, ord, box, hidden, region. The last visible annotation that holds each point, null if none.

    region holds quads, arrays of four corners (x, y); where there are any they stand in for the box. A point outside the
    crop box hits nothing. A point meets the annotations about it only, by the cells of a grid with levels for all sizes.
    """
    inside = "true" if crop is None else f"x between {crop[0]}D and {crop[2]}D and y between {crop[1]}D and {crop[3]}D"
    holds = f"if(size(region) > 0, {_IN_REGION}, x between x0 and x1 and y between y0 and y1)"
    found = hit_candidates(points.filter(inside), annotations, key).filter(holds).groupBy("point_id").agg(F.max("ord").alias("hit"))
    return points.select(*key, "point_id").join(found, "point_id", "left")


def line_candidates(points: DataFrame, lines: DataFrame, key: list[str], few: int = FEW) -> DataFrame:
    """The pairs that nearest_line judges, however many lines a page has.

    On a page of up to `few` lines a point meets them all. Elsewhere it meets the lines beside it, by the cells of a grid
    with levels for all heights, or, without any, those whose edge is the nearest one above or below.
    """
    boxes = lines.select(*key, "row", "x0", "y0", "x1", "y1").filter("y0 <= y1").withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    boxes = written(boxes)  # read several times
    asked, many = points.select(*key, "point_id", "x", "y"), boxes.filter(f"_n > {few}").drop("_n")
    direct = asked.join(boxes.filter(f"_n <= {few}").drop("_n").hint("merge"), key)  # their files are a small part of their size in memory
    if many.isEmpty():
        return direct
    asked = asked.join(many.select(*key).distinct(), key, "left_semi")
    beside = _in_cells(asked, many, key, ["y"], ["y0"], ["y1"]).filter("y between y0 and y1").drop("_c")
    alone = asked.join(beside.select("point_id").distinct(), "point_id", "left_anti").withColumn("_y", F.col("y"))
    edges = lambda e: many.select(*key, F.col(e).alias("_y")).distinct()
    lower = asof(alone, edges("y1"), key, "_y", 256.0).select(*asked.columns, F.col("before._y").alias("_low"))
    both = asof(lower.withColumn("_y", F.col("y")), edges("y0"), key, "_y", 256.0).select(*asked.columns, "_low", F.col("after._y").alias("_high"))
    least = both.withColumn("_d", F.expr("least(round(y - _low, 9), round(_high - y, 9))"))
    below = least.filter("round(y - _low, 9) = _d").select(*asked.columns, F.col("_low").alias("y1")).join(many, [*key, "y1"])
    above = least.filter("round(_high - y, 9) = _d").select(*asked.columns, F.col("_high").alias("y0")).join(many, [*key, "y0"])
    return direct.unionByName(beside).unionByName(below).unionByName(above)


def nearest_line(points: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """The line with the least (vertical, horizontal) distance to each point, 0 inside; the first of equals."""
    dy, dx = "greatest(y0 - y, y - y1, 0D)", "greatest(x0 - x, x - x1, 0D)"
    both = line_candidates(points, lines, key).selectExpr("point_id", f"struct(round({dy}, 9) dy, round({dx}, 9) dx, row) d")
    best = both.groupBy("point_id").agg(F.min("d").alias("d"))
    return points.join(best, "point_id", "left").selectExpr(*key, "point_id", "x", "y", "d.row row", "d.dy dy", "d.dx dx")


def caret(points: DataFrame, glyphs: DataFrame, graphemes: DataFrame, key: list[str]) -> DataFrame:
    """Of the nearest line (see nearest_line): the first boxed character whose middle lies right of x, else the line's end; then the start of its grapheme.

    graphemes: key and starts, as grapheme_starts gives them.
    """
    # Spark takes glyphs and graphemes for as small as the files that they come from, so it would broadcast them: both are merged.
    both = points.select(*key, "point_id", "x", "row").join(glyphs.hint("merge"), [*key, "row"])
    at = both.groupBy(*key, "point_id").agg(F.coalesce(F.min(F.when((F.col("x0") + F.col("x1")) / 2 > F.col("x"), F.col("idx"))), F.max("idx") + 1).alias("at"), F.max("idx").alias("_last"))
    # The end of a line is a boundary of its own.
    return at.join(graphemes.hint("merge"), key, "left").selectExpr(*key, "point_id", "if(at > _last, at, coalesce(array_max(filter(starts, s -> s <= at)), at)) at")


def word_at(points: DataFrame, glyphs: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """The word around the glyph of the nearest line that is nearest to each point: start and end, null between words."""
    both = points.select(*key, "point_id", "x", "row").join(glyphs.filter("x0 is not null").hint("merge"), [*key, "row"])  # see caret
    near = both.groupBy(*key, "point_id").agg(F.min(F.expr("struct(round(greatest(x0 - x, x - x1, 0D), 9) d, idx)")).alias("g"))
    return near.join(word_bounds(pages, *key).hint("merge"), key, "left").selectExpr(*key, "point_id", "get(filter(spans, s -> g.idx >= s.b and g.idx < s.e), 0) w").selectExpr(*key, "point_id", "w.b start", "w.e end")


def merge_text_layer(existing: DataFrame, recognised: DataFrame, key: list[str], grow: float = 0.48) -> DataFrame:
    """Existing boxes plus the recognised ones that overlap none of them, grown by `grow` points on each side.

    Boxes that are near each other share a cell of a coarse grid, so overlap is looked for within cells, not within pages.
    """
    cell = 200
    cells = lambda by: f"explode(flatten(transform(sequence(cast(floor((x0 - {by}) / {cell}) as int), cast(floor((x1 + {by}) / {cell}) as int)), i -> transform(sequence(cast(floor((y0 - {by}) / {cell}) as int), cast(floor((y1 + {by}) / {cell}) as int)), j -> struct(i, j))))) c"
    e = existing.selectExpr(*key, cells(grow), "x0 ex0", "y0 ey0", "x1 ex1", "y1 ey1")
    r = recognised.selectExpr(*key, "id", cells(0), "x0", "y0", "x1", "y1")
    taken = r.join(e, [*key, "c"]).filter(f"x0 < ex1 + {grow} and x1 > ex0 - {grow} and y0 < ey1 + {grow} and y1 > ey0 - {grow}").select(*key, "id").distinct()
    fresh = recognised.join(taken, [*key, "id"], "left_anti")
    return existing.withColumn("layer", F.lit("text")).unionByName(fresh.withColumn("layer", F.lit("recognised")))


def array_delta(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds n_changed, first and last changed place (null if none) of two arrays of one length, and equal."""
    changed = f"filter(transform(arrays_zip({a}, {b}), (z, i) -> if(z.{a} <=> z.{b}, null, i)), i -> i is not null)"
    return pairs.selectExpr("*", f"{changed} _c").selectExpr("*", "size(_c) n_changed", "array_min(_c) first", "array_max(_c) last", "size(_c) = 0 equal").drop("_c")


def page_label_text(label: str, page: str) -> str:
    """SQL: 'label (physical n)', or the physical number alone."""
    return f"if(coalesce({label}, '') <> '', concat({label}, ' (', {page} + 1, ')'), cast({page} + 1 as string))"


_KEY = ["conv_id", "turn"]
#: The corpus has plain spaces only: some pages get wide ones instead.
_WIDE = "case when conv_id % 9 = 4 then replace(text, ' ', '\u3000') else text end"


def _pages(s, d):
    return table(s, d, "conversations").selectExpr("conv_id", "turn", f"{_WIDE} text")


def _glyphs(s, d):
    return layout_glyphs(_pages(s, d), *_KEY)


def _points(s, d):
    return _pages(s, d).selectExpr(*_KEY, "conv_id * 1000 + turn point_id", "cast((conv_id * 53 + turn * 29) % 560 as double) x", "cast(780 - (conv_id * 31 + turn * 17) % 120 as double) y")


_POINT = "select conv_id, turn, conv_id * 1000 + turn point_id, cast((conv_id * 53 + turn * 29) % 560 as double) x, cast(780 - (conv_id * 31 + turn * 17) % 120 as double) y from conversations"
_GLYPH = rf"""gl0 as (select conv_id, turn, unnest(range(len(p))) line_no, p from (select conv_id, turn, string_split({_WIDE}, chr(10)) p from conversations)),
gl1 as (select conv_id, turn, line_no, p[line_no + 1] line from gl0),
gl2 as (select *, coalesce(sum(greatest(1, ceil(length(line) / {WRAP}))) over w, 0) row0, coalesce(sum(length(line) + 1) over w, 0) at0 from gl1 window w as (partition by conv_id, turn order by line_no rows between unbounded preceding and 1 preceding)),
gl3 as (select *, unnest(range(length(line))) k from gl2),
gl4 as (select conv_id, turn, cast(row0 + k // {WRAP} as integer) as row, cast(k % {WRAP} as integer) col, cast(at0 + k as integer) idx, substr(line, k + 1, 1) ch from gl3),
glyph as (select *, case when not b then {LEFT} + col * {PITCH}::double end x0, case when not b then {TOP}::double - row * {LEADING} end y0, case when not b then {LEFT} + (col + 1) * {PITCH}::double end x1, case when not b then {TOP}::double - row * {LEADING} + {SIZE} end y1 from (select *, regexp_matches(ch, '{SPACE}') b from gl4)),
ln as (select conv_id, turn, row, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, min(idx) as first, max(idx) as last from glyph where x0 is not null group by all),
pt as ({_POINT}),
near as (select *, row_number() over (partition by point_id order by dy, dx, row) rn from (select pt.conv_id, pt.turn, point_id, x, y, row, round(greatest(y0 - y, y - y1, 0), 9) dy, round(greatest(x0 - x, x - x1, 0), 9) dx from pt join ln using (conv_id, turn)))"""
_CROP = (50.0, 700.0, 400.0, 842.0)
_CLEAN = f"""clean as (select * from (select conv_id, turn, row, col, idx, ch, case when x0 is not null then greatest(x0, {_CROP[0]}) end x0, case when x0 is not null then greatest(y0, {_CROP[1]}) end y0, case when x0 is not null then least(x1, {_CROP[2]}) end x1, case when x0 is not null then least(y1, {_CROP[3]}) end y1 from glyph)
  where x0 is null or (x0 < x1 and y0 < y1))"""
_GEO = "doc_id, 10D crop_x0, 20D crop_y0, 605D + doc_id % 100 crop_x1, 862D crop_y1, cast((doc_id % 4) * 90 as int) rotation, 1 + (doc_id % 3) * 0.5D user_unit, 100D + doc_id % 7 x, 200D y"
_ROUND = ["round(x0, 4) x0", "round(y0, 4) y0", "round(x1, 4) x1", "round(y1, 4) y1"]
_NORMAL = f"trim(regexp_replace(nfc_normalize({{}}), '{SPACE.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'))"
#: DuckDB's edit distance counts bytes: each character beyond ASCII becomes a control character that the texts lack.
_BYTES = "translate({}, (select s from na), list_reduce(list_transform(range(1, 32), lambda k: case when k between 9 and 13 then '' else chr(cast(k as integer)) end), lambda a, b: a || b))"
_PAGE = (20.0, 660.0, 540.0, 790.0)
_ANN = "select conv_id, ord, hidden, x0, y0, x0 + 150 x1, y0 + 60 y1 from (select conv_id, turn ord, (conv_id + turn) % 6 = 0 hidden, cast((conv_id * 13 + turn * 90) % 500 as double) x0, cast(650 + (turn * 23) % 100 as double) y0 from conversations)"


def _texts(s, d):
    return line_texts(_glyphs(s, d), _KEY)


#: The output's text: some lines have a letter with another accent, or a mark more.
_ALTERED = "case when conv_id % 4 = 3 then concat(text, '?') when conv_id % 4 = 2 then translate(text, 'éüñ', 'èöó') else text end"


def _annotations(s, d):
    """Boxes, every third of which is a slanting quad instead."""
    boxes = table(s, d, "conversations").selectExpr("conv_id", "turn ord", "(conv_id + turn) % 6 = 0 hidden", "cast((conv_id * 13 + turn * 90) % 500 as double) x0", "cast(650 + (turn * 23) % 100 as double) y0")
    corner = lambda x, y: f"struct({x} x, {y} y)"
    quad = f"array({corner('x0', 'y0')}, {corner('x0 + 100', 'y0')}, {corner('x0 + 130', 'y0 + 60')}, {corner('x0 + 30', 'y0 + 60')})"
    return boxes.selectExpr("*", "x0 + 150 x1", "y0 + 60 y1", f"if(ord % 3 = 1, array({quad}), array()) region")


def _words(s, d):
    return _glyphs(s, d).filter("x0 is not null").groupBy("conv_id", "turn", "row").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).withColumn("id", F.col("row"))


def _recognised(s, d):
    return _words(s, d).selectExpr(*_KEY, "id + 100 id", "x0 + 10 x0", "y0 - if(id % 2 = 0, 11.3, 11.6) y0", "x1 + 10 x1", "y0 - if(id % 2 = 0, 0.3, 0.6) y1")


QUERIES = {
    "layout_glyphs": (lambda s, d: _glyphs(s, d).selectExpr(*_KEY, "row", "col", "idx", "ch", *_ROUND), f"with {_GLYPH} select conv_id, turn, row, col, idx, ch, {', '.join(_ROUND)} from glyph"),
    "clean_page_chars": (
        lambda s, d: clean_page_chars(_glyphs(s, d), _KEY, _CROP).selectExpr(*_KEY, "row", "col", "idx", "ch", *_ROUND),
        f"with {_GLYPH}, {_CLEAN} select conv_id, turn, row, col, idx, ch, {', '.join(_ROUND)} from clean",
    ),
    "gap_space_boxes": (
        lambda s, d: gap_space_boxes(clean_page_chars(_glyphs(s, d), _KEY, _CROP), _KEY, _CROP).filter(r"ch rlike '(?U)\\s'").selectExpr(*_KEY, "row", "idx", *_ROUND),
        rf"""with {_GLYPH}, {_CLEAN}, w as (select *, lag(x1) over o l_, lead(x0) over o r_, min(y0) over p a_, max(y1) over p b_ from clean window o as (partition by conv_id, turn, row order by idx), p as (partition by conv_id, turn, row)),
f as (select *, x0 is null and l_ < r_ and greatest(l_, {_CROP[0]}) < least(r_, {_CROP[2]}) and greatest(a_, {_CROP[1]}) < least(b_, {_CROP[3]}) fits from w)
select conv_id, turn, row, idx, case when fits then round(greatest(l_, {_CROP[0]}), 4) end x0, case when fits then round(greatest(a_, {_CROP[1]}), 4) end y0, case when fits then round(least(r_, {_CROP[2]}), 4) end x1, case when fits then round(least(b_, {_CROP[3]}), 4) end y1 from f where regexp_matches(ch, '{SPACE}')""",
    ),
    "line_boxes": (lambda s, d: line_boxes(_glyphs(s, d), _KEY).selectExpr(*_KEY, "row", *_ROUND, "first", "last"), f'with {_GLYPH} select conv_id, turn, row, {", ".join(_ROUND)}, "first", "last" from ln'),
    "page_geometry": (
        lambda s, d: page_geometry(table(s, d, "documents").selectExpr(*[x.strip() for x in _GEO.split(",")]), 2.0).select("doc_id", "width", "height", "dev_x", "dev_y"),
        """with g as (select doc_id, (595 + doc_id % 100) * (1 + (doc_id % 3) * 0.5::double) w, 842 * (1 + (doc_id % 3) * 0.5::double) h, (90 + doc_id % 7) * (1 + (doc_id % 3) * 0.5::double) px, 180 * (1 + (doc_id % 3) * 0.5::double) py, doc_id % 4 r from documents)
select doc_id, case when r in (1, 3) then h else w end width, case when r in (1, 3) then w else h end height, 2 * case r when 1 then py when 2 then w - px when 3 then h - py else px end dev_x, 2 * case r when 1 then px when 2 then py when 3 then w - px else h - py end dev_y from g""",
    ),
    "delta_mm": (
        lambda s, d: line_boxes(_glyphs(s, d), _KEY).selectExpr(*_KEY, "row", "x0 a_x0", "y0 a_y0", "x1 a_x1", "y1 a_y1", "x0 + row b_x0", "y0 - 1 b_y0", "x1 + 0.5 b_x1", "y1 b_y1").selectExpr(*_KEY, "row", f"round({delta_mm('a', 'b')}, 6) mm"),
        f"with {_GLYPH} select conv_id, turn, row, round(greatest(row, 1) * 25.4 / 72, 6) mm from ln",
    ),
    "line_alignment": (
        lambda s, d: line_alignment(_texts(s, d), _texts(s, d).filter("not (conv_id % 5 = 2 and row = 1)").selectExpr("conv_id", "turn", "row", "x0 + if(conv_id % 6 = 1, 9, 1) x0", "y0", "x1 + 1 x1", "y1", f"{_ALTERED} text"), _KEY),
        rf"""with {_GLYPH}, tx as (select conv_id, turn, row, string_agg(ch, '' order by idx) t from glyph group by all), lt as (select ln.*, t from ln join tx using (conv_id, turn, row)),
na as (select string_agg(distinct ch, '' order by ch) s from (select unnest(string_split(nfc_normalize(t) || 'éüñèöó', '')) ch from tx) where unicode(ch) > 127),
r as (select *, row_number() over (partition by conv_id, turn order by row) k from lt),
o as (select conv_id, turn, x0 + case when conv_id % 6 = 1 then 9 else 1 end x0, y0, x1 + 1 x1, y1, {_ALTERED.replace('text', 't')} t, row_number() over (partition by conv_id, turn order by row) k from lt where not (conv_id % 5 = 2 and row = 1)),
z as (select conv_id, turn, r.k rk, o.k ok, round(greatest(abs(r.x0 - o.x0), abs(r.y0 - o.y0), abs(r.x1 - o.x1), abs(r.y1 - o.y1)) * 25.4 / 72, 6) mm, levenshtein({_BYTES.format(_NORMAL.format('r.t'))}, {_BYTES.format(_NORMAL.format('o.t'))}) e from r full join o using (conv_id, turn, k))
select conv_id, turn, count(rk) n_reference, count(ok) n_output, max(mm) max_mm, cast(coalesce(sum(e), 0) as bigint) edits, case when count(rk) = count(ok) and max(mm) <= 2 then 'PASS' else 'FAIL' end status from z group by conv_id, turn""",
    ),
    "hit_test": (
        lambda s, d: hit_test(_points(s, d).select("conv_id", "point_id", "x", "y"), _annotations(s, d), ["conv_id"], _PAGE),
        f"""with pt as ({_POINT}), a as ({_ANN}), h as (select point_id, max(ord) hit from pt join a on pt.conv_id = a.conv_id and not hidden and x between {_PAGE[0]} and {_PAGE[2]} and y between {_PAGE[1]} and {_PAGE[3]}
  and case when ord % 3 = 1 then y >= y0 and y < y0 + 60 and x >= x0 + (y - y0) / 2 and x < x0 + 100 + (y - y0) / 2 else x between x0 and x1 and y between y0 and y1 end group by point_id)
select conv_id, point_id, hit from pt left join h using (point_id)""",
    ),
    "nearest_line": (
        lambda s, d: nearest_line(_points(s, d), line_boxes(_glyphs(s, d), _KEY), _KEY).selectExpr("point_id", "row", "round(dy, 4) dy", "round(dx, 4) dx"),
        f"with {_GLYPH} select point_id, row, round(dy, 4) dy, round(dx, 4) dx from near where rn = 1",
    ),
    "caret": (
        lambda s, d: caret(nearest_line(_points(s, d), line_boxes(_glyphs(s, d), _KEY), _KEY), _glyphs(s, d), grapheme_starts(_pages(s, d), *_KEY), _KEY).select("point_id", "at"),
        f"with {_GLYPH} select point_id, coalesce(min(idx) filter ((g.x0 + g.x1) / 2 > x), max(idx) + 1) as at from near n join glyph g on n.conv_id = g.conv_id and n.turn = g.turn and n.row = g.row where rn = 1 group by point_id",
    ),
    "word_at": (
        lambda s, d: word_at(nearest_line(_points(s, d), line_boxes(_glyphs(s, d), _KEY), _KEY), _glyphs(s, d), _pages(s, d), _KEY).select("point_id", "start", "end"),
        rf"""with {_GLYPH}, g as (select n.conv_id, n.turn, point_id, idx, row_number() over (partition by point_id order by round(greatest(g.x0 - x, x - g.x1, 0), 9), idx) r2 from near n join glyph g on n.conv_id = g.conv_id and n.turn = g.turn and n.row = g.row and g.x0 is not null where rn = 1),
w0 as (select conv_id, turn, regexp_extract_all(text, '{WORD_DUCK}') words, regexp_split_to_array(text, '{WORD_DUCK}') gaps from conversations),
w1 as (select *, unnest(range(len(words))) k from w0),
w2 as (select conv_id, turn, coalesce(list_sum(list_transform(words[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1:k + 1], lambda x: length(x))), 0) b, length(words[k + 1]) n from w1)
select point_id, cast(b as integer) as start, cast(b + n as integer) as "end" from g left join w2 on g.conv_id = w2.conv_id and g.turn = w2.turn and idx >= b and idx < b + n where r2 = 1""",
    ),
    "merge_text_layer": (
        lambda s, d: merge_text_layer(_words(s, d).select(*_KEY, "id", "x0", "y0", "x1", "y1"), _recognised(s, d), _KEY).select(*_KEY, "id", "layer"),
        f"""with {_GLYPH}, r as (select conv_id, turn, row + 100 id, x0 + 10 x0, y0 - case when row % 2 = 0 then 11.3 else 11.6 end y0, x1 + 10 x1, y0 - case when row % 2 = 0 then 0.3 else 0.6 end y1 from ln)
select conv_id, turn, row id, 'text' layer from ln union all select conv_id, turn, id, 'recognised' from r where not exists (select 1 from ln e where e.conv_id = r.conv_id and e.turn = r.turn and r.x0 < e.x1 + 0.48 and r.x1 > e.x0 - 0.48 and r.y0 < e.y1 + 0.48 and r.y1 > e.y0 - 0.48)""",
    ),
    "array_delta": (
        lambda s, d: array_delta(table(s, d, "embeddings").selectExpr("vec_id", "embedding a", "transform(embedding, (x, i) -> if((i + vec_id) % 17 = 0, x + 1, x)) b"), "a", "b").select("vec_id", "n_changed", "first", "last", "equal"),
        """with e as (select vec_id, list_filter(range(len(embedding)), lambda i: (i + vec_id) % 17 = 0) c from embeddings) select vec_id, cast(len(c) as integer) n_changed, cast(list_min(c) as integer) as first, cast(list_max(c) as integer) as last, len(c) = 0 equal from e""",
    ),
}


def _characters(s, d):
    """The glyphs of each page in reading order; every third row sits a little higher, as superscripts do."""
    return _glyphs(s, d).selectExpr("conv_id", "turn", "idx", "ch", "x0", "y0 + if(col % 9 = 5, 4, 0) y0", "x1", "y1 + if(col % 9 = 5, 4, 0) y1")


def _physical_lines(s, d):
    from quire.operators.measures import physical_lines

    return physical_lines(_characters(s, d), _KEY).selectExpr(*_KEY, "line_no", "text", "first", "last", *_ROUND)


# In this layout a row's boxes touch each other and no other row's, so a line ends before the first inked box of each row.
QUERIES["physical_lines"] = (
    _physical_lines,
    f"""with {_GLYPH}, fi as (select conv_id, turn, row, min(idx) f from glyph where x0 is not null group by all),
ch as (select g.conv_id, g.turn, idx, ch, x0, x1, y0 + case when col % 9 = 5 then 4 else 0 end y0, y1 + case when col % 9 = 5 then 4 else 0 end y1, greatest(sum(case when idx = f then 1 else 0 end) over (partition by g.conv_id, g.turn order by idx), 1) line
  from glyph g left join fi on g.conv_id = fi.conv_id and g.turn = fi.turn and g.row = fi.row),
li as (select conv_id, turn, cast(line - 1 as integer) line_no, string_agg(ch, '' order by idx) as text, min(idx) as first, max(idx) as last, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from ch group by conv_id, turn, line)
select conv_id, turn, line_no, text, "first", "last", {', '.join(_ROUND)} from li where x0 is not null""",
)
