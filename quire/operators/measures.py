"""Statistics over event and sample series: percentiles, peaks, medians, roll-ups, histories and nearest samples."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.asof import asof
from quire.sources.tables import table


def latency_percentiles(samples: DataFrame, group: str, value: str, bins: int = 1024) -> DataFrame:
    """Samples, median, p95 by nearest rank (the ceil(.95 n)-th smallest) and maximum of each group; exact, nulls left out.

    No group is sorted whole: equal-width bins are counted first, and only the distinct values of the bins in which the
    ranks lie are numbered, so that a group with most of the rows is no task of its own.
    """
    rows = samples.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy("_g").agg(F.count("_v").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    at = rows.filter("_v is not null").join(ends.withColumnRenamed("_g", "_h"), same("_g", "_h"))
    binned = at.selectExpr("_g", "_v", f"cast(least({bins} - 1, floor(coalesce(try_divide(_v - least, most - least), 0) * {bins})) as int) _b")
    before = lambda order: F.sum("m").over(Window.partitionBy("_g", *order[:-1]).orderBy(order[-1])) - F.col("m")
    sizes = binned.groupBy("_g", "_b").agg(F.count("*").alias("m")).withColumn("before", before(["_b"]))
    ranks = ends.selectExpr("_g", "n", "explode(array((n + 1) div 2, n div 2 + 1, cast(ceil(0.95 * n) as bigint))) rank").distinct()
    wanted = ranks.withColumnRenamed("_g", "_h").join(sizes, same("_h", "_g")).filter("rank > before and rank <= before + m").select("_g", "_b", "rank", "before")
    near = binned.alias("x").join(wanted.select(F.col("_g").alias("_h"), F.col("_b").alias("_c")).distinct(), F.expr("_g <=> _h and _b = _c"), "left_semi")
    values = near.groupBy("_g", "_b", "_v").agg(F.count("*").alias("m")).withColumn("inside", before(["_b", "_v"])).withColumnRenamed("_g", "_h").withColumnRenamed("_b", "_c")
    found = wanted.join(values, F.expr("_g <=> _h and _b = _c and rank > before + inside and rank <= before + inside + m")).select("_g", "rank", "_v")
    out = ends.join(found.withColumnRenamed("_g", "_h"), same("_g", "_h"), "left").groupBy("_g").agg(
        F.any_value("n").alias("n"), F.expr("(max(if(rank = (n + 1) div 2, _v, null)) + max(if(rank = n div 2 + 1, _v, null))) / 2").alias("median"),
        F.expr("max(if(rank = cast(ceil(0.95 * n) as bigint), _v, null))").alias("p95"), F.any_value("most").alias("most"),
    )
    return out.withColumnRenamed("_g", group)


def peak_memory(samples: DataFrame, group: str, tick: str, value: str) -> DataFrame:
    """The greatest sum over all processes at one tick."""
    return samples.groupBy(group, tick).agg(F.sum(value).alias("s")).groupBy(group).agg(F.max("s").alias("peak"))


def run_medians(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Median and number of each key's runs; see latency_percentiles for how."""
    return latency_percentiles(runs, key, value).select(key, "median", "n")


def check_rollup(checks: DataFrame, group: str) -> DataFrame:
    """PASS if every check passed; the failures are counted."""
    return checks.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("status") != "PASS").alias("failures"), F.when(F.every(F.col("status") == "PASS"), "PASS").otherwise("FAIL").alias("status"))


def single_row_guard(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Keys that don't have exactly one row, with the number they have."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return keys.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def heartbeat_gaps(ticks: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Time in milliseconds from each tick to the one before it; the first tick has none."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, order))
    return ticks.withColumn("_b", before).select(key, order, ((F.unix_micros(ts) - F.unix_micros("_b")) / 1000).alias("gap_ms")).filter("gap_ms is not null")


def view_changes(views: DataFrame, key: str, order: list[str], same: str, keep: int = 200) -> DataFrame:
    """Views that differ from the one before them (`same` is SQL over a column and its predecessor p_column), newest `keep`."""
    w = Window.partitionBy(key).orderBy(*order)
    names = [c for c in views.columns if c != key]
    with_before = views.select(*views.columns, *(F.lag(c).over(w).alias(f"p_{c}") for c in names), F.row_number().over(w).alias("_n"))
    kept = with_before.filter(f"_n = 1 or not coalesce({same}, false)").select(*views.columns)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))).filter(f"_r <= {keep}").drop("_r")


def view_history(views: DataFrame, key: str, order: list[str], same, keep: int = 200) -> DataFrame:
    """Views that differ from the last one kept (same(kept, view), over named tuples), newest `keep`; slow drift counts.

    A fold over each key's views in order. The rows stream through sorted partitions, and a key's state is what it keeps,
    so a key with many views needs no memory for them.
    """

    def fold(frames):
        now, kept = None, deque(maxlen=keep)
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False):
                if now is None or getattr(row, key) != now:
                    done += kept
                    now, kept = getattr(row, key), deque(maxlen=keep)
                if not kept or not same(kept[-1], row):
                    kept.append(row)
            yield pd.DataFrame(done, columns=frame.columns)
        if kept:
            yield pd.DataFrame(list(kept))

    return views.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, views.schema)


def nearest_sample(marks: DataFrame, samples: DataFrame, key: str, tolerance_s: float) -> DataFrame:
    """marks: key, mark_id, ts. samples: key, sample_id, ts. The nearest sample within the tolerance, the earlier on ties, of one time the least id.

    A mark without such a sample stays, with null.
    """
    us = int(tolerance_s * 1e6)
    at = samples.groupBy(key, F.unix_micros("ts").alias("at")).agg(F.min("sample_id").alias("sample_id"))
    met = asof(marks.select(key, "mark_id", F.unix_micros("ts").alias("at")), at, [key], "at", 64 * max(us, 1))
    near = met.selectExpr(key, "mark_id", f"if(at - before.at <= {us}, struct(at - before.at d, before.sample_id), null) b", f"if(after.at - at <= {us}, struct(after.at - at d, after.sample_id), null) a")
    return near.selectExpr(key, "mark_id", "if(a is null or b.d <= a.d, b, a) n").selectExpr(key, "mark_id", "n.sample_id", "n.d / 1000 distance_ms")


_CHARACTER = ["idx", "ch", "x0", "y0", "x1", "y1"]


def _line_walk(key: list[str]):
    """The fold of physical_lines over the sorted pages of a partition; of a page, only the line at hand is kept from one batch to the next.

    Only page starts, line ends and boxes whose heights are not those of the box before them can end a line or widen its
    extent, so Python looks at these alone.
    """

    def walk(batches):
        page, number, low, high = None, 0, None, None  # low is None: no box yet
        held, first, last, bounds = [], None, None, np.full(4, np.nan)  # of the line at hand, from the batches before

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ch = batch.column("ch").cast(pa.string())
            offsets = np.frombuffer(ch.buffers()[1], dtype=np.int32)[ch.offset : ch.offset + n + 1]
            data, shared = ch.buffers()[2], ch.unique().to_pylist()
            ends = pc.is_in(ch, pa.array(["\r", "\n"])).to_numpy(zero_copy_only=False)
            box = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _CHARACTER[2:]])
            inked = pc.is_in(ch, pa.array([c for c in shared if c and c.strip()], pa.string())).to_numpy(zero_copy_only=False) & ~np.isnan(box).any(axis=1)
            box[~inked] = np.nan
            starts = batch.column("_n").to_numpy() == 1
            ink = np.flatnonzero(inked)
            stretch = np.cumsum(ends | starts)[ink]
            news = ink[np.r_[True, (box[ink[1:], 1] != box[ink[:-1], 1]) | (box[ink[1:], 3] != box[ink[:-1], 3]) | (stretch[1:] != stretch[:-1])]] if len(ink) else ink
            at = np.unique(np.concatenate([np.flatnonzero(ends | starts), news]))
            idx = batch.column("idx").to_numpy()
            keys = [batch.column(k) for k in key]
            if page is not None:
                keys = [pa.concat_arrays([p, k]) for p, k in zip(page, keys, strict=True)]
            before = int(page is not None)  # place 0 of keys is the page that goes on from the batch before
            owner, begin, lines = 0, 0, []

            def end(stop):
                nonlocal number, low, first, bounds
                if low is not None:
                    lines.append((owner, number, begin, stop, held[:], first, last, bounds))
                    number, low = number + 1, None
                if begin == 0:
                    held.clear()
                    first, bounds = None, np.full(4, np.nan)

            for i, new, ends_here, y0, y1 in zip(at.tolist(), starts[at].tolist(), ends[at].tolist(), box[at, 1].tolist(), box[at, 3].tolist(), strict=True):
                if new:
                    end(i)
                    owner, begin, number = i + before, i, 0
                if ends_here:
                    end(i)
                    begin = i + 1
                elif y0 == y0:
                    if low is not None and (y1 < low or y0 > high):
                        end(i)
                        begin = i
                    low, high = (y0, y1) if low is None else (min(low, y0), max(high, y1))
            if lines:
                yield out(lines, keys, idx, offsets, data, box)
            if begin:
                held, first, last, bounds = [], None, None, np.full(4, np.nan)
            if begin < n:
                held = [*held, bytes(data[offsets[begin] : offsets[n]]) if data else b""]
                first, last = idx[begin] if first is None else first, idx[n - 1]
                bounds = union(bounds, box[begin:])
            page = [k.slice(owner, 1) for k in keys]
        if low is not None:
            yield out([(0, number, 0, 0, held, first, last, bounds)], page, None, None, None, None)

    def union(bounds, box):
        few = box[~np.isnan(box[:, 0])]
        few = np.vstack([bounds[None], few]) if bounds[0] == bounds[0] else few
        return np.r_[few[:, :2].min(axis=0), few[:, 2:].max(axis=0)] if len(few) else bounds

    def out(lines, keys, idx, offsets, data, box):
        owners, numbers, begins, stops = (np.array([x[k] for x in lines], dtype=np.int64) for k in range(4))
        texts = [(bytes(data[offsets[a] : offsets[b]]) if b > a else b"") for a, b in zip(begins, stops, strict=True)]
        firsts, lasts = ([0] * len(lines), [0] * len(lines)) if idx is None else (idx[np.minimum(begins, len(idx) - 1)], idx[stops - 1])
        edges = np.full((len(lines), 4), np.nan)
        if box is not None:
            whole = stops > begins
            flat = np.column_stack([begins[whole], stops[whole]]).ravel()
            more = np.vstack([box, np.full((1, 4), np.nan)])
            if len(flat):
                edges[whole, :2] = np.fmin.reduceat(more[:, :2], flat)[::2]
                edges[whole, 2:] = np.fmax.reduceat(more[:, 2:], flat)[::2]
        firsts, lasts = list(firsts), list(lasts)
        for j, (_, _, a, b, pieces, first, last, bounds) in enumerate(lines):
            if a == 0 and first is not None:  # it began in a batch before
                texts[j], firsts[j] = b"".join(pieces) + texts[j], first
                lasts[j] = lasts[j] if b else last
                edges[j] = union(bounds, edges[j : j + 1])
        rest = [pa.array(numbers, pa.int32()), pa.array([t.decode() for t in texts], pa.string()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), *(pa.array(edges[:, k]) for k in range(4))]
        return pa.RecordBatch.from_arrays([*(k.take(pa.array(owners)) for k in keys), *rest], [*key, "line_no", "text", "first", "last", "x0", "y0", "x1", "y1"])

    return walk


def physical_lines(characters: DataFrame, key: list[str]) -> DataFrame:
    """characters: key, idx, ch, x0, y0, x1, y1 (null: no box) -> key, line_no, text, first, last and the line's box.

    A line ends at a newline or carriage return, or before an inked box that lies wholly above or below the extent of the
    current line, which each such box widens; boxes that touch belong together, and lines without a box are dropped. The
    extent restarts with each line, so this is a fold over a page. A line's box is the union of its inked boxes.
    """

    # The window brings each page's rows together, in order; where they lie together already, nothing moves.
    rows = characters.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("idx")).alias("_n"), *_CHARACTER)
    keys = ", ".join(f"`{k}` {characters.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInArrow(_line_walk(key), f"{keys}, line_no int, text string, first int, last int, x0 double, y0 double, x1 double, y1 double")


def _views(s, d):
    return table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")


_SAME = "event_type = p_event_type and abs(value - p_value) <= 50"

QUERIES = {
    "latency_percentiles": (
        lambda s, d: latency_percentiles(table(s, d, "events"), "event_type", "value"),
        "with r as (select event_type, value, row_number() over (partition by event_type order by value) rn, count(*) over (partition by event_type) n from events) select event_type, count(*) n, median(value) median, max(value) filter (rn = cast(ceil(0.95 * n) as bigint)) p95, max(value) most from r group by event_type",
    ),
    "peak_memory": (
        lambda s, d: peak_memory(table(s, d, "events").withColumn("tick", F.date_trunc("day", "ts")), "event_type", "tick", "value").withColumn("peak", F.round("peak", 4)),
        "select event_type, round(max(s), 4) peak from (select event_type, date_trunc('day', ts) tick, sum(value) s from events group by all) group by event_type",
    ),
    "run_medians": (lambda s, d: run_medians(table(s, d, "events"), "user_id", "value"), "select user_id, median(value) median, count(value) n from events group by user_id"),
    "check_rollup": (
        lambda s, d: check_rollup(table(s, d, "events").selectExpr("user_id", "if(event_type = 'error' and value > 150, 'FAIL', 'PASS') status"), "user_id"),
        "select user_id, count(*) n, count(*) filter (event_type = 'error' and value > 150) failures, case when count(*) filter (event_type = 'error' and value > 150) = 0 then 'PASS' else 'FAIL' end status from events group by user_id",
    ),
    "single_row_guard": (
        lambda s, d: single_row_guard(table(s, d, "conversations").filter("turn = 3"), "conv_id", table(s, d, "conversations")),
        "select conv_id, count(*) filter (turn = 3) n from conversations group by conv_id having n <> 1",
    ),
    "heartbeat_gaps": (
        lambda s, d: heartbeat_gaps(table(s, d, "events"), "user_id", "ts", "event_id"),
        "select user_id, event_id, gap_ms from (select user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000 gap_ms from events) where gap_ms is not null",
    ),
    "view_history": (
        lambda s, d: view_history(_views(s, d), "user_id", ["ts", "event_id"], lambda a, b: a.event_type == b.event_type and abs(a.value - b.value) <= 50).select("user_id", "event_id"),
        """with recursive e as (select user_id, event_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) rn from events),
k as (select user_id, event_id, event_type, value, rn, true kept from e where rn = 1
  union all select user_id, event_id, if(same, kt, event_type), if(same, kv, value), rn, not same
  from (select e.*, k.event_type kt, k.value kv, coalesce(e.event_type = k.event_type and abs(e.value - k.value) <= 50, false) same from e join k on e.user_id = k.user_id and e.rn = k.rn + 1))
select user_id, event_id from (select *, row_number() over (partition by user_id order by rn desc) r from k where kept) where r <= 200""",
    ),
    "view_changes": (
        lambda s, d: view_changes(_views(s, d), "user_id", ["ts", "event_id"], _SAME).select("user_id", "event_id"),
        f"""with e as (select *, lag(event_type) over w p_event_type, lag(value) over w p_value from events window w as (partition by user_id order by ts, event_id)),
k as (select * from e where not coalesce({_SAME}, false)) select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from k) where r <= 200""",
    ),
    "nearest_sample": (
        lambda s, d: nearest_sample(table(s, d, "events").filter("event_type = 'purchase'").selectExpr("user_id", "event_id mark_id", "ts"), table(s, d, "events").filter("event_type = 'view'").selectExpr("user_id", "event_id sample_id", "ts"), "user_id", 21600),
        """with m as (select user_id, event_id mark_id, epoch_us(ts) at_ from events where event_type = 'purchase'), s as (select user_id, event_id sample_id, epoch_us(ts) s_at from events where event_type = 'view'),
b as (select mark_id, s.sample_id, abs(s_at - at_) d, row_number() over (partition by mark_id order by abs(s_at - at_), s_at, sample_id) rn from m join s on m.user_id = s.user_id and abs(s_at - at_) <= 21600000000)
select user_id, m.mark_id, sample_id, d / 1000 distance_ms from m left join b on m.mark_id = b.mark_id and rn = 1""",
    ),
}
