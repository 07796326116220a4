"""Event streams: debounced queries, latest generations, job progress, timed-out jobs and edit-log replay.

Each operator works on a stream and, by the same function where Spark allows it, on a table; the registered queries run
the table form so that SQL can check it, and tests hold the stream form against it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.sources.sinks import shared_folder
from quire.sources.tables import SCHEMAS, table


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """The events table, which is one file or more in the folder, as a stream of files."""
    return spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def debounce_queries(edits: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """edits: user_id, event_id, ts, query, submit. After a silence of `gap`, the latest text of a user is searched.

    Blank text cancels; a submit is searched at once, whatever follows, and not again after the silence. On a stream,
    give a watermark: submits pass on at once, settled texts when it has passed the silence.
    """
    if watermark:
        edits = edits.withWatermark("ts", watermark)
    last = F.max_by(F.struct("query", "submit"), F.struct("ts", "event_id")).alias("last")
    settled = edits.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(last, F.max("ts").alias("at"))
    settled = settled.filter(r"last.query rlike '(?U)\\S' and not last.submit").select("user_id", "last.query", "at")
    submitted = edits.filter(r"submit and query rlike '(?U)\\S'").select("user_id", "query", F.col("ts").alias("at"))
    return settled.unionByName(submitted)


def latest_generation(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Only the results of each key's newest generation (a table; see stream_latest_generation for a stream)."""
    newest = results.groupBy(key).agg(F.max(generation).alias("_g"))
    return results.join(newest, key).filter(F.col(generation) == F.col("_g")).drop("_g")


def stream_latest_generation(results: DataFrame, watermark: str = "1 day") -> DataFrame:
    """results: user_id, generation, event_id, ts. Passes on what is not older than the newest generation its key has shown so far.

    A key's state goes when the watermark has passed its last result by as long again as the watermark's delay.
    """
    stay = pd.Timedelta(watermark)

    def keep(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        newest, last = state.get if state.exists else (-1, 0)
        for frame in frames:
            newest, last = max(newest, int(frame["generation"].max())), max(last, int(frame["ts"].max().timestamp() * 1000))
            kept = frame[frame["generation"] >= newest]
            yield pd.DataFrame({"user_id": kept["user_id"], "generation": kept["generation"], "event_id": kept["event_id"]})
        state.update((newest, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(stay.total_seconds() * 1000))

    keyed = results.withWatermark("ts", watermark).groupBy("user_id")
    return keyed.applyInPandasWithState(keep, "user_id long, generation long, event_id long", "newest long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def job_progress(lines: DataFrame) -> DataFrame:
    """lines: job, ts, payload (JSON with done and total). The latest done and total of each job; broken lines don't count."""
    parsed = lines.select("job", "ts", F.from_json("payload", "done bigint, total bigint").alias("p")).filter("p.done is not null and p.total is not null")
    return parsed.groupBy("job").agg(F.max_by(F.struct("p.done", "p.total"), F.struct("ts", "p.done")).alias("p")).select("job", "p.done", "p.total")


def timed_out_jobs(starts: DataFrame, ends: DataFrame, limit: str, watermark: str | None = None) -> DataFrame:
    """starts: job, started. ends: job, ended. Jobs without an end within the limit of their start.

    On streams the outer interval join gives a job once the watermark has passed its limit.
    """
    if watermark:
        starts, ends = starts.withWatermark("started", watermark), ends.withWatermark("ended", watermark)
    e = ends.withColumnRenamed("job", "end_job")
    within = F.expr(f"job = end_job and ended >= started and ended <= started + interval {limit}")
    return starts.join(e, within, "left_outer").filter("end_job is null").select("job", "started")


_STATE = ["cursor", "last", "saved", "revision", "dirty"]
OP = "case event_type when 'click' then 'commit' when 'view' then 'undo' when 'purchase' then 'redo' when 'signup' then 'save' else 'none' end"


def apply_edit(state: tuple[int, int, int, int], op: str) -> tuple[int, int, int, int]:
    """One step of the replay on (cursor, last, saved, revision)."""
    cursor, last, saved, revision = state
    if op == "commit":
        return cursor + 1, cursor + 1, -1 if saved > cursor else saved, revision + 1
    if op == "undo":
        return max(cursor - 1, 0), last, saved, revision + (cursor > 0)
    if op == "redo":
        return min(cursor + 1, last), last, saved, revision + (cursor < last)
    if op == "save":
        return cursor, last, cursor, revision
    return state


def edit_log_replay(log: DataFrame, key: str) -> DataFrame:
    """log: key, ts, event_id, op. State of each document after its log: a commit drops the redo tail, and a save beyond it is lost.

    A fold over sorted partitions: what is held of a document is its state, however long its log. A null key is a document too.
    """

    def fold(frames):
        now, state, done = None, None, []
        row = lambda: (now[0], *state, state[2] != state[0])
        for frame in frames:
            for k, op in zip(frame[key].astype(object).where(frame[key].notna(), None), frame["op"], strict=True):
                if now != (k,):
                    done += [row()] if now else []
                    now, state = (k,), (0, 0, 0, 0)
                state = apply_edit(state, op)
            yield pd.DataFrame(done, columns=[key, *_STATE])
            done = []
        if now:
            yield pd.DataFrame([row()], columns=[key, *_STATE])

    kind = log.schema[key].dataType.simpleString()
    ordered = log.select(key, "ts", "event_id", "op").repartition(key).sortWithinPartitions(key, "ts", "event_id")
    return ordered.mapInPandas(fold, f"{key} {kind}, cursor int, last int, saved int, revision int, dirty boolean")


def stream_edit_log_replay(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """log: user_id, ts, event_id, op. The replay on a stream, in the order of time and id whatever the order of arrival.

    Edits wait in the state until the watermark has passed them and are then applied for good; each batch passes on the
    state as it is with the waiting edits applied too. What comes later than the watermark allows is dropped by Spark.
    """

    def replay(key, frames, state: GroupState):
        *done, at, ids, ops = state.get if state.exists else (0, 0, 0, 0, [], [], [])
        edits = list(zip(at, ids, ops, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                edits += zip(frame["ts"].map(lambda t: t.value // 1000), frame["event_id"], frame["op"], strict=True)
        edits.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        done = tuple(done)
        while edits and edits[0][0] < passed:
            done = apply_edit(done, edits.pop(0)[2])
        now = done
        for *_, op in edits:
            now = apply_edit(now, op)
        state.update((*(int(x) for x in done), [int(t) for t, _, _ in edits], [int(i) for _, i, _ in edits], [o for *_, o in edits]))
        if edits:
            state.setTimeoutTimestamp(max(edits[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if not state.hasTimedOut:
            yield pd.DataFrame([(key[0], *now, now[2] != now[0])], columns=["user_id", "cursor", "last", "saved", "revision", "dirty"])

    return log.withWatermark("ts", watermark).groupBy("user_id").applyInPandasWithState(
        replay, "user_id long, cursor int, last int, saved int, revision int, dirty boolean",
        "cursor int, last int, saved int, revision int, at array<bigint>, ids array<bigint>, ops array<string>", "update", GroupStateTimeout.EventTimeTimeout,
    )


def batch_writer(path: str):
    """For foreachBatch: each batch overwrites its own folder, so that one written again after a failure adds no rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote, batch by batch, under the shared folder."""
    spark = stream.sparkSession
    base = shared_folder(spark)

    stream.writeStream.outputMode(mode).foreachBatch(batch_writer(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")


_EDIT = "user_id, event_id, ts, case when event_type = 'error' then ' ' else event_type end query, event_type = 'purchase' submit"


def _edits(df):
    return df.selectExpr("user_id", "event_id", "ts", "if(event_type = 'error', ' ', event_type) query", "event_type = 'purchase' submit")


def _generations(df):
    return df.selectExpr("user_id", "cast(get_json_object(props, '$.k') as bigint) div 10 generation", "event_id")


def _replayed_stream(s, d):
    """The events' edit log as a stream; the last state of each document is its result."""
    log = event_stream(s, d)
    states = drain(stream_edit_log_replay(log.selectExpr("user_id", "ts", "event_id", f"{OP} op")), "update")
    return states.groupBy("user_id").agg(F.max_by(F.struct("cursor", "last", "saved", "revision", "dirty"), "batch").alias("s")).select("user_id", "s.*")


_REPLAY_SQL = f"""with recursive e as (select user_id, {OP} op, row_number() over (partition by user_id order by ts, event_id) rn from events),
w as (select user_id, 0 rn, 0 cursor_, 0 last_, 0 saved, 0 revision from e where rn = 1 union all
  select e.user_id, e.rn, case op when 'commit' then cursor_ + 1 when 'undo' then greatest(cursor_ - 1, 0) when 'redo' then least(cursor_ + 1, last_) else cursor_ end,
    case op when 'commit' then cursor_ + 1 else last_ end, case op when 'commit' then case when saved > cursor_ then -1 else saved end when 'save' then cursor_ else saved end,
    revision + case when op = 'commit' or op = 'undo' and cursor_ > 0 or op = 'redo' and cursor_ < last_ then 1 else 0 end
  from w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
select user_id, cursor_ as "cursor", last_ as "last", saved, revision, saved <> cursor_ dirty from (select *, max(rn) over (partition by user_id) m from w) where rn = m"""

QUERIES = {
    "debounce_queries": (
        lambda s, d: debounce_queries(_edits(table(s, d, "events")), "6 hours"),
        rf"""with e as (select {_EDIT} from events), b as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hours then 1 else 0 end new from e),
g as (select *, sum(new) over (partition by user_id order by ts, event_id) n from b), l as (select *, row_number() over (partition by user_id, n order by ts desc, event_id desc) r from g)
select user_id, query, ts as "at" from l where r = 1 and regexp_matches(query, '\S') union select user_id, query, ts from e where submit and regexp_matches(query, '\S')""",
    ),
    "latest_generation": (
        lambda s, d: latest_generation(_generations(table(s, d, "events")), "user_id", "generation"),
        "with g as (select user_id, cast(json_extract(props, '$.k') as bigint) // 10 generation, event_id from events) select user_id, generation, event_id from g where generation = (select max(generation) from g h where h.user_id = g.user_id)",
    ),
    "job_progress": (
        lambda s, d: job_progress(table(s, d, "events").selectExpr("user_id job", "ts", "if(event_type = 'error', '{\"done\": ', concat('{\"done\": ', get_json_object(props, '$.k'), ', \"total\": 100}')) payload")),
        "select user_id job, arg_max(cast(json_extract(props, '$.k') as bigint), ts) done, cast(100 as bigint) total from events where event_type <> 'error' group by user_id",
    ),
    "timed_out_jobs": (
        lambda s, d: timed_out_jobs(table(s, d, "events").filter("event_type = 'click'").selectExpr("user_id job", "ts started"), table(s, d, "events").filter("event_type = 'purchase'").selectExpr("user_id job", "ts ended"), "12 hours"),
        "select user_id job, ts started from events a where event_type = 'click' and not exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 12 hours)",
    ),
    "edit_log_replay": (lambda s, d: edit_log_replay(table(s, d, "events").selectExpr("user_id", "ts", "event_id", f"{OP} op"), "user_id"), _REPLAY_SQL),
    "edit_log_replay_stream": (_replayed_stream, _REPLAY_SQL),
}


def _progress_source(s, d):
    """Progress records written as JSON lines, read back as a stream of files, and the latest state of each job."""
    from quire.sources.tables import progress_stream

    path = f"{shared_folder(s)}/progress"
    jobs = table(s, d, "events").filter("event_type <> 'error'")
    jobs.selectExpr("cast(user_id as string) job", "cast(get_json_object(props, '$.k') as bigint) done", "100L total", "event_id page", "event_type status", "ts").write.json(path)
    lines = drain(progress_stream(s, path))
    return lines.groupBy("job").agg(F.max_by(F.struct("done", "total"), F.struct("ts", "done")).alias("p")).selectExpr("cast(job as bigint) job", "p.done", "p.total")


QUERIES["progress_source"] = (_progress_source, QUERIES["job_progress"][1])
