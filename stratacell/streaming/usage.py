"""Usage counters, admission and the request trace, each for tables and for streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.graph import components
from ..functions.lineage import checkpointed
from ..sources.store_io import Build, read_part

TRACE = "ts double, method string, url string, path string, status int, bytes bigint, elapsed_ms double, error string"


def _counters(questions: DataFrame) -> list:
    """(kind, key) of the counters by the hour: visitors, and hashed addresses where there are any."""
    kinds = [F.struct(F.lit("visitor").alias("kind"), F.col("visitor").cast("string").alias("key"))]
    if "ip" in questions.columns:
        kinds.append(F.struct(F.lit("ip").alias("kind"), F.sha2(F.col("ip"), 256).alias("key")))
    return kinds


def usage_windows(questions: DataFrame) -> DataFrame:
    """(kind, key, window_start, n): visitors and hashed addresses by the hour, the deployment by the day.

    For tables, and for streams in complete mode. Questions without an address count for no address."""
    q = questions.withColumn("at", F.col("at").cast("timestamp"))
    hour, day = F.date_trunc("hour", "at").alias("window_start"), F.date_trunc("day", "at").alias("window_start")
    kinds = F.array(*[F.struct(k["kind"].alias("kind"), k["key"].alias("key"), hour) for k in _counters(q)], F.struct(F.lit("day").alias("kind"), F.lit("all").alias("key"), day))
    return q.select(F.inline(kinds)).where("key is not null").groupBy("kind", "key", "window_start").agg(F.count("*").alias("n"))


def usage_stream(questions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """:func:`usage_windows` of a stream in append mode: a window comes out once the watermark has passed its end, and
    its state goes then; questions later than ``late`` are left out."""
    q = questions.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    count = F.count("*").alias("n")
    hours = q.select("at", F.inline(F.array(*_counters(q)))).where("key is not null").groupBy("kind", "key", F.window("at", "1 hour").alias("w")).agg(count)
    days = q.groupBy(F.window("at", "1 day").alias("w")).agg(count).select(F.lit("day").alias("kind"), F.lit("all").alias("key"), "w", "n")
    return hours.union(days).select("kind", "key", F.col("w.start").alias("window_start"), "n")


def admit_visitors(questions: DataFrame, per_hour: int) -> DataFrame:
    """Whether each question is within its visitor's hour, in order of arrival; refused ones do not count."""
    w = Window.partitionBy("visitor", F.date_trunc("hour", "at")).orderBy("at", "question_id")
    return questions.select("question_id", "visitor", (F.row_number().over(w) <= per_hour).alias("admitted"))


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """One component's questions in order of arrival: each is in if its visitor's hour and its address's hour have room."""
    left: dict = {}
    out = []
    for r in rows.sort_values(["at", "question_id"]).itertuples(index=False):
        keys = [(r.v, r.room_v)] + ([] if r.i is None else [(r.i, r.room_i)])
        ok = bool(r.ok) if r.known else all(left.setdefault(k, room) > 0 for k, room in keys)
        if ok:
            for k, room in keys:
                left[k] = left.get(k, room) - 1
        if not r.known:
            out.append((r.question_id, ok))
    return pd.DataFrame(out, columns=["question_id", "ok"])


def _within_hours(q: DataFrame) -> DataFrame:
    """``q`` (.., room_v, room_i) with ``ok``: whether the visitor's hour and the address's hour both have room, in order of arrival.

    Each limit counts what both admitted, so neither is a rank. A question is in if all earlier ones that may still be in leave
    room, and out if those surely in leave none: that settles most in one pass. What is open hangs together by hours of visitors
    and of addresses that are open; each such component is gone through in order, with the settled questions of its hours, of
    which an hour has no more than its limit. So the number of steps does not depend on how long chains are."""
    before = lambda *by: Window.partitionBy(*by, "hour").orderBy("at", "question_id").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda c, w: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0))
    # a question without an address is bound by its visitor alone
    q = q.withColumn("own", F.struct(F.col("ip"), F.when(F.col("ip").isNull(), F.col("question_id")).alias("alone")))
    v, i, known = before("visitor"), before("own"), F.col("ip").isNotNull()
    # the first of a visitor's hour, as many as it has room for, are sure there; likewise of an address's hour
    first_v, first_i = F.row_number().over(v.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("room_v"), F.row_number().over(i.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("room_i")
    q = q.withColumn("first_v", first_v).withColumn("first_i", ~known | first_i)
    q = q.withColumn("out_v", n(F.col("first_v") & F.col("first_i"), v) >= F.col("room_v")).withColumn("out_i", known & (n(F.col("first_v") & F.col("first_i"), i) >= F.col("room_i")))
    q = checkpointed(q.withColumn("ok", F.when(F.col("first_v") & F.col("first_i"), True).when(F.col("out_v") | F.col("out_i"), False)).drop("out_v", "out_i"))
    if not q.where("ok is null").isEmpty():
        names = q.select("question_id", "at", F.concat_ws("|", F.lit("v"), "visitor", "hour").alias("v"), F.when(known, F.concat_ws("|", F.lit("i"), "ip", "hour")).alias("i"), "room_v", "room_i", "ok", F.col("ok").isNotNull().alias("known"))
        names = checkpointed(names.where("ok is null or ok"))
        opened = names.where("not known")
        roots = components(opened.where("i is not null").select(F.col("v").alias("u"), F.col("i").alias("v")))
        keys = opened.select(F.explode(F.array("v", "i")).alias("node")).where("node is not null").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        touched = names.select("*", F.explode(F.array("v", "i")).alias("node")).join(keys, "node").drop("node").distinct()
        later = touched.groupBy("root").applyInPandas(lambda rows: _in_order(rows), "question_id long, ok boolean")
        q = checkpointed(q.join(later.withColumnRenamed("ok", "then"), "question_id", "left").withColumn("ok", F.coalesce("ok", "then")).drop("then"))
    return q.withColumn("full", n(F.col("ok"), v) >= F.col("room_v")).withColumn("reason", F.when(F.col("full"), "visitor").otherwise("ip"))


def _room(q: DataFrame, counted: DataFrame | None, kind: str, key, window: str, most: int, name: str) -> DataFrame:
    """``q`` with what the limit leaves of ``most`` after the admitted questions that are ``counted``."""
    if counted is None:
        return q.withColumn(name, F.lit(most))
    n = counted.where(F.col("kind") == kind).select(F.col("key").alias("own_key"), F.col("window_start").alias("own_window"), "n")
    return q.join(n, (key == F.col("own_key")) & (F.col(window) == F.col("own_window")), "left").withColumn(name, F.greatest(F.lit(0), F.lit(most) - F.coalesce("n", F.lit(0))).cast("int")).drop("own_key", "own_window", "n")


def admit_coupled(questions: DataFrame, per_visitor_hour: int, per_day: int, per_ip_hour: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(question_id, visitor, verdict): whether each question is admitted under the deployment's day, the visitor's hour
    and, with ``per_ip_hour``, the address's hour; else the first of these that refuses it. Refused questions count nowhere.
    ``counted`` (kind, key, window_start, n), as :func:`usage_windows` has them, are earlier questions that were admitted.

    Until the day is full the other limits decide alone, so the day is full at its ``per_day``-th question that they
    admit, and all later ones are refused: a rank that Spark cuts off before it shuffles, and one row for each day."""
    q = questions.withColumn("hour", F.date_trunc("hour", "at")).withColumn("day", F.date_trunc("day", "at"))
    q = _room(_room(q, counted, "visitor", F.col("visitor").cast("string"), "hour", per_visitor_hour, "room_v"), counted, "day", F.lit("all"), "day", per_day, "room_d")
    if per_ip_hour is None:
        rank = F.row_number().over(Window.partitionBy("visitor", "hour").orderBy("at", "question_id"))
        q = q.withColumn("ok", rank <= F.col("room_v")).withColumn("reason", F.lit("visitor"))
    else:
        q = _room(q, counted, "ip", F.sha2("ip", 256), "hour", per_ip_hour, "room_i")
        q = _within_hours(q.select("question_id", "visitor", "ip", "at", "hour", "day", "room_v", "room_i", "room_d"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("at", "question_id"))
    last = q.where("ok").withColumn("place", place).where(F.col("place") <= per_day).where("place <= room_d").groupBy("day").agg(F.max("place").alias("n"), F.max(F.struct("at", "question_id")).alias("last"))
    late = (F.col("room_d") <= 0) | F.coalesce((F.col("n") >= F.col("room_d")) & (F.struct("at", "question_id") > F.col("last")), F.lit(False))
    return q.join(last, "day", "left").select("question_id", "visitor", F.when(late, "day").when(F.col("ok"), "admitted").otherwise(F.col("reason")).alias("verdict"))


def admit_stream(questions: DataFrame, root: str, checkpoint: str, per_visitor_hour: int, per_day: int, per_ip_hour: int | None = None, late: str = "10 minutes") -> StreamingQuery:
    """:func:`admit_coupled` for a stream of (question_id, visitor, at) and, with ``per_ip_hour``, ip.

    A question is judged once no earlier one can come: when the newest is ``late`` ahead of it. So each batch settles the next
    stretch of time, with the counts of the hours and days that are open, whatever the batches are; questions that come later
    than that are refused as ``late``. The state are those counts and the questions that wait, in one generation with the verdicts: a
    batch that is run again changes nothing. :func:`verdicts` reads them; :func:`close_stream` judges what waits at an end."""
    limits = (per_visitor_hour, per_day, per_ip_hour)

    def judge(batch: DataFrame, batch_id: int) -> None:
        _judge(batch, root, str(batch_id), limits, late)

    return questions.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close_stream(spark, root: str, per_visitor_hour: int, per_day: int, per_ip_hour: int | None = None) -> None:
    """Judges the questions that wait in the state of :func:`admit_stream`, as none will come any more."""
    waiting = read_part(spark, root, "waiting")
    _judge(waiting.where("false"), root, None, (per_visitor_hour, per_day, per_ip_hour), None)


def _judge(batch: DataFrame, root: str, batch_id: str | None, limits: tuple, late: str | None) -> None:
    spark = batch.sparkSession
    columns = ["question_id", "visitor", "at", *["ip"] * (limits[2] is not None)]
    with Build(spark, root) as b:
        there = b.live.get(("waiting", ""))
        done = there["source"].split("|") if there else ["-1", "1970-01-01 00:00:00"]
        if batch_id is not None and int(done[0]) >= int(batch_id):
            return
        q = batch.select(*[F.col(c).cast("timestamp") if c == "at" else F.col(c) for c in columns])
        until, seen = F.lit(done[1]).cast("timestamp"), f"verdicts-{batch_id or 'end'}"
        new = checkpointed(q.withColumn("late", F.col("at") < until))
        all_open = new.where("not late").drop("late")
        if there:
            all_open = all_open.unionByName(b.read("waiting"))
        newest = all_open.agg((F.max("at") - F.expr(f"interval {late}")) if late else F.max("at") + F.expr("interval 1 second")).first()[0]
        now = max(done[1], str(newest)) if newest is not None else done[1]
        ready, end = all_open.where(F.col("at") < F.lit(now).cast("timestamp")), F.lit(now).cast("timestamp")
        counted = b.read("counters") if ("counters", "") in b.live else None
        ready = checkpointed(ready)
        verdicts_now = checkpointed(admit_coupled(ready, *limits, counted=counted))
        admitted = usage_windows(ready.join(verdicts_now.where("verdict = 'admitted'").select("question_id"), "question_id", "left_semi"))
        counts = admitted if counted is None else admitted.unionByName(counted)
        # an hour or a day that has passed is over
        live = F.when(F.col("kind") == "day", F.date_trunc("day", end)).otherwise(F.date_trunc("hour", end))
        counts = counts.where(F.col("window_start") >= live).groupBy("kind", "key", "window_start").agg(F.sum("n").alias("n"))
        refused = new.where("late").select("question_id", "visitor", F.lit("late").alias("verdict"))
        b.put("verdicts", verdicts_now.unionByName(refused), seen, overwrite=True)
        b.put("counters", counts, overwrite=True)
        b.put("waiting", all_open.where(F.col("at") >= end), overwrite=True, source=f"{batch_id or done[0]}|{now}")


def verdicts(spark, root: str) -> DataFrame:
    """(question_id, visitor, verdict) of all questions that :func:`admit_stream` has judged so far."""
    return read_part(spark, root, "verdicts", None)


def usage_updates(questions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """:func:`usage_windows` of a stream in update mode: a count shows as soon as it changes, before its window ends, and a question
    that is delivered again within ``late`` counts once. Counts only grow, so the largest of a window is the latest: :func:`latest`."""
    q = questions.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["question_id"])
    count = F.count("*").alias("n")
    hours = q.select("at", F.inline(F.array(*_counters(q)))).where("key is not null").groupBy("kind", "key", F.window("at", "1 hour").alias("w")).agg(count)
    days = q.groupBy(F.window("at", "1 day").alias("w")).agg(count).select(F.lit("day").alias("kind"), F.lit("all").alias("key"), "w", "n")
    return hours.union(days).select("kind", "key", F.col("w.start").alias("window_start"), "n")


def latest(updates: DataFrame) -> DataFrame:
    """The counts of all windows from the rows that :func:`usage_updates` has put out."""
    return updates.groupBy("kind", "key", "window_start").agg(F.max("n").alias("n"))


def trace_summary(trace: DataFrame) -> DataFrame:
    """Requests, errors, bytes and time; failed requests count, missing sizes do not."""
    return trace.agg(F.count("*").alias("requests"), F.count("error").alias("errors"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("elapsed_ms"), F.lit(0.0)).alias("elapsed_ms"))


def read_trace(spark, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(TRACE).json(path)
