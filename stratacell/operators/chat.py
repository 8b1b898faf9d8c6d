"""Threads, messages, feedback and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import redacted, redacted_result, thread_title


def thread_list(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads with their number of messages, 0 included, newest first."""
    n = messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"))
    return threads.join(n, "thread_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0))).orderBy(F.desc("updated_at"), "thread_id")


def thread_detail(messages: DataFrame, feedback: DataFrame, user: str) -> DataFrame:
    """Messages in order, each with this user's own feedback if there is any."""
    own = feedback.where(F.col("user_sub") == user).select("message_id", "rating")
    return messages.join(own, "message_id", "left").orderBy("thread_id", "turn")


def titles(messages: DataFrame) -> DataFrame:
    """A title for each thread, from its first message of a user."""
    first = messages.where("role = 'user'").groupBy("thread_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("thread_id", thread_title(F.col("text")).alias("title"))


#: Fixed limits of a turn without sign-in: messages, characters of one and of all, and characters of the view state's JSON.
MOST_MESSAGES, MOST_CHARS, MOST_TOTAL, MOST_VIEW = 30, 4_000, 40_000, 4_096


def oversized(messages: DataFrame, most: int = MOST_MESSAGES, longest: int = MOST_CHARS, total: int = MOST_TOTAL, views: DataFrame | None = None, view: int = MOST_VIEW) -> DataFrame:
    """Sizes of each thread's turn, and whether it is over a limit. ``views`` (thread_id, view_state): JSON, null for none."""
    s = messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("total"))
    over = (F.col("n_messages") > most) | (F.col("longest") > longest) | (F.col("total") > total)
    if views is None:
        return s.withColumn("oversized", over)
    v = views.groupBy("thread_id").agg(F.max(F.length("view_state")).alias("view_size"))
    return s.join(v, "thread_id", "left").withColumn("oversized", over | F.coalesce(F.col("view_size") > view, F.lit(False)))


def alternating(messages: DataFrame) -> DataFrame:
    """Whether user and assistant take turns, from the user to the user; other roles do not count."""
    at = F.row_number().over(Window.partitionBy("thread_id").orderBy("turn"))
    own = messages.where(F.col("role").isin("user", "assistant")).withColumn("turns_user", at % 2 == 1)
    right = F.bool_and((F.col("role") == "user") == F.col("turns_user"))
    return own.groupBy("thread_id").agg((right & (F.max_by("role", "turn") == "user")).alias("ok"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last word of each user on each message, and when they first spoke."""
    return feedback.groupBy("message_id", "user_sub").agg(F.max_by("rating", F.struct("at", "seq")).alias("rating"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def claim_history(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows of anonymous users under the name that they signed in with; ``moved`` marks them. ``claims`` (anon_id, user_sub)."""
    c = claims.select(F.col("anon_id"), F.col("user_sub").alias("signed_in"))
    j = rows.join(c, rows["user_sub"] == c["anon_id"], "left")
    return j.select(*[rows[k] for k in rows.columns if k != "user_sub"], F.coalesce("signed_in", rows["user_sub"]).alias("user_sub"), F.col("signed_in").isNotNull().alias("moved"))


def redact_private(messages: DataFrame, public: DataFrame) -> DataFrame:
    """Texts of public threads, placeholders for the others; rows of the role ``tool`` are results. ``public`` (thread_id)."""
    p = public.select("thread_id", F.lit(True).alias("public")).distinct()
    j = messages.join(p, "thread_id", "left")
    seen = F.coalesce("public", F.lit(False))
    text = F.when(F.col("role") == "tool", redacted_result(F.col("text"), seen)).otherwise(redacted(F.col("text"), seen))
    return j.withColumn("text", text).drop("public")


def token_usage(generations: DataFrame) -> DataFrame:
    return generations.groupBy("turn_id").agg(F.count("*").alias("generations"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


RUN = "run int, date string, status string, dataset struct<n_obs:bigint,n_vars:bigint>, performance struct<total_time_s:int,output_size_gb:double,compression_ratio:double>"


def read_runs(spark, path: str) -> DataFrame:
    return spark.read.schema(RUN).option("multiLine", True).json(path)


def next_run(runs: DataFrame) -> int:
    return (runs.agg(F.max("run")).first()[0] or 0) + 1


def merge_runs(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Runs with the non-null fields of their updates, nested fields one by one."""
    u = updates.select("run", F.struct(*[c for c in updates.columns if c != "run"]).alias("u"))
    j = runs.join(u, "run", "left")
    for f in runs.schema.fields:
        if f.name in updates.columns and f.name != "run":
            new = F.col(f"u.{f.name}")
            if f.dataType.typeName() == "struct":
                merged = F.struct(*[F.coalesce(new[n], F.col(f.name)[n]).alias(n) for n in f.dataType.names])
            else:
                merged = F.coalesce(new, F.col(f.name))
            j = j.withColumn(f.name, merged)
    return j.drop("u")


def append_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """``runs`` and one more, with the next number."""
    return runs.unionByName(new.withColumn("run", F.lit(next_run(runs))), allowMissingColumns=True)


def run_summary(runs: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return runs.agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.min(F.when(done, F.col("seconds"))).alias("fastest"), F.max(F.when(done, F.col("ratio"))).alias("best_ratio"))
