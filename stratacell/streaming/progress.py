"""What streams do, as rows of a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENTS = "run string, name string, event string, at string, batch long, rows long, error string"


class RunLog(StreamingQueryListener):
    """Appends a row to the log in ``path`` when a stream starts, after each batch, and when it ends: ``completed``, or ``failed`` with
    the error. ``with RunLog(spark, path): ..`` hears all streams of the session that run meanwhile."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.names = spark, path, {}

    def _add(self, run, event: str, at: str | None = None, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        row = (str(run), self.names.get(str(run)), event, at, batch, rows, error)
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._add(event.runId, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(p.runId, "progress", p.timestamp, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(event.runId, "failed" if event.exception else "completed", error=event.exception)

    def __enter__(self) -> RunLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def stream_summary(events: DataFrame) -> DataFrame:
    """(run, name, status, batches, rows, error): one row for each run; a run without an end is ``running``."""
    end = F.max(F.when(F.col("event").isin("completed", "failed"), F.struct("event", "error")))
    out = events.groupBy("run").agg(F.max("name").alias("name"), end.alias("end"), F.count_distinct(F.when(F.col("event") == "progress", F.col("batch"))).alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return out.select("run", "name", F.coalesce("end.event", F.lit("running")).alias("status"), "batches", "rows", "end.error")
