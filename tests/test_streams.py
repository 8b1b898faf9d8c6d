"""Streams beside the same work on tables, whatever the batches are."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from stratacell import queries
from stratacell.operators import catalog
from stratacell.sources import store_io
from stratacell.streaming import progress, usage
from tests.test_operators import _admit_one_by_one

START = datetime.datetime(2024, 1, 1)


def _files(folder, batches):
    """A file for each batch, to be read in this order."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k,) * 2)


def _stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(str(folder))


@pytest.mark.parametrize(("limits", "split", "files"), [((2, 40, 3), 5, 1), ((2, 40, None), 3, 2)])
def test_admission_of_a_stream(spark, tmp_path, limits, split, files):
    """Out of order by less than the tolerance, cut into batches anywhere: the verdicts are those of one table; the state stays small."""
    rng = random.Random(str(limits))
    rows = sorted(((k, rng.randrange(6), rng.choice([None, *"abc"]), START + datetime.timedelta(minutes=rng.randrange(1800))) for k in range(240)), key=lambda r: r[3] + datetime.timedelta(minutes=rng.randrange(9)))
    said = [{"question_id": k, "visitor": v, "ip": ip, "at": str(at)} for k, v, ip, at in rows]
    cuts = sorted(rng.sample(range(1, len(rows)), split - 1))
    _files(tmp_path / "in", [said[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)])
    root = str(tmp_path / "state")
    schema = "question_id long, visitor long, ip string, at timestamp"
    usage.admit_stream(_stream(spark, tmp_path / "in", schema, files), root, str(tmp_path / "c"), *limits).awaitTermination(300)
    waiting, counters = (store_io.read_part(spark, root, p) for p in ("waiting", "counters"))
    newest = max(r[3] for r in rows)
    assert waiting.count() == sum(r[3] >= newest - datetime.timedelta(minutes=10) for r in rows)
    assert counters.where(F.col("window_start") < F.lit(str(newest.date()))).count() == 0
    before = {r["question_id"]: r["verdict"] for r in usage.verdicts(spark, root).collect()}
    # a batch that is run again changes nothing
    usage._judge(spark.createDataFrame([rows[0]], schema), root, "0", limits, "10 minutes")
    assert {r["question_id"]: r["verdict"] for r in usage.verdicts(spark, root).collect()} == before
    usage.close_stream(spark, root, *limits)
    got = usage.verdicts(spark, root).collect()
    want = _admit_one_by_one([(k, v, ip if limits[2] else None, at) for k, v, ip, at in rows], limits[0], limits[1], limits[2] or 0)
    assert len(got) == len(rows) and {r["question_id"]: r["verdict"] for r in got} == want
    usage._judge(spark.createDataFrame([(999, 1, "a", START)], schema), root, "99", limits, "10 minutes")
    assert [r["verdict"] for r in usage.verdicts(spark, root).where("question_id = 999").collect()] == ["late"]


def test_long_chains_of_limits(spark):
    """Each question decides the next one: visitors and addresses take turns in being full."""
    rows = []
    for k in range(60):
        rows += [(2 * k, k, f"a{k}", START + datetime.timedelta(seconds=2 * k)), (2 * k + 1, k, f"a{k + 1}", START + datetime.timedelta(seconds=2 * k + 1))]
    q = spark.createDataFrame(rows, "question_id long, visitor long, ip string, at timestamp")
    for limits in ((1, 1000, 1), (2, 1000, 1), (1, 30, 2)):
        assert {r["question_id"]: r["verdict"] for r in usage.admit_coupled(q, *limits).collect()} == _admit_one_by_one(rows, *limits)


def test_earlier_questions_count(spark):
    rows = [(k, k % 3, "a" if k % 2 else None, START + datetime.timedelta(minutes=7 * k)) for k in range(30)]
    q = spark.createDataFrame(rows, "question_id long, visitor long, ip string, at timestamp")
    want = _admit_one_by_one(rows, 2, 9, 2)
    first, rest = q.where("question_id < 13"), q.where("question_id >= 13")
    ids = [k for k, v in want.items() if v == "admitted" and k < 13]
    counted = usage.usage_windows(first.where(F.col("question_id").isin(ids)))
    assert {r["question_id"]: r["verdict"] for r in usage.admit_coupled(rest, 2, 9, 2, counted=counted).collect()} == {k: v for k, v in want.items() if k >= 13}


def test_counters_in_update_mode(spark, tmp_path):
    """Counts show before their hour ends, and a question that comes again counts once."""
    row = lambda k, minute: {"question_id": k, "visitor": k % 2, "ip": "a" if k else None, "at": str(START + datetime.timedelta(minutes=minute))}
    _files(tmp_path / "in", [[row(0, 1), row(1, 2)], [row(1, 2), row(2, 5), row(2, 5)], [row(3, 70), row(2, 5)]])
    schema = "question_id long, visitor long, ip string, at timestamp"
    usage.usage_updates(_stream(spark, tmp_path / "in", schema)).writeStream.outputMode("update").format("memory").queryName("updates").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(240)
    rows = lambda d: sorted(map(tuple, d.select("kind", "key", "window_start", "n").collect()))
    batch = usage.usage_windows(spark.read.schema(schema).json(str(tmp_path / "in")).dropDuplicates(["question_id"]))
    assert rows(usage.latest(spark.table("updates"))) == rows(batch)
    assert [r["n"] for r in spark.table("updates").where("kind = 'day'").orderBy("n").collect()] == [2, 3, 4]


def test_harvests_by_stream(spark, tmp_path):
    """Successes, failures and clearings in any order of batches, and a batch that is run again."""
    rng = random.Random(4)
    rows = [{"dataset_id": rng.randrange(5), "at": at, "status": rng.choice(["ok", "ok", "failed", "clear"]), "value": f"v{at}", "error": rng.choice([None, "e"])} for at in range(60)]
    want = None
    for order in range(2):
        mixed = rng.sample(rows, len(rows))
        _files(tmp_path / f"in{order}", [mixed[:7], mixed[7:31], mixed[31:]])
        root = str(tmp_path / f"state{order}")
        schema = "dataset_id long, at long, status string, value string, error string"
        catalog.harvest_stream(_stream(spark, tmp_path / f"in{order}", schema), root, str(tmp_path / f"c{order}")).awaitTermination(240)
        got = sorted(map(tuple, catalog.harvests(spark, root).collect()), key=str)
        want = want or sorted(map(tuple, catalog.merge_harvests(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).select("dataset_id", "value", "fetched_at", "attempted_at", "status", "error").collect()), key=str)
        assert got == want
    live = store_io.log(spark, root)
    assert [r["source"] for r in live] == ["2"] and live[0]["generation"] == 3


def test_log_of_streams(spark, tmp_path):
    _files(tmp_path / "in", [[{"a": 1}], [{"a": 2}, {"a": 0}]])
    with progress.RunLog(spark, str(tmp_path / "log")):
        good = _stream(spark, tmp_path / "in", "a int").writeStream.format("noop").queryName("good").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
        good.awaitTermination(120)
        bad = _stream(spark, tmp_path / "in", "a int").select(F.when(F.col("a") == 0, F.raise_error(F.lit("no luck"))).otherwise(F.lit(""))).writeStream.format("noop").queryName("bad").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
        with pytest.raises(Exception, match="no luck"):
            bad.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    got = {r["name"]: r for r in progress.stream_summary(progress.read_events(spark, str(tmp_path / "log"))).collect()}
    assert (got["good"]["status"], got["good"]["batches"], got["good"]["rows"]) == ("completed", 2, 3)
    assert got["bad"]["status"] == "failed" and "no luck" in got["bad"]["error"]


def test_a_batch_is_written_by_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """Each third of the rows is a batch of its own, in several files of about equal rows; few rows are in one."""
    for k, (n, task_rows, want) in enumerate(((15_000, 1_500, 4), (900, 100, 1))):
        monkeypatch.setattr("stratacell.sources.store.TASK_ROWS", task_rows)
        rows = spark.range(n, numPartitions=3).select("id", (F.col("id") * 10 + 5).alias("at"))
        stream = queries._as_stream(spark, rows, str(tmp_path / f"in{k}"), "at")
        batches = {}
        keep = lambda batch, i: batches.update({i: batch.withColumn("file", F.input_file_name()).groupBy("file").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect()})  # noqa: B023, E731
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start().awaitTermination(120)
        assert [len(batches[i]) for i in sorted(batches)] == [want] * 3
        assert sum(r["n"] for b in batches.values() for r in b) == n
        assert all(r["n"] <= 2 * max(task_rows, n // 3 // want) for b in batches.values() for r in b)
        assert all(max(r["high"] for r in batches[i]) < min(r["low"] for r in batches[i + 1]) for i in (0, 1))
