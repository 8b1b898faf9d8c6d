"""What a task's arrays take follows a small slice, and not the batch that Spark sends or the lot that is packed together."""

import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stratacell.llm import near_dedup, packing, quality_model, textnum

TEXTS = [" ".join(f"w{(i * k) % 997}" for k in range(600)) for i in range(2000)]


class Given:
    """In place of a data frame: a mapper goes over one large batch, and what it returns is dropped."""

    def __init__(self):
        self.batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], ["doc_id", "text"])

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return sum(b.num_rows for b in run(iter([self.batch])))


def _megabytes(work) -> tuple[float, float]:
    """At the peak, and what is left afterwards."""
    tracemalloc.start()
    try:
        work()
        return tuple(x / (1 << 20) for x in reversed(tracemalloc.get_traced_memory()))
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("work", [lambda d: quality_model.features(d), lambda d: sum(1 for _ in near_dedup._sets(iter([d.batch])))])
def test_slices_are_small(spark, work):
    given = Given()
    assert given.batch.nbytes > 5 << 20
    peak, _ = _megabytes(lambda: work(given))
    assert peak < 40


def test_scores_of_many_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 24))
    m = quality_model.Model(x.mean(0), x.std(0), rng.normal(0, 0.2, (24, 256)), rng.uniform(0, 6, 256), rng.normal(0, 0.1, 257), np.array([-0.5, 1.5]), np.array([0.0, 1.0]))
    want = np.clip(m.cosines(x) @ m.beta, -0.5, 1.5)
    peak, _ = _megabytes(lambda: np.testing.assert_allclose(m.raw_score(x), want, atol=1e-12))
    assert peak < 20
    assert m.raw_score(x[:0]).shape == (0,)


def test_powers_of_a_long_text_are_not_kept():
    data = np.full(5 << 20, 97, np.uint8)
    _, left = _megabytes(lambda: textnum.hashes(data, np.array([0]), np.array([len(data)])))
    assert left < 20
    word = np.frombuffer(b"a word", np.uint8)
    assert (textnum.hashes(np.r_[data, word], np.array([len(data)]), np.array([len(data) + 6])) == textnum.hashes(word, np.array([0]), np.array([6]))).all()


def test_a_lot_leaves_in_batches():
    ids = np.arange(2048, dtype="<u4").tobytes()
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, n, i, ids[: 4 * n]) for i, n in enumerate(rng.integers(1, 2049, 3000).tolist())]
    batches = list(packing.lot_batches(rows, 7 << 36, 2048))
    assert len(batches) > 5 and max(b.nbytes for b in batches) < 2 << 20
    whole = pa.Table.from_batches(batches).to_pydict()
    assert [*zip(*(whole[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")))] == rows
    bins, place, fill = packing.best_fit(np.array([r[3] for r in rows]), 2048)
    assert whole["bin"] == ((7 << 36) + bins).tolist() and whole["place"] == place.tolist() and whole["fill"] == fill[bins].tolist()


#: A session of its own, with a heap of 512 MB: a text of 12,000 words is one item again and again, so each token begins hits.
LONG = """
import sys
from pyspark.sql import SparkSession
from stratacell.llm import decontam
spark = (
    SparkSession.builder.master("local[1]").config("spark.driver.memory", "512m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.local.dir", sys.argv[1]).config("spark.sql.warehouse.dir", sys.argv[1]).config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
)
item = " ".join(f"w{i}" for i in range(40))
docs = spark.createDataFrame([(0, " ".join([item] * 300)), (1, "word " * 12_000), (2, "nothing of it")], "doc_id long, text string")
benchmark = spark.createDataFrame([(5, item), (6, "word " * 20)], "item_id long, text string")
decontam.BROADCAST_SEEDS = int(sys.argv[2])
print(sorted(tuple(r)[1:] for r in decontam.flagged(docs, benchmark).collect()))
"""


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_hits_do_not_carry_their_text(tmp_path, most):
    run = subprocess.run([sys.executable, "-c", LONG, str(tmp_path), str(most)], env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=600)
    assert run.stdout.strip().endswith("[(1, 5, 40), (1, 6, 20)]"), run.stderr[-2000:]
