"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each text (lengths, character classes, repetition; never its
labels, language, source or id) are standardised and mapped to random cosines,
which approximate a Gaussian kernel. Each partition sums its own normal
equations; the sums are added in a tree, so what reaches the driver is a few
matrices of fixed size, and all labelled rows count. Isotonic regression over a
fixed grid of raw scores turns them into probabilities.

Defined results: null and empty texts have all statistics 0 and are scored like
others; without labelled rows every score is 0.5; several labels of one document
count with their mean. Repeated rows are scored one by one. Only ``doc_id`` and
``text`` (and ``quality`` of the labels) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text_crc, stored
from .textnum import NEWLINE, SMALL_SLICE_BYTES, U, _flags, hashes, mix, slices, spans, utf8, windows

COSINES = 256
RIDGE = 1e-3
#: Rows whose cosines are held at once.
ROWS_AT_ONCE = 1024
#: Steps of the raw score on which calibration counts labels.
GRID = 400
ACCEPT = 0.7
#: Labels whose ids are broadcast, at most: 8 bytes each.
BROADCAST_LABELS = 4_000_000
CLASSES = [_flags(bytes(x)) for x in (range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!", b".,;:", b"\n", range(192, 256), b"?\"'()-")]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of ``h`` in each document."""
    _, first = np.unique(mix(h + doc.astype(U) * U(0xD6E8FEB86659FD93)), return_index=True)
    return np.bincount(doc[first], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    data, offsets = utf8(column)
    n, size = len(column), np.diff(offsets)
    count = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets])
    kinds = [count(k[data]) for k in CLASSES]
    start, end, doc = spans(data, offsets)
    h = hashes(data, start, end)
    per = lambda w=None: np.bincount(doc, w, n)
    length, words = end - start, per()
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    repeat = np.bincount(doc[1:][same], minlength=n)
    three = windows(h, 3)
    whole = doc[2:] == doc[:-2] if len(three) else np.zeros(0, bool)
    n3, d3 = np.bincount(doc[: len(three)][whole], minlength=n), _distinct(doc[: len(three)][whole], three[whole], n)
    ls, le, ldoc = spans(data, offsets, NEWLINE)
    lines = np.bincount(ldoc, minlength=n)
    dup = lines - _distinct(ldoc, hashes(data, ls, le, False), n)
    mean = per(length) / np.maximum(words, 1)
    upper_start = per(CLASSES[0][data[start]].astype(float)) if len(start) else np.zeros(n)
    stop_end = per(CLASSES[5][data[end - 1]].astype(float)) if len(start) else np.zeros(n)
    b, w = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack(
        [np.log1p(words), np.log1p(lines), mean, np.sqrt(np.maximum(per(length.astype(float) ** 2) / w - mean**2, 0)), per((length <= 3).astype(float)) / w,
         per((length > 12).astype(float)) / w, per((length == 1).astype(float)) / w, _distinct(doc, h, n) / w, repeat / w, (n3 - d3) / np.maximum(n3, 1), dup / np.maximum(lines, 1),
         upper_start / w, stop_end / w, kinds[3] / w, kinds[4] / w, *[k / b for k in kinds]]
    ).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL_SLICE_BYTES):
            x = statistics(batch["text"])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], rows], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<float>")


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to ``value``."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    raw: np.ndarray | None = None
    calibrated: np.ndarray | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.column_stack([np.cos(z @ self.w + self.phase) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        parts = [self.cosines(x[k : k + ROWS_AT_ONCE]) @ self.beta for k in range(0, len(x), ROWS_AT_ONCE)]
        return np.clip(np.concatenate([*parts, np.zeros(0)]), -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        raw = self.raw_score(x)
        # a little of the raw score keeps the order inside flat steps
        return np.clip(0.999 * np.interp(raw, self.raw, self.calibrated) + 0.001 * (raw + 0.5) / 2, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 1
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def fit(x: DataFrame, labels: DataFrame, cosines: int = COSINES, seed: int = 7) -> Model:
    """``x``: the stored output of :func:`features`; ``labels``: (doc_id, y) with y from 0 to 1."""
    train = stored(x.join(labels, "doc_id").select("x", F.col("y").cast("double").alias("y")), "train")
    first = train.first()
    if first is None:
        return Model(*(np.zeros(0),) * 4)
    width = len(first["x"])
    c = [F.col("x")[i].cast("double") for i in range(width)]
    moments = train.agg(*[F.avg(v) for v in c], *[F.stddev_pop(v) for v in c]).first()
    rng = np.random.default_rng(seed)
    scale = np.array(moments[width:])
    model = Model(np.array(moments[:width]), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(width), (width, cosines)), rng.uniform(0, 2 * np.pi, cosines))

    def gram(batches):
        total = np.zeros((cosines + 1, cosines + 2))
        for b in batches:
            for k in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(k, ROWS_AT_ONCE)
                z = model.cosines(_matrix(part["x"]))
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ np.asarray(part["y"])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["g"])

    def add(batches):
        total = sum(np.frombuffer(g.as_py()) for b in batches for g in b["g"])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["g"])

    sums = train.mapInArrow(gram, "g binary")
    parts = train.rdd.getNumPartitions()
    while parts > 4:
        parts = -(-parts // 8)
        sums = sums.repartition(parts).mapInArrow(add, "g binary")
    g = sum(np.frombuffer(r["g"]) for r in sums.collect()).reshape(cosines + 1, cosines + 2)
    n = g[-1, -2]
    model.beta = np.linalg.solve(g[:, :-1] + RIDGE * n / cosines * np.eye(cosines + 1), g[:, -1])

    def raw(batches):
        for b in batches:
            step = np.round((model.raw_score(_matrix(b["x"])) + 0.5) / 2 * GRID).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), b["y"]], ["step", "y"])

    steps = train.mapInArrow(raw, "step int, y double").groupBy("step").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()
    model.raw = np.array([r["step"] for r in steps]) / GRID * 2 - 0.5
    model.calibrated = isotonic(np.array([r["y"] for r in steps]), np.array([float(r["n"]) for r in steps]))
    return model


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from."""
    return labels.where("quality is not null").where(id_text_crc("doc_id") % 4 != 2).groupBy("doc_id").agg(F.avg("quality").alias("y"))


def scores(x: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from the output of :func:`features`."""

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b["x"])) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a label. The labels' ids are broadcast if they are few enough, else both sides are shuffled."""
    ids = stored(labels.select("doc_id"), "label-ids")
    few = ids.count() <= BROADCAST_LABELS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def keep(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, with their columns unchanged; all rows where nothing can be learnt.
    Statistics are computed of the labelled rows to learn from, and of all rows to score them."""
    learn = training_labels(labels)
    model = fit(stored(features(labelled(docs, learn)), "features"), learn)
    if model.beta is None:
        return docs

    def run(batches):
        for b in slices(batches, "text", SMALL_SLICE_BYTES):
            yield b.filter(pa.array(model.score(statistics(b["text"])) >= accept))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    x = stored(features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    model = fit(x, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores(x, model).select(
        "doc_id", (id_text_crc("doc_id") % 4 == 2).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted")
    )
