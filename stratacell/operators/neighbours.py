"""Exact nearest neighbours of all cells, by pivots and the triangle inequality.

Cells are dealt to their nearest pivot, and within it to rings of like distance
and blocks of a bounded size. A first pass compares each block with itself, which
gives every cell a radius that holds ``k`` others. A second pass compares a block
with those that the radius of one of its cells reaches: a cell at distance d from
a pivot has no neighbour within r in a ring that ends before d - r or begins after
d + r. Which rings are reached is looked up in a table of fixed size. Blocks are put
together into sections, in order of pivot and ring; two sections of which one reaches
the other meet in one task, where radii shrink as neighbours are found. So a cell is
sent once for each section that is reached, and not for each block.

Squared distances by products of matrices, with a bound on their error, say which
pairs may be near; those are computed from differences.

Where distances hardly differ, as among random points of many dimensions, no bound
excludes much, and the work nears that of all pairs, still section by section.

Defined results: a cell without coordinates, or with a null or non-finite one, has
no neighbours and is none. Ties go to the smaller id; cells of one place are each
other's neighbours at distance 0; a cell id that repeats is an error of the input.
With ``k`` cells or fewer each has all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import checkpointed

#: Pivots, vectors of the sample that they are drawn from, rings of a pivot at most, and cells of a block, about.
PIVOTS, SAMPLE, RINGS, BLOCK = 64, 4096, 64, 128
#: Blocks of a section at most, and sections that there are at least, if there are blocks for them.
SECTION, SECTIONS = 512, 8
#: Cells that are compared at once on either side, and near pairs whose differences are held at once.
ROWS, COLUMNS, PAIRS = 2048, 1024, 65_536
USABLE = "coords is not null and size(coords) > 0 and forall(coords, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def _rows(blobs) -> np.ndarray:
    """Vectors of doubles from their bytes."""
    return np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``, from differences, so that small ones are exact too."""
    return np.sqrt(np.stack([np.square(b - x).sum(axis=1) for x in a])) if len(a) else np.zeros((0, len(b)))


def draw_pivots(vectors: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Farthest-first from a bounded sample by a hash of the ids."""
    x = np.array([r["coords"] for r in vectors.orderBy(F.xxhash64("cell_id"), "cell_id").limit(sample).select("coords").collect()], float)
    chosen, nearest, at = [], np.full(len(x), np.inf), 0
    while len(chosen) < min(pivots, len(x)):
        chosen.append(at)
        nearest = np.minimum(nearest, distances(x[at : at + 1], x)[0])
        at = int(np.argmax(nearest))
        if nearest[at] == 0:
            break
    return x[chosen] if chosen else np.zeros((1, 1))


def _dealt(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell_id, v, pivot, d): each cell's nearest pivot."""
    table = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(pc.list_flatten(b["coords"]), float).reshape(b.num_rows, -1)
                d = np.concatenate([distances(x[i : i + 1024], table.value) for i in range(0, len(x), 1024)])
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b["cell_id"], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])], ["cell_id", "v", "pivot", "d"])

    return vectors.mapInArrow(run, "cell_id long, v binary, pivot int, d double")


def _blocks(dealt: DataFrame, size: int, rings: int) -> tuple[DataFrame, DataFrame]:
    """(block, pivot, ring, m): about ``size`` cells each, ordered by id; and the rings (pivot, ring, low, high)."""
    places = F.array(*[F.lit(i / rings) for i in range(1, rings)])
    of_pivot = dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("d", places, 1000).alias("cuts"))
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("d"))) * F.least(F.lit(1.0), F.ceil(F.col("n") / size) / rings)).cast("int")
    rows = checkpointed(dealt.join(of_pivot, "pivot").select("cell_id", "v", "pivot", "d", ring.alias("ring")))
    of_ring = rows.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / size).alias("parts"), F.min("d").alias("low"), F.max("d").alias("high"))
    part = F.pmod(F.xxhash64("cell_id"), F.col("parts"))
    blocks = rows.join(of_ring, ["pivot", "ring"]).groupBy("pivot", "ring", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("cell_id", "v"))).alias("m"))
    block = F.concat_ws("-", "pivot", "ring", "part").alias("block")
    return checkpointed(blocks.select(block, "pivot", "ring", "m")), of_ring.select("pivot", "ring", "low", "high")


class Nearest:
    """The ``k`` nearest others that cells ``x`` have among all that :meth:`meet` shows them; ties to the smaller id. Of ``squared``
    distances if asked."""

    def __init__(self, own: np.ndarray, x: np.ndarray, k: int, radius: np.ndarray, squared: bool = False) -> None:
        self.own, self.x, self.k, self.radius, self.squared = own, x, k, radius, squared
        self.norms = np.einsum("ij,ij->i", x, x)
        self.d, self.ids = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)

    def meet(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        """Shows the cells ``ids`` at ``y`` to those of ``rows``."""
        norms = np.einsum("ij,ij->i", y, y)
        for i in range(0, len(rows), ROWS):
            for j in range(0, len(y), COLUMNS):
                self._meet(rows[i : i + ROWS], ids[j : j + COLUMNS], y[j : j + COLUMNS], norms[j : j + COLUMNS])

    def _meet(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray, norms: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            d2 = self.norms[rows, None] + norms[None, :] - 2 * (self.x[rows] @ y.T)
            slack = 1e-15 * (y.shape[1] + 4) * (self.norms[rows] + norms.max())  # above the error of d2
            far = d2 > (np.square(self.radius[rows]) * (1 + 1e-12) + slack)[:, None]  # what overflows is not far
            many = np.flatnonzero(far.shape[1] - far.sum(axis=1) > 4 * (self.k + 1))
            if len(many):  # of those shown only the nearest can be among the k nearest
                kth = np.partition(d2[many], self.k, axis=1)[:, self.k]
                far[many] |= d2[many] > (kth + 2 * slack[many])[:, None]
        row, column = np.nonzero(~far)
        for at in range(0, len(row), PAIRS):
            r, c = rows[row[at : at + PAIRS]], column[at : at + PAIRS]
            other = self.own[r] != ids[c]
            r, c = r[other], c[other]
            with np.errstate(over="ignore"):
                d2 = np.square(y[c] - self.x[r]).sum(axis=1)
                self._take(r, ids[c], d2 if self.squared else np.sqrt(d2))

    def _take(self, r: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        some = np.isfinite(d) & (d <= self.d[r, -1])
        r, ids, d = r[some], ids[some], d[some]
        if not len(r):
            return
        touched = np.unique(r)
        r, ids, d = np.r_[np.repeat(touched, self.k), r], np.r_[self.ids[touched].ravel(), ids], np.r_[self.d[touched].ravel(), d]
        order = np.lexsort((ids, d, r))
        r, ids, d = r[order], ids[order], d[order]
        first = np.searchsorted(r, touched)[:, None] + np.arange(self.k)
        self.d[touched], self.ids[touched] = d[first], ids[first]
        self.radius[touched] = np.minimum(self.radius[touched], np.sqrt(self.d[touched, -1]) if self.squared else self.d[touched, -1])

    def edges(self) -> pa.Table:
        row, column = np.nonzero(np.isfinite(self.d))
        return pa.table({"row_id": self.own[row], "col_id": self.ids[row, column], "value": self.d[row, column]})


EDGES = "row_id long, col_id long, value double"


def _cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of the blocks ``m`` of a table, and where each block ends."""
    m = table["m"].combine_chunks()
    flat = m.flatten()
    return np.asarray(flat.field("cell_id"), np.int64), _rows(flat.field("v").to_pylist()), np.cumsum(np.asarray(m.value_lengths(), np.int64))


def _reaches(to: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """Whether cells at distances ``to`` from a pivot may have something within their radius between ``low`` and ``high`` from it."""
    return (to - radius <= high + slack) & (to + radius >= low - slack)


def _meetings(vectors: DataFrame, k: int, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, rings: int = RINGS) -> tuple[DataFrame, DataFrame, tuple]:
    """(block, pivot, ring, m, section) of all cells; (block, radius, sections, compared): how far the cells of a block look, the
    sections that they reach there, and with how many cells that is in all; the pivots and the rings."""
    usable = vectors.select("cell_id", F.col("coords").cast("array<double>").alias("coords")).where(USABLE)
    p = draw_pivots(usable, pivots, sample)
    blocks, of_ring = _blocks(_dealt(usable, p), block, rings)
    parts = blocks.groupBy("pivot", "ring").agg(F.count("*").alias("parts"), F.sum(F.size("m")).alias("n"))
    bounds = of_ring.join(parts, ["pivot", "ring"]).orderBy("pivot", "ring").collect()  # pivots times rings
    ends = np.cumsum([0] + [r["parts"] for r in bounds])
    per = max(1, min(SECTION, -(-int(ends[-1]) // SECTIONS)))
    spans = [(int(a) // per, (int(b) - 1) // per) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    places = vectors.sparkSession.createDataFrame([(r["pivot"], r["ring"], int(e)) for r, e in zip(bounds, ends[:-1], strict=True)], "pivot int, ring int, first long")
    number = F.row_number().over(Window.partitionBy("pivot", "ring").orderBy("block")) - 1
    named = blocks.select("block", "pivot", "ring", number.alias("part")).join(F.broadcast(places), ["pivot", "ring"])  # pivots times rings
    dealt = blocks.join(named.select("block", F.floor((F.col("first") + F.col("part")) / per).cast("int").alias("section")), "block")
    table = (p, {(r["pivot"], r["ring"]): i for i, r in enumerate(bounds)}, np.array([[r["pivot"], r["low"], r["high"], r["n"]] for r in bounds]).reshape(-1, 4), spans)
    shown = vectors.sparkSession.sparkContext.broadcast(table)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block with itself: the cells' radii, and the sections that they reach."""
        p, _, rings, spans = shown.value
        for b in batches:
            for i in range(b.num_rows):
                ids, x, _ = _cells(pa.Table.from_batches([b.slice(i, 1)]))
                near = Nearest(ids, x, k, np.full(len(x), np.inf))
                near.meet(np.arange(len(x)), ids, x)
                to, slack = distances(x, p)[:, rings[:, 0].astype(int)], 1e-9 * (1 + np.abs(x).max(initial=0))
                reached = np.flatnonzero(_reaches(to, near.radius[:, None], rings[:, 1], rings[:, 2], slack).any(axis=0))
                sections = sorted({s for at in reached for s in range(spans[at][0], spans[at][1] + 1)})
                yield pa.RecordBatch.from_arrays(
                    [b["block"].slice(i, 1), pa.array([near.radius.tolist()], pa.list_(pa.float64())), pa.array([sections], pa.list_(pa.int32())), pa.array([int(rings[reached, 3].sum()) * len(x)], pa.int64())],
                    ["block", "radius", "sections", "compared"],
                )

    reach = checkpointed(blocks.select("block", "m").mapInArrow(own, "block string, radius array<double>, sections array<int>, compared long"))
    return dealt, reach, shown


def compared(vectors: DataFrame, k: int, **options) -> int:
    """Pairs of cells that :func:`knn_all` compares in its second pass, at most."""
    return _meetings(vectors, k, **options)[1].agg(F.sum("compared")).first()[0] or 0


def knn_all(vectors: DataFrame, k: int, **options) -> DataFrame:
    """(row_id, col_id, value): edges from every cell of ``vectors`` (cell_id, coords) to its ``k`` nearest others, exactly."""
    return knn_ranked(vectors, k, **options).select("row_id", "col_id", "value")


def knn_ranked(vectors: DataFrame, k: int, squared: bool = False, **options) -> DataFrame:
    """(row_id, col_id, value, rank): the edges of :func:`knn_all` and their places, by squared distance if asked."""
    blocks, reach, shown = _meetings(vectors, k, **options)
    looking = reach.join(blocks, "block").select("section", F.explode("sections").alias("other"), "radius", "m")
    pairs = looking.select("section", "other").distinct()
    seen = blocks.withColumnRenamed("section", "other").join(pairs, "other").select(*[F.col(c).alias(c) for c in ("section", "other", "pivot", "ring", "m")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The cells of one section that look into another, and all cells there, pivot by pivot from the nearest on."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"row_id": pa.array([], pa.int64()), "col_id": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        p, place, rings, _ = shown.value
        (own, x, _), radius = _cells(left), np.array(left["radius"].combine_chunks().flatten(), float)
        ids, y, ends = _cells(right)
        near, to = Nearest(own, x, k, radius, squared), np.concatenate([distances(x[i : i + ROWS], p) for i in range(0, len(x), ROWS)])
        slack = 1e-9 * (1 + np.abs(x).max(initial=0))
        of = rings[[place[key] for key in zip(right["pivot"].to_pylist(), right["ring"].to_pylist(), strict=True)]]
        heads = to.mean(axis=0)
        order = sorted(range(len(of)), key=lambda i: (heads[int(of[i, 0])], of[i, 0], of[i, 1]))
        at = 0
        while at < len(order):
            some, n = [order[at]], 0
            while at < len(order) and of[order[at], 0] == of[some[0], 0] and n < COLUMNS:
                i = order[at]
                some.append(i)
                n += ends[i] - (ends[i - 1] if i else 0)
                at += 1
            some = some[1:]
            take = np.concatenate([np.arange(ends[i - 1] if i else 0, ends[i]) for i in some])
            rows = np.flatnonzero(_reaches(to[:, int(of[some[0], 0])], near.radius, of[some, 1].min(), of[some, 2].max(), slack))
            near.meet(rows, ids[take], y[take])
        return near.edges()

    found = looking.groupBy("section", "other").cogroup(seen.groupBy("section", "other")).applyInArrow(meet, EDGES)
    best = F.row_number().over(Window.partitionBy("row_id").orderBy("value", "col_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("row_id", "col_id", "value", "rank")


#: Queries and vectors that meet in one task at most, about.
MET = 16_384


def knn_of(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(row_id, col_id, value, rank): edges from each query to its ``k`` nearest others among all ``vectors``, exactly, by squared distance;
    both (cell_id, coords). Each task has some of the queries and some of the vectors."""
    q, v = (t.select("cell_id", F.col("coords").cast("array<double>").alias("coords")).where(USABLE) for t in (queries, vectors))
    n, m = -(-q.count() // MET) or 1, max(16, -(-v.count() // MET))
    dealt = lambda parts: F.pmod(F.xxhash64("cell_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = q.select(F.col("cell_id").alias("cell_id"), F.col("coords").alias("coords"), dealt(n).alias("a"), every(m).alias("b"))
    right = v.select(F.col("cell_id").alias("cell_id"), F.col("coords").alias("coords"), every(n).alias("a"), dealt(m).alias("b"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        (own, x), (ids, y) = ((np.asarray(t["cell_id"], np.int64), np.asarray(pc.list_flatten(t["coords"].combine_chunks()), float).reshape(t.num_rows, -1)) for t in (left, right))
        near = Nearest(own, x, k, np.full(len(x), np.inf), squared=True)
        if len(x) and len(y):
            near.meet(np.arange(len(x)), ids, y)
        return near.edges()

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, EDGES)
    best = F.row_number().over(Window.partitionBy("row_id").orderBy("value", "col_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("row_id", "col_id", "value", "rank")
