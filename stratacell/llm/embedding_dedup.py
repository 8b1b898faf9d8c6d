"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) lie far apart: they are drawn farthest-first from a
bounded sample of the vectors. A vector is described by its nearest pivots, in
order, and stands in the inverted list of each pair of them; so two vectors meet
in a list exactly if they share two pivots or more, and their shared-pivot count
is at least that. The lists hold every vector. What meets is verified by cosine in
double precision.

Vectors that are equal bit by bit are one class from the start. The vector of a
list that meets most others is its hub; a class within half the angle of a link
joins the nearest hub that it shares a list with, so the members of such a group
are all linked with each other, whatever their number, and no pairs of copies are
spelt out. Groups that meet in a list are compared by their hubs first: if no
member of one can be linked with a member of the other, nothing more is done, and
if all must be, they are counted. What is left is compared in blocks of a bounded
number of members, as a product of matrices, which gives a count for each member
and no pairs. Every link between groups that meet is found, also of members that
share no list themselves.

Only vectors that share fewer than two of their nearest pivots, in groups of which
that holds throughout, are missed; :func:`recall` measures how many.

Defined results: a vector without a label, or that is null, empty, zero or has a
null or non-finite component, links with nothing and is its own component. Vectors
of other lengths never link. Rows that repeat a vector are linked, whatever their
ids; rows that repeat an id get a result each. A row without an id is counted and
links, but is no component's smallest id; its own component is null, and it is
kept. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

SIMILAR = 0.93
#: Pivots, vectors of the sample that they are drawn from, and pivots that describe a vector, at most.
PIVOTS, SAMPLE, NEAREST = 512, 8192, 7
#: Members of a block.
BLOCK = 32
#: What rounding may do to an angle.
SLACK = 1e-7
VALID = "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), np.float64).reshape(-1, width)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, also where squares would not fit a double."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors, row by row; exact for small ones too."""
    return 2 * np.arctan2(np.linalg.norm(a - b, axis=1), np.linalg.norm(a + b, axis=1))


def _by_width(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, those of each length together."""
    widths = np.asarray(pc.list_value_length(batch[column]))
    for w in np.unique(widths):
        yield int(w), batch.filter(pa.array(widths == w))


def draw_pivots(vectors: DataFrame, similar: float = SIMILAR, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors that are far from each other: the farthest from all before, in turn, of a bounded sample by a hash of the
    rows. Vectors of fewer components are filled up with zeros. None is drawn that lies within twice a link's angle of another."""
    drawn = vectors.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample).select(F.col("embedding").cast("array<double>")).toArrow()["embedding"].combine_chunks()
    if not len(drawn):
        return np.zeros((1, 1))
    widths = np.asarray(pc.list_value_length(drawn))
    x = np.zeros((len(drawn), widths.max()))
    x[np.repeat(np.arange(len(x)), widths), np.concatenate([np.arange(w) for w in widths])] = np.asarray(pc.list_flatten(drawn))
    x = units(x)
    centre = x.mean(axis=0)
    at, chosen = int(np.argmin(x @ centre)), []
    nearest = np.full(len(x), -2.0)  # the cosine with the nearest pivot so far
    while len(chosen) < pivots:
        chosen.append(at)
        nearest = np.maximum(nearest, x @ x[at])
        at = int(np.argmin(nearest))
        if nearest[at] > np.cos(2 * np.arccos(similar)):
            break
    return x[chosen]


def described(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """(vec_id, key, unit, near): a 128-bit digest of label and vector, the unit vector as doubles, its nearest pivots in order."""
    table = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for width, batch in _by_width(whole, "embedding"):
                p = table.value
                x = _matrix(batch["embedding"], width) + 0.0  # a negative zero is a zero
                u, both = units(x), min(width, p.shape[1])
                near = np.argsort(-(u[:, :both] @ p[:, :both].T), axis=1, kind="stable")[:, :nearest]
                keys = [xxhash.xxh3_128_digest(f"{label}:".encode() + v.tobytes()) for label, v in zip(batch["label"].to_pylist(), x, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(keys, pa.binary()), pa.array([v.tobytes() for v in u], pa.binary()), lists, batch["label"]], ["vec_id", "key", "unit", "near", "label"])

    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return own.mapInArrow(run, "vec_id long, key binary, unit binary, near array<int>, label string")


def listed(classes: DataFrame) -> DataFrame:
    """(list, key): each class in the list of every two of its nearest pivots, of vectors with its label and length."""
    near = F.sort_array("near")
    two = F.flatten(F.transform(near, lambda p, i: F.transform(F.slice(near, i + 2, F.size(near)), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    # with a single pivot, that is the list
    two = F.when(F.size("near") > 1, two).otherwise(F.array(F.struct(F.element_at("near", 1).alias("p"), F.lit(-1).alias("q"))))
    return classes.select("key", "label", F.octet_length("unit").alias("width"), F.explode(two).alias("two")).select(F.xxhash64("label", "width", "two.p", "two.q").alias("list"), "key")


def _compared(pairs: DataFrame, units_of: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the ``angle`` between the vectors of the classes ``a`` and ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch["x"].to_pylist(), batch["y"].to_pylist()
            out = np.full(len(x), np.pi)
            same = np.array([len(u) == len(v) for u, v in zip(x, y, strict=True)])  # a list is one of a hash, so it may hold two lengths
            for w in {len(u) for u in x}:
                at = np.flatnonzero(same & np.array([len(u) == w for u in x]))
                if len(at):
                    out[at] = angles(*(np.frombuffer(b"".join(z[i] for i in at)).reshape(len(at), -1) for z in (x, y)))
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("x", "y")], pa.array(out)], [*[n for n in batch.schema.names if n not in ("x", "y")], "angle"])

    vectors = lambda k, v: units_of.select(F.col("key").alias(k), F.col("unit").alias(v))
    rows = pairs.join(vectors(a, "x"), a).join(vectors(b, "y"), b).select(*pairs.columns, "x", "y")
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", angle double")


def grouped(members: DataFrame, classes: DataFrame, theta: float) -> DataFrame:
    """(key, hub, radius): each class with the hub that it joins, itself if none is near. ``members``: (list, key, size)."""
    degree = stored(members.groupBy("key").agg(F.sum("size").alias("degree")), "degree")
    hubs = members.join(degree, "key").groupBy("list").agg(F.max(F.struct("degree", "key")).alias("h")).select("list", F.col("h.key").alias("hub"))
    hubs = stored(hubs, "hubs")
    own = stored(hubs.select("hub").distinct(), "all-hubs")
    around = members.join(hubs, "list").select("key", "hub").distinct().join(own.select(F.col("hub").alias("key")), "key", "left_anti")
    near = _compared(stored(around, "around"), classes, "key", "hub").where(F.col("angle") <= theta / 2 - SLACK)
    joins = stored(near.groupBy("key").agg(F.min(F.struct("angle", "hub")).alias("h")), "joins")
    return classes.select("key", "n").join(joins, "key", "left").select("key", "n", F.coalesce("h.hub", "key").alias("hub"), F.coalesce("h.angle", F.lit(0.0)).alias("radius"))


def blocks(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(hub, block, keys, weights, units): the members of each group in blocks of about BLOCK, by a hash."""
    size = groups.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = groups.join(size, "hub").join(classes.select("key", "unit"), "key").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    return rows.groupBy("hub", "block").agg(F.sort_array(F.collect_list(F.struct("key", "n", "unit"))).alias("m"))


def block_links(pairs: DataFrame, table: DataFrame, similar: float) -> DataFrame:
    """(a, b, key, links) for the members of the groups ``a`` and ``b`` of ``pairs`` that are linked with the other group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                (ka, na, ua), (kb, nb, ub) = (([m["key"] for m in one[s]], np.array([m["n"] for m in one[s]]), np.frombuffer(b"".join(m["unit"] for m in one[s])).reshape(len(one[s]), -1)) for s in ("ma", "mb"))
                if ua.shape[1] != ub.shape[1]:
                    continue
                hit = ua @ ub.T >= similar
                for keys, links in ((ka, hit @ nb), (kb, na @ hit)):
                    out += [(one["a"], one["b"], keys[j], int(links[j])) for j in np.flatnonzero(links)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "key", "links"])

    side = lambda k: table.select(F.col("hub").alias(k), F.col("m").alias(f"m{k}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary, key binary, links long")


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR, pivots: int = PIVOTS, sample: int = SAMPLE, nearest: int = NEAREST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label)."""
    theta = float(np.arccos(similar))
    vectors = vectors.select("vec_id", "embedding", "label").withColumn("valid", F.coalesce(F.expr(VALID), F.lit(False)))
    usable = vectors.where("valid")
    rows = stored(described(usable, draw_pivots(usable, similar, pivots, sample), nearest), "described")
    classes = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("near").alias("near"), F.first("unit").alias("unit")), "classes")
    lists = listed(classes)
    size = stored(lists.groupBy("list").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    members = stored(lists.join(size, "list"), "members")
    groups = stored(grouped(members, classes, theta), "groups")
    of_group = stored(groups.groupBy("hub").agg(F.sum("n").alias("all"), F.count("*").alias("members"), F.max("radius").alias("reach")), "of-group")
    # groups that meet in a list, hub with hub first
    met = stored(members.join(groups.select("key", "hub"), "key").select("list", "hub").distinct(), "met")
    pairs = met.select("list", F.col("hub").alias("a")).join(met.select("list", F.col("hub").alias("b")), "list").where("a < b").select("a", "b").distinct()
    pairs = _compared(stored(pairs, "pairs"), classes, "a", "b")
    for k in "ab":
        pairs = pairs.join(of_group.select(F.col("hub").alias(k), F.col("reach").alias(f"reach_{k}"), F.col("all").alias(f"all_{k}")), k)
    reach = F.col("reach_a") + F.col("reach_b")
    pairs = stored(pairs.where(F.col("angle") <= theta + reach + SLACK).withColumn("sure", F.col("angle") + reach <= theta - SLACK), "open")
    sure = pairs.where("sure")
    part = block_links(pairs.where("not sure"), stored(blocks(groups.join(pairs.where("not sure").select(F.explode(F.array("a", "b")).alias("hub")).distinct(), "hub", "left_semi"), classes), "blocks"), similar)
    part = stored(part, "links")
    to_all = sure.select(F.explode(F.array(F.struct(F.col("a").alias("hub"), F.col("all_b").alias("links")), F.struct(F.col("b").alias("hub"), F.col("all_a").alias("links")))).alias("s")).select("s.*").groupBy("hub").agg(F.sum("links").alias("sure"))
    edges = stored(sure.select(F.col("a").alias("u"), F.col("b").alias("v")).union(part.select("a", "b")).distinct(), "edges")
    roots = stored(components(edges), "roots")
    own = groups.join(of_group.select("hub", "all"), "hub").join(to_all, "hub", "left").join(part.groupBy("key").agg(F.sum("links").alias("part")), "key", "left")
    own = own.join(roots.select(F.col("node").alias("hub"), "root"), "hub", "left").select(
        "key", F.coalesce("root", "hub").alias("root"), (F.col("all") - 1 + F.coalesce("sure", F.lit(0)) + F.coalesce("part", F.lit(0))).alias("n_links")
    )
    own = stored(own.join(classes.select("key", "low"), "key"), "linked")
    low = stored(own.groupBy("root").agg(F.min("low").alias("low")), "low")
    own = own.drop("low").join(low, "root").select("key", "n_links", "low")
    out = rows.select("vec_id", "key").join(own, "key").select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("low")).alias("component_id"))
    vec_id = F.col("vec_id").cast("long")
    out = out.unionByName(vectors.where("not valid").select(vec_id.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), vec_id.alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(vectors: DataFrame, similar: float = SIMILAR, every: int = 100, **options) -> float:
    """The share of the links of the vectors whose id is divisible by ``every`` that is found, beside all vectors in blocks."""
    found = near_duplicates(vectors, similar, **options).where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    v = vectors.where(F.coalesce(F.expr(VALID), F.lit(False))).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    q = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("e").alias("qe"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = q.crossJoin(v).where("q <> vec_id and ql = label and size(qe) = size(e)")  # a stated query set with all rows
    true = both.where(dot("qe", "e") / F.sqrt(dot("qe", "qe") * dot("e", "e")) >= similar).count()
    return found / true if true else 1.0


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false) AS ok FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE ok),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {SIMILAR}),
r AS (SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
k AS (SELECT node, min(other) AS low FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON a = vec_id LEFT JOIN k ON node = vec_id
"""
