"""MinHash near-duplicates: one permutation, optimal densification, star edges.

One hash of each shingle serves all bins: the bin is the hash's range, its value
the smallest hash there, and an empty bin borrows from the bin that its own hash
sequence names first. Bands of bins make buckets. Texts with equal shingle sets
are one class from the start. Each bucket gives a star: its members are compared
with one hub, on the full sets. Pairs of members that no hub has joined are found
by where they differ from their common hub, and are confirmed on the full sets
too. So no pairs of a group of copies are spelt out, and yet no link between two
components of a bucket is left out.

A hub, a bucket or a text with a third of all rows is no hot task: what is known
of each is counted before its shuffle and stored, and the joins with it are
between stored tables, which Spark splits where one key is large. Classes of two
components that share a hub and a difference to it are compared one by one; those
of one component never are.

Defined results: a null, empty or blank text has no shingles and links with
nothing, and so is its own component. In the report, rows that repeat an id get
one component each through their text, and a null id belongs to no component
(null) and is kept. ``deduplicate`` judges each row by its own text: of the rows
of a component one stays, that with the smallest id (a null id comes last; of
equal ids any one); rows without shingles all stay. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, stored
from .textnum import GOLD, SMALL_SLICE_BYTES, U, hashes, mix, slices, spans, table, utf8, windows

SHINGLE = 5
SIMILAR = 85
#: The similarity, in percent, from which the pipeline takes documents for copies of each other.
STAGE_SIMILAR = 80
#: A pair shares no bucket with probability 3e-7 at a similarity of 0.85, and 3e-5 at 0.8.
BANDS, ROWS = 26, 5
BINS = BANDS * ROWS
#: Keys of rows to remove that are broadcast, at most: 16 bytes each, about 100 in memory.
BROADCAST_KEYS = 1_000_000
def _donors(tries: int = 64) -> np.ndarray:
    return (table(BINS * tries, 9001).reshape(BINS, tries) % U(BINS)).astype(np.int64)


DONORS = _donors()
SALTS = table(ROWS, 31) | U(1)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    return np.unique(windows(h, SHINGLE) if len(h) >= SHINGLE else windows(h, max(1, len(h))))


def signature(s: np.ndarray) -> np.ndarray:
    """The hash of each band of a non-empty sorted set."""
    bins = ((s >> U(32)) * U(BINS)) >> U(32)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = np.zeros(BINS, bool)
    value = np.zeros(BINS, U)
    at = bins[first].astype(np.int64)
    full[at], value[at] = True, s[first]
    todo = np.flatnonzero(~full)
    for t in range(DONORS.shape[1]):
        if not len(todo):
            break
        donor = DONORS[todo, t]
        ok = full[donor]
        value[todo[ok]] = value[donor[ok]]
        todo = todo[~ok]
    for b in todo:  # hardly ever: the next full bin
        value[b] = value[at[np.searchsorted(at, b) % len(at)]]
    bands = mix(value.reshape(BANDS, ROWS) * SALTS)
    return mix(bands.sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U) * GOLD)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in slices(batches, "text", SMALL_SLICE_BYTES):
        data, offsets = utf8(batch["text"])
        start, end, doc = spans(data, offsets)
        h = hashes(data, start, end)
        cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        yield batch, [shingle_set(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _key(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, U)]).view(np.int64)))


def row_key(docs: DataFrame) -> Column:
    """A digest of a row's id and text; null without a text."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), docs["text"].cast("string"))))


def text_key(docs: DataFrame) -> Column:
    """A hash of a row's text, by which texts are found again; what it takes for equal is told apart by the sets."""
    return F.xxhash64(docs["text"].cast("string"))


def signatures(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, text_key): ``set_key`` is a 128-bit digest of the shingle set, null if empty; with ``row_key`` if ``keyed``."""

    def run(batches):
        none = np.zeros(0, U)
        for batch, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), _lists([signature(s) if len(s) else none for s in sets]), batch["text_key"], *([batch["row_key"]] if keyed else [])],
                ["doc_id", "n_shingles", "set_key", "bands", "text_key", *["row_key"] * keyed],
            )

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(docs).alias("text_key"), *[row_key(docs).alias("row_key")] * keyed)
    return own.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, text_key long" + ", row_key binary" * keyed)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(set_key, shingles) of each text."""

    def run(batches):
        for _, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), _lists(sets)], ["set_key", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "set_key binary, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (u, v) whose full sets are similar."""
    a, b = (sets.select(F.col("set_key").alias(k), F.col("shingles").alias(f"{k}s")) for k in "uv")
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size("us").alias("nu"), F.size("vs").alias("nv"), F.size(F.array_intersect("us", "vs")).alias("both"))
    return both.where(100 * F.col("both") >= similar * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def _share(similar: int) -> float:
    """Sets of n and m elements are similar if they differ in at most this times n + m elements."""
    return (100 - similar) / (100 + similar)


def prefix_length(n: Column, similar: int) -> Column:
    """Differences of which two similar sets share one: more than the ``_share`` of n and the largest similar set, by whole numbers."""
    return F.floor((100 - similar) * n / similar) + 1


def prefixes(around: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(hub, x, set_key, n, root, nd, at): by which differences to their hub classes of several components meet.

    ``around``: (hub, hub_root, hub_n, set_key, n, root). Two sets differ exactly where their differences to the hub
    differ, so similar ones that the hub does not join share most of those differences: both have one of the rarest
    few (a prefix filter), at places that leave enough to share (a positional filter). What all copies of one text have
    in common cancels out, so copies that are not similar to each other do not meet. A difference that only classes of one
    component have brings nothing together, however many they are.
    """
    c = _share(similar)
    h, m = sets.select(F.col("set_key").alias("hub"), F.col("shingles").alias("hs")), sets.select("set_key", F.col("shingles").alias("ms"))
    differs = F.concat(F.array_except("ms", "hs"), F.array_except("hs", "ms"))
    d = around.join(m, "set_key").join(h, "hub").select("hub", "set_key", "n", "root", (F.col("root") == F.col("hub_root")).alias("joined"), "hub_n", differs.alias("d"))
    rows = stored(d.where(F.size("d") > 0).select("*", F.size("d").alias("nd"), F.explode("d").alias("x")).drop("d"), "differences")
    mixed = (F.min("root") != F.max("root")).alias("mixed")
    count = stored(rows.groupBy("hub", "x").agg(F.count("*").alias("df"), mixed).where("df > 1"), "counts")
    ranked = rows.join(count, ["hub", "x"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", F.row_number().over(Window.partitionBy("hub", "set_key").orderBy("df", "x")))
    most = prefix_length(F.col("n"), similar)
    # a class that the hub joins only looks for classes that the hub does not join
    joined = F.col("nd") - F.ceil((F.col("nd") + c * (F.col("hub_n") - F.col("n"))) / 2 - 1e-6) + 1
    return stored(
        ranked.where(F.col("mixed") & (F.col("at") <= F.when(F.col("joined"), F.least(most, joined)).otherwise(most)))
        .select("hub", "x", "set_key", "n", "root", "nd", "at"), "prefix",
    )


def residual_pairs(around: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Pairs (u, v) across components that may be similar, of classes around the same hub; see :func:`prefixes`."""
    c, prefix = _share(similar), prefixes(around, sets, similar)
    v = prefix.select("hub", "x", *[F.col(k).alias(f"{k}2") for k in ("set_key", "n", "root", "nd", "at")])
    room = 1 + F.least(F.col("nd") - F.col("at"), F.col("nd2") - F.col("at2"))
    met = (
        (prefix["hub"] == v["hub"]) & (prefix["x"] == v["x"]) & (F.col("set_key") < F.col("set_key2")) & (F.col("root") != F.col("root2"))
        & (2 * room + c * (F.col("n") + F.col("n2")) + 1e-6 >= F.col("nd") + F.col("nd2"))
    )
    return prefix.join(v, met).select(F.col("set_key").alias("u"), F.col("set_key2").alias("v")).distinct()


def links(docs: DataFrame, sig: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(node, root) of the classes of equal sets that are linked with others."""
    classes = stored(
        sig.where("set_key is not null").groupBy("set_key").agg(F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.min("text_key").alias("text_key")),
        "classes",
    )
    in_buckets = classes.select("set_key", "n", F.explode("bands").alias("bucket"))
    shared = stored(in_buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stored(in_buckets.join(shared, "bucket"), "members")
    # only classes in a shared bucket need their sets
    degree = stored(members.groupBy("set_key").agg(F.sum("size").alias("degree")), "degree")
    texts = classes.join(degree, "set_key", "left_semi").select("text_key")
    sets = stored(
        shingle_sets(docs.select("text", text_key(docs).alias("text_key")).join(texts, "text_key", "left_semi")).join(degree, "set_key", "left_semi").dropDuplicates(["set_key"]), "sets"
    )
    # the hub of a bucket is the member that meets most others: in a group of copies, the text that they vary
    hubs = members.join(degree, "set_key").groupBy("bucket").agg(F.max(F.struct("degree", "set_key", "n")).alias("h"))
    hubs = stored(hubs.select("bucket", F.col("h.set_key").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    around = stored(members.join(hubs, "bucket").where("set_key <> hub").select("hub", "hub_n", "set_key", "n").distinct(), "around")
    star = around.where(100 * F.least("n", "hub_n") >= similar * F.greatest("n", "hub_n")).select(F.col("set_key").alias("u"), F.col("hub").alias("v"))
    roots = stored(components(stored(confirmed(star, sets, similar), "links")), "roots")
    own, hub = roots.select(F.col("node").alias("set_key"), "root"), roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    around = stored(around.join(own, "set_key", "left").join(hub, "hub", "left").select(
        "hub", F.coalesce("hub_root", "hub").alias("hub_root"), "hub_n", "set_key", "n", F.coalesce("root", "set_key").alias("root")
    ), "around")
    # around a hub that joined all its classes nothing is left to try
    open_hubs = around.groupBy("hub").agg(F.count_if(F.col("root") != F.col("hub_root")).alias("apart"), F.count("*").alias("all")).where("apart > 0 and all > 1")
    around = stored(around.join(stored(open_hubs.select("hub"), "open-hubs"), "hub"), "apart")
    pairs = stored(residual_pairs(around, sets, similar), "pairs")
    more = stored(confirmed(pairs, sets, similar), "links")
    if more.isEmpty():
        return roots
    return stored(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "roots")


def _rooted(sig: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``sig`` that have shingles, with the ``root`` of their class."""
    own = sig.where("set_key is not null")
    return own.join(roots, F.col("set_key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_key")).drop("node")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``."""
    sig = stored(signatures(docs), "signatures")
    rows = _rooted(sig.select("doc_id", "n_shingles", "set_key"), links(docs, sig, similar))
    low = stored(rows.groupBy("root").agg(F.min("doc_id").alias("low")), "low")
    rows = rows.join(low, "root").select("doc_id", "n_shingles", "low").union(sig.where("set_key is null").select("doc_id", "n_shingles", "doc_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, similar: int = STAGE_SIMILAR) -> DataFrame:
    """One row of each component, with the columns of ``docs`` unchanged."""
    sig = stored(signatures(docs, keyed=True), "signatures")
    rows = stored(_rooted(sig.select("doc_id", "set_key", "row_key"), links(docs, sig, similar)), "rows")
    best = stored(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("b")).select("root", F.col("b.row_key").alias("best")), "best")
    rows = rows.join(best, "root")
    gone = stored(rows.where("row_key <> best").select("row_key").distinct(), "gone")
    again = stored(rows.where("row_key = best").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"), "again")
    # the rows themselves are shuffled only if the keys are too many to broadcast
    small = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    left = docs.select(F.struct("*").alias("row"), row_key(docs).alias("row_key")).join(small, "row_key", "left_anti")
    if not again.isEmpty():  # rows that repeat both id and text
        left = left.join(again, "row_key", "left_anti").unionByName(left.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return left.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
m AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS other FROM m UNION SELECT r.node, m.b FROM r JOIN m ON r.other = m.a),
k AS (SELECT node, min(other) AS low FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept FROM n LEFT JOIN k ON node = doc_id
"""
