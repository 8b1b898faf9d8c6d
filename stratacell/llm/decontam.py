"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Fixed masks pick some positions of each stretch of tokens and ignore the rest,
so a substituted token at an ignored position leaves the hash unchanged. Hashes
of the test items meet those of the documents in a join; around each hit the
item is laid along the document, and the overlap counts if some window of it
agrees in enough tokens.

A document is keyed by the MD5 of its text: copies are verified once, and ids
may repeat or be null. The masks leave no accepted overlap without a seed; items
shorter than a window have masks of their own. Defined results: null, empty and
blank texts, and an empty benchmark, give ``contaminated`` false with zero
counts; repeated items count once, under their smallest id. An item without an
id counts too, by its text; ``item_id`` is the smallest id found, -1 if none of
the items found has one. An item of one token is found wherever that token is, so
the benchmark should hold none that is an ordinary word. Only ``doc_id``, ``text``, ``item_id`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import let, words

#: Token positions that each mask looks at.
MASKS = ((0, 1, 3, 6, 8, 9), (0, 2, 3, 4, 7, 9))
#: With a third one, some mask fits wherever any 11 of 13 tokens agree.
ALL_MASKS = (*MASKS, (0, 1, 4, 5, 6, 9))
#: An overlap is a window of so many tokens (a shorter item: all of it) ...
WINDOW = 13
#: ... of which so many percent agree.
AGREE = 80
#: Seeds of the benchmark are broadcast up to this count (about 24 bytes each); beyond it the join shuffles.
BROADCAST_SEEDS = 1_000_000


def token_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))


def seeds(h: Column, masks=MASKS) -> Column:
    """For each mask in turn, a hash at each position of ``h``; null where the mask would run over the end."""

    def by_mask(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(
            h, lambda x, i: F.when(i + mask[-1] < F.size(h), F.xxhash64(F.lit(k), x, *[F.get(h, i + p) for p in mask[1:]]))
        )

    return F.concat(*[by_mask(k, m) for k, m in enumerate(masks)])


def short_masks(n: int, agree: int = AGREE) -> tuple[tuple[int, ...], ...]:
    """Masks that meet every overlap of an item of ``n`` tokens, fewer than a window: of ``miss`` + 2 equal blocks two
    hold no miss, wherever the misses are; of one token a block, or without a miss, the longest run is sure."""
    miss = n - -(-agree * n // 100)
    size = n // (miss + 2)
    if not miss or not size:
        return (tuple(range(n // (miss + 1))),)
    return tuple((*range(size), *range(d * size, (d + 1) * size)) for d in range(1, miss + 2))


def key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def seed_rows(table: DataFrame, by: str, masks=MASKS) -> DataFrame:
    """(by, h, at, mask, seed) of each mask at each token of ``table``'s ``text``; ``h`` holds all token hashes."""
    rows = table.select(by, let(token_hashes(F.col("text")), lambda h: F.struct(h.alias("h"), seeds(h, masks).alias("s"))).alias("t"))
    return (
        rows.select(by, F.col("t.h").alias("h"), F.posexplode("t.s").alias("p", "seed"))
        .where("seed is not null").select(by, "h", (F.col("p") % F.size("h")).alias("at"), F.floor(F.col("p") / F.size("h")).cast("int").alias("mask"), "seed")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=ALL_MASKS, window: int = WINDOW, agree: int = AGREE) -> DataFrame:
    """Verified overlaps: (md5 of the text, item, item_id, shift, matched): the item's token j lies on the document's
    token j + shift, and ``matched`` of the item's tokens agree. ``item`` numbers the items' texts."""
    texts = docs.where("text is not null").select(key(F.col("text")).alias("md5"), "text")
    items = benchmark.where("text is not null").groupBy(F.lower("text").alias("text")).agg(F.min("item_id").alias("item_id"))
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text", F.size(token_hashes(F.col("text"))).alias("item_n"))
    items = stored(items.where("item_n > 0"), "items")
    # an item shorter than a window has the masks of its length, which documents are only searched by if it is there
    short = {r["item_n"]: short_masks(r["item_n"], agree) for r in items.where(F.col("item_n") < window).select("item_n").distinct().collect()}
    own = sorted({m for ms in short.values() for m in ms} - set(masks))
    numbers = {m: k for k, m in enumerate([*masks, *own])}
    fits = (F.col("item_n") >= window) & (F.col("mask") < len(masks))
    for n, ms in short.items():
        fits = fits | ((F.col("item_n") == n) & F.col("mask").isin([numbers[m] for m in ms]))
    masks = tuple(numbers)
    item_seeds = seed_rows(items, "item", masks).select("item", "mask", F.col("at").alias("item_at"), "seed").join(items.select("item", "item_n"), "item")
    item_seeds = stored(item_seeds.where(fits).drop("mask"), "item-seeds")
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    # the document's tokens that the item lies on: cut out in the join's own stage, so that no hit takes all of ``h`` along
    laid_on = F.slice("h", F.greatest("shift", F.lit(0)) + 1, F.col("item_n") + F.least("shift", F.lit(0))).alias("d")
    if item_seeds.count() <= BROADCAST_SEEDS:
        # texts are read once and not shuffled; hits are grouped as they are found, by columns alone, and never lined up before a sort
        hits = seed_rows(texts, "md5", masks).join(F.broadcast(item_seeds), "seed")
        hits = hits.select("md5", "item", "item_n", shift, "h").select("md5", "item", "shift", laid_on).distinct()
    else:
        hits = stored(seed_rows(texts, "md5", masks).drop("h", "mask").join(item_seeds, "seed").select("md5", "item", "item_n", shift).distinct(), "hits")
        found = texts.join(hits.select("md5").distinct(), "md5", "left_semi").dropDuplicates(["md5"])
        hits = hits.join(found.select("md5", token_hashes(F.col("text")).alias("h")), "md5").select("md5", "item", "shift", laid_on)
    # of an item that begins before the text, the first tokens lie on none
    d = F.concat(F.array_repeat(F.lit(None).cast("long"), F.greatest(-F.col("shift"), F.lit(0))), "d")
    laid = (
        hits.join(items.select("item", "item_id", token_hashes(F.col("text")).alias("b")), "item")
        .select("md5", "item", "item_id", "shift", F.zip_with("b", d, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")).alias("m"))
        .select("*", F.least(F.lit(window), F.size("m")).alias("w"))
    )
    best = F.expr("array_max(transform(sequence(0, size(m) - w), s -> aggregate(slice(m, s + 1, w), 0, (a, x) -> a + x)))")
    return laid.where(100 * best >= agree * F.col("w")).select(
        "md5", "item", "item_id", "shift", F.expr("aggregate(m, 0, (a, x) -> a + x)").cast("long").alias("matched")
    )


def flagged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(md5, n_items, item_id, matched) of each contaminated text: its items, the smallest id of them (null if none has
    one), the most tokens matched."""
    by_id = F.when(F.col("item_id").isNull(), F.col("item")).alias("item")  # texts of one id are one item
    found = overlaps(docs, benchmark, **options).groupBy("md5", "item_id", by_id).agg(F.max("matched").alias("matched"))
    return stored(
        found.groupBy("md5").agg(F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.max("matched").alias("matched")), "flagged"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item of ``benchmark``, with their columns unchanged."""
    bad = flagged(docs, benchmark, **options).select("md5")
    rows = docs.select(F.struct("*").alias("row"), key(F.col("text")).alias("md5"))
    return rows.join(bad, "md5", "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bad = flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select("doc_id", key(F.col("text")).alias("md5")).join(bad, "md5", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_id", F.lit(-1)).cast("long").alias("item_id"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
    )


#: By the rule of acceptance alone, without seeds: every equal token of a document and an item counts for a shift.
SQL = rf"""
WITH d AS (SELECT md5(text) AS k, any_value(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM documents WHERE text IS NOT NULL GROUP BY 1),
b AS (SELECT row_number() OVER () AS item, min(item_id) AS item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL GROUP BY lower(text)),
dt AS (SELECT k, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
bt AS (SELECT item, item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS j FROM b),
m AS (SELECT k, item, item_id, i - j AS shift, j, least({WINDOW}, n) AS w FROM dt JOIN bt USING (x)),
c AS (SELECT *, count(*) OVER (PARTITION BY k, item, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS near, count(*) OVER (PARTITION BY k, item, shift) AS matched FROM m),
v AS (SELECT k, item, item_id, matched FROM c WHERE 100 * near >= {AGREE} * w),
f AS (SELECT k, count(DISTINCT coalesce('id ' || item_id, 'text ' || item)) AS n_items, min(item_id) AS item_id, max(matched) AS matched FROM v GROUP BY k)
SELECT doc_id, f.k IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, CAST(coalesce(f.item_id, -1) AS BIGINT) AS item_id,
  CAST(coalesce(matched, 0) AS BIGINT) AS matched
FROM documents LEFT JOIN f ON md5(text) = k
"""
