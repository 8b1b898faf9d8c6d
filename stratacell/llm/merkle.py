"""A Merkle manifest of a dataset, by nested-interval labels, with DataFrame functions only.

Each row is a leaf with a rank among the leaves of its group (its language). A
node carries the interval of leaf ranks that it covers, ``lo`` to ``hi``, so its
place in the tree needs no pointers: at level k a node's bucket is
``lo div 8^k``, an ancestor is found by a join of buckets one level up that
checks containment, and the siblings of a node are what its parent's interval
has besides the node's own. The groups' roots are the leaves of one more tree.

Ranks are those of a range partitioning with the rows counted before each part,
so no group is ever in one task, whatever share of the rows it has. Paths to the
root are attached from the root down, to the nodes above the leaves: an eighth as
many as there are leaves. Only digests are shuffled, no texts.

Defined results: a null group is one of its own, first in order. Leaves without
an id come first in their group; leaves of one id are in the order of their
digests; rows that repeat in full have neighbouring places, each with a proof of
its own. A row without an id is not tampered with. A null value is ``-`` in its
leaf, an empty text ``0:``. An empty table gives no rows. Only ``doc_id``,
``source``, ``lang``, ``n_chars`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text_crc, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*[encoded(f) for f in fields]))


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (group, ..) with ``rank``, from 0 within the group by ``order``, and ``last``, the group's last rank; stored.

    Rows are dealt out by range, nulls first, counted in each part, and numbered from the count of the parts before."""
    first = lambda *columns: [F.col(c).asc_nulls_first() for c in columns]
    order = [*order, "row"]  # rows that are equal in all else can be split too
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*first("group", *order))
    parts = stored(dealt.withColumn("part", F.spark_partition_id()), f"{name}-parts")
    of_group = Window.partitionBy("group")  # a row for each part
    before = F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    count = parts.groupBy("part", "group").agg(F.count("*").alias("n")).select(
        F.col("part").alias("own_part"), F.col("group").alias("own_group"), F.coalesce(before, F.lit(0)).alias("before"), (F.sum("n").over(of_group) - 1).alias("last")
    )
    local = F.row_number().over(Window.partitionBy("part", "group").orderBy(*first(*order))) - 1
    out = parts.withColumn("local", local).join(count, (F.col("part") == F.col("own_part")) & F.col("group").eqNullSafe(F.col("own_group")))
    return stored(out.select(*rows.columns, (F.col("before") + F.col("local")).alias("rank"), "last"), name)


#: Whether a node covers its whole group.
TOP = "lo = 0 and hi = last"


def bucket(level: int, place: str = "lo") -> Column:
    return F.expr(f"{place} div {FANOUT**level}").alias("bucket")


def level_up(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes one level up: (group, last, lo, hi, hash, children), ``children`` in order as (lo, hi, hash)."""
    children = F.sort_array(F.collect_list(F.struct("lo", "hi", "hash")))  # FANOUT at most
    up = nodes.groupBy("group", "last", bucket(level)).agg(children.alias("children"))
    return up.select(
        "group", "last", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
        digest(F.array_join(F.transform("children", lambda c: c["hash"]), "")).alias("hash"), "children",
    )


def siblings(children: Column, lo: Column, hi: Column) -> Column:
    """(left, right): the parent's other children, which cover its interval less that of the node."""
    side = lambda keep: F.array_join(F.transform(F.filter(children, keep), lambda c: c["hash"]), "")
    return F.struct(side(lambda c: c["hi"] < lo).alias("left"), side(lambda c: c["lo"] > hi).alias("right"))


def below(parents: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """(``nodes``, path): the siblings of each node, and then the path of the one of ``parents`` (at ``level``) that contains it."""
    up = parents.select(*[F.col(c).alias(f"up_{c}") for c in ("group", "lo", "hi", "children", "path")], bucket(level).alias("up_bucket"))
    contained = (bucket(level) == F.col("up_bucket")) & F.col("group").eqNullSafe(F.col("up_group")) & (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
    path = F.concat(F.array(siblings(F.col("up_children"), F.col("lo"), F.col("hi"))), F.col("up_path"))
    return nodes.join(up, contained).select(*nodes.columns, path.alias("path"))


def tree(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The groups' roots (group, hash), and every leaf's path: the nodes just above the leaves, and the leaves that are
    alone in their group, as (group, lo, hi, children, path). A lone leaf is its own child and has no path.

    ``leaves``: (group, last, rank, hash)."""
    own = leaves.select("group", "last", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "hash")
    alone = stored(own.where(TOP), f"{name}-alone")
    most, levels = leaves.agg(F.max("last")).first()[0] or 0, []
    while FANOUT ** len(levels) <= most:  # as many rounds as the tree has levels
        below_top = (levels[-1] if levels else own).where(f"not ({TOP})")
        levels.append(stored(level_up(below_top, len(levels) + 1), f"{name}-{len(levels) + 1}"))
    no_path = F.array().cast(PATH).alias("path")
    columns = ("group", "last", "lo", "hi", "children")
    found = None
    for level in range(len(levels), 0, -1):
        tops = levels[level - 1].where(TOP).select(*columns, no_path)
        nodes = levels[level - 1].where(f"not ({TOP})").select(*columns)
        found = stored(tops if found is None else tops.unionByName(below(found, nodes, level + 1)), f"{name}-paths")
    lone = alone.select(*columns[:-1], F.array(F.struct("lo", "hi", "hash")).alias("children"), no_path)
    roots = reduce(DataFrame.unionByName, [t.where(TOP).select("group", "hash") for t in [alone, *levels]])
    return roots, lone if found is None else found.unionByName(lone)


def paths(leaves: DataFrame, lowest: DataFrame) -> DataFrame:
    """``leaves`` with their paths to their group's root."""
    lone = leaves.where("last = 0").withColumn("path", F.array().cast(PATH))
    spread = leaves.where("last > 0").select("*", F.col("rank").alias("lo"), F.col("rank").alias("hi"))
    return below(lowest.where("last > 0"), spread, 1).drop("lo", "hi").unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.concat(p["left"], h, p["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, rank, leaf, tampered, subroot, root, path, above) of every row. ``path`` has the siblings, left and right,
    of each level up to the language's root, ``above`` those from there to the root; ``tampered`` is the leaf of the row as
    tampering leaves it, null where the row is left alone."""
    spoilt = [F.translate(F.col(f).cast("string"), UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    rows = docs.select(
        "doc_id", F.col("lang").cast("string").alias("group"), leaf([F.col(f) for f in FIELDS]).alias("hash"),
        F.when(id_text_crc("doc_id") % 3 == 0, leaf(spoilt)).alias("tampered"),
    )
    rows = ranked(rows, ["doc_id", "hash"], "leaves")
    subroots, lowest = tree(rows, "tree")
    langs = ranked(subroots.select(F.lit(0).alias("group"), F.col("group").alias("lang"), "hash"), ["lang"], "subroots")
    roots, top = tree(langs, "top")
    langs = paths(langs, top).join(roots.select(F.col("group").alias("all"), F.col("hash").alias("root")), F.col("group") == F.col("all"))
    langs = stored(langs.select(F.col("lang").alias("own_lang"), F.col("hash").alias("subroot"), "root", F.col("path").alias("above")), "langs")
    of_lang = rows.join(langs, F.col("group").eqNullSafe(F.col("own_lang"))).drop("own_lang")
    return paths(of_lang, lowest).select("doc_id", F.col("group").alias("lang"), "rank", F.col("hash").alias("leaf"), "tampered", "subroot", "root", "path", "above")


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`manifest` with the digest of each proof, and the root that the leaf found folds to."""
    way = F.concat("path", "above")
    proof = digest(F.array_join(F.transform(way, lambda p: F.concat(p["left"], p["right"])), ""))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), way).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    return verified(manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql(levels: int) -> str:
    """Both trees level by level; ``levels`` suffice for FANOUT ** levels leaves of a language."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf_of = lambda text: "sha256(" + " || ".join(enc(text if f == "text" else f) for f in FIELDS) + ")"
    crc = "list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: "
    crc = f"""xor(4294967295::BIGINT, {crc}list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""
    out = [f"""x AS MATERIALIZED (SELECT doc_id, lang AS g, {leaf_of("text")} AS h, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 3 = 0 THEN {leaf_of(low)} END AS spoilt FROM documents),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM x)"""]

    def climb(tag: str, first: str) -> None:
        out.append(f"{tag}0 AS MATERIALIZED ({first})")
        for k in range(levels):
            out.append(
                f"{tag}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h "
                f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {tag}{k}) GROUP BY g, i // 8, n)"
            )

    climb("n", "SELECT g, i, h FROM l")
    climb("t", f"SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS lang FROM n{levels}")
    out.append("f0 AS MATERIALIZED (SELECT l.doc_id, l.g, l.i, l.h AS leaf, coalesce(spoilt, l.h) AS c, '' AS proof, t0.i AS ti, t0.h AS subroot FROM l JOIN t0 ON l.g IS NOT DISTINCT FROM t0.lang)")
    for k, (tag, own, place) in enumerate([*((f"n{k}", "g", f"f0.i // {8**k}") for k in range(levels)), *((f"t{k}", "0", f"f0.ti // {8**k}") for k in range(levels))]):
        at = place.replace("f0", f"f{k}")
        out.append(
            f"s{k} AS MATERIALIZED (SELECT g, i, n, (SELECT coalesce(string_agg(b.h, '' ORDER BY b.i), '') FROM {tag} b WHERE b.g IS NOT DISTINCT FROM a.g AND b.i // 8 = a.i // 8 AND b.i < a.i) AS l, "
            f"(SELECT coalesce(string_agg(b.h, '' ORDER BY b.i), '') FROM {tag} b WHERE b.g IS NOT DISTINCT FROM a.g AND b.i // 8 = a.i // 8 AND b.i > a.i) AS r FROM (SELECT g, i, count(*) OVER (PARTITION BY g) AS n FROM {tag}) a)"
        )
        out.append(
            f"f{k + 1} AS MATERIALIZED (SELECT doc_id, f{k}.g, f{k}.i, leaf, CASE WHEN n > 1 THEN sha256(s{k}.l || c || s{k}.r) ELSE c END AS c, proof || s{k}.l || s{k}.r AS proof, ti, subroot "
            f"FROM f{k} JOIN s{k} ON s{k}.g IS NOT DISTINCT FROM {own if own == '0' else f'f{k}.g'} AND s{k}.i = {at})"
        )
    last = 2 * levels
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, c AS folded_root, c = t.h AS verified FROM f{last}, t{levels} t"


#: For up to 8 ** 5 rows of a language.
SQL = _sql(5)
