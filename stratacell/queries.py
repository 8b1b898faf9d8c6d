"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotations as an
from .operators import catalog, chat, matrix, neighbours, stats, strata
from .plans import router
from .sources import store as st
from .sources import store_io
from .streaming import progress, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    """Floating columns to six digits; the sign of zero goes."""
    return df.select(*[(F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def R(x: str) -> str:
    return f"(round({x}, {DIGITS}) + 0.0)"


DENSE = """dx AS (SELECT vec_id AS cell_id, CAST(label AS VARCHAR) AS label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS gene_id FROM embeddings)"""
SPARSE = """sx AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
so AS (SELECT o_orderkey AS cell_id, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, n_name AS nation, o_totalprice AS total_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _two_sample(a: str, b: str, tail: str) -> str:
    """SQL of the two-sample statistics from table s(.., sa, qa, na, sb, qb, nb)."""
    va, vb = (f"CASE WHEN n{k} < 2 THEN 0 ELSE greatest((q{k} - s{k} * s{k} / n{k}) / (n{k} - 1), 0) END" for k in "ab")
    return f"""m AS (SELECT *, sa / na AS ma, sb / nb AS mb, {va} AS va, {vb} AS vb FROM s),
e AS (SELECT *, (ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 0) AS d, (ma - mb) / nullif(sqrt(va / na + vb / nb), 0) AS t FROM m) {tail}"""


def _compare_sql(n: int, where_a: str, where_b: str) -> str:
    return f"""WITH {DENSE}, c AS (SELECT count(*) FILTER ({where_a}) AS na, count(*) FILTER ({where_b}) AS nb FROM (SELECT CAST(label AS VARCHAR) AS label FROM embeddings)),
s AS (SELECT gene_id, coalesce(sum(v) FILTER ({where_a}), 0) AS sa, coalesce(sum(v * v) FILTER ({where_a}), 0) AS qa, coalesce(sum(v) FILTER ({where_b}), 0) AS sb, coalesce(sum(v * v) FILTER ({where_b}), 0) AS qb, any_value(na) AS na, any_value(nb) AS nb FROM dx, c GROUP BY gene_id),
""" + _two_sample("a", "b", f"SELECT CAST(gene_id AS INTEGER) AS gene_id, {R('ma')} AS mean_a, {R('mb')} AS mean_b, {R('d')} AS cohens_d, {R('t')} AS t, na AS n_a, nb AS n_b FROM e ORDER BY abs(d) DESC NULLS LAST, gene_id LIMIT {n}")


@query(_compare_sql(10, "WHERE label = '1'", "WHERE label = '2'"))
def compare_groups_scan(spark, d):
    s = st.dense_store(spark, d)
    return rounded(stats.compare_groups(*stats.group_sums(s, "label"), s.var, "1", "2", 10))


@query(_compare_sql(10, "WHERE label = '3'", "WHERE label <> '3'"))
def find_markers(spark, d):
    s = st.dense_store(spark, d)
    return rounded(stats.find_markers(*stats.group_sums(s, "label"), s.var, "3", 10))


_SPARSE_COMPARE = f"""WITH {SPARSE}, c AS (SELECT count(*) FILTER (WHERE priority = '1-URGENT') AS na, count(*) FILTER (WHERE priority = '5-LOW') AS nb FROM so),
g AS (SELECT gene_id, sum(v) FILTER (WHERE priority = '1-URGENT') AS sa, sum(v * v) FILTER (WHERE priority = '1-URGENT') AS qa, sum(v) FILTER (WHERE priority = '5-LOW') AS sb, sum(v * v) FILTER (WHERE priority = '5-LOW') AS qb FROM sx JOIN so USING (cell_id) GROUP BY gene_id),
s AS (SELECT p_partkey AS gene_id, coalesce(sa, 0) AS sa, coalesce(qa, 0) AS qa, coalesce(sb, 0) AS sb, coalesce(qb, 0) AS qb, na, nb FROM part LEFT JOIN g ON p_partkey = gene_id, c),
""" + _two_sample("a", "b", f"SELECT gene_id, {R('ma')} AS mean_a, {R('mb')} AS mean_b, {R('d')} AS cohens_d, {R('t')} AS t, na AS n_a, nb AS n_b FROM e ORDER BY abs(d) DESC NULLS LAST, gene_id LIMIT 20")


def _atomic(spark, d):
    s = st.sparse_store(spark, d)
    axes = ("priority", "status", "segment")
    return s, strata.build_atomic(s, axes), strata.strata_cells(s, axes)


@query(_SPARSE_COMPARE)
def compare_groups_strata(spark, d):
    """Two priorities compared from the atomic strata: no second pass over the matrix."""
    s, a, c = _atomic(spark, d)
    return rounded(stats.compare_groups(*strata.as_groups(a, c, "priority"), s.var, "1-URGENT", "5-LOW", 20))


@query(_SPARSE_COMPARE)
def compare_groups_sparse_scan(spark, d):
    s = st.sparse_store(spark, d)
    return rounded(stats.compare_groups(*stats.group_sums(s, "priority"), s.var, "1-URGENT", "5-LOW", 20))


@query(f"""WITH {DENSE}, c AS (SELECT CAST(label AS VARCHAR) AS g, count(*) AS na FROM embeddings GROUP BY 1), t AS (SELECT count(*) AS n FROM embeddings),
k AS (SELECT label, gene_id, sum(v) AS sa, sum(v * v) AS qa FROM dx GROUP BY ALL),
s AS (SELECT label, gene_id, sa, qa, na, sum(sa) OVER (PARTITION BY gene_id) - sa AS sb, sum(qa) OVER (PARTITION BY gene_id) - qa AS qb, n - na AS nb FROM k JOIN c ON label = g, t),
""" + _two_sample("a", "b", f"SELECT label AS \"group\", CAST(rank AS INTEGER) AS rank, CAST(gene_id AS INTEGER) AS gene_id, {R('ma')} AS mean_a, {R('mb')} AS mean_b, {R('d')} AS cohens_d, {R('t')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(d) DESC NULLS LAST, gene_id) AS rank FROM e) WHERE rank <= 5"))
def find_markers_all_groups(spark, d):
    s = st.dense_store(spark, d)
    return rounded(stats.markers_of_all_groups(*stats.group_sums(s, "label"), s.var, 5))


_SPARSE_MARKERS = f"""WITH {SPARSE}, c AS (SELECT priority AS g, count(*) AS na FROM so GROUP BY 1), t AS (SELECT count(*) AS n FROM so),
k AS (SELECT priority AS g, gene_id, sum(v) AS x, sum(v * v) AS xx FROM sx JOIN so USING (cell_id) GROUP BY ALL),
z AS (SELECT g, na, p_partkey AS gene_id, coalesce(x, 0) AS sa, coalesce(xx, 0) AS qa FROM c CROSS JOIN part LEFT JOIN k USING (g, gene_id)),
s AS (SELECT g, gene_id, sa, qa, na, sum(sa) OVER (PARTITION BY gene_id) - sa AS sb, sum(qa) OVER (PARTITION BY gene_id) - qa AS qb, n - na AS nb FROM z, t),
""".replace("LEFT JOIN k USING (g, gene_id)", "LEFT JOIN k ON k.g = c.g AND k.gene_id = p_partkey").replace("SELECT g, na,", "SELECT c.g, na,") + _two_sample("a", "b", f"SELECT g AS \"group\", CAST(rank AS INTEGER) AS rank, gene_id, {R('ma')} AS mean_a, {R('mb')} AS mean_b, {R('d')} AS cohens_d, {R('t')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(d) DESC NULLS LAST, gene_id) AS rank FROM e) WHERE rank <= 20")


@query(_SPARSE_MARKERS)
def find_markers_all_groups_sparse(spark, d):
    """Over a store that leaves zeros out: a gene that a group does not express is among its markers."""
    s = st.sparse_store(spark, d)
    return rounded(stats.markers_of_all_groups(*stats.group_sums(s, "priority"), s.var, 20))


_ROOTS: dict[tuple[str, str], str] = {}


def _stored(spark, d, *parts: str) -> tuple[str, st.Store]:
    """The sparse store on disk, written once for a session and input, with those of the further ``parts`` (layers, obsp, strata) that have
    been asked for, each written once when it first is: (root, the store read back)."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ROOTS:
        root = store_io.new_root(spark)
        store_io.write_store(root, st.sparse_store(spark, d))
        _ROOTS[key] = root
    root = _ROOTS[key]
    s = store_io.open_store(spark, root)
    missing = [p for p in parts if p not in {r["part"] for r in s.parts}]
    if "layers" in missing:
        store_io.add_part(root, "layers", s.x.withColumn("value", F.col("value") * 2), "doubled", staged=True)
    if "obsp" in missing:
        store_io.add_part(root, "obsp", s.x.select(F.col("cell_id").alias("row_id"), F.col("gene_id").alias("col_id"), "value"), "same_gene")
    if "strata" in missing:
        router.build_strata(spark, root, s, ["priority", "status", "segment"], [["priority"], ["status", "segment"]])
    return root, store_io.open_store(spark, root) if missing else s


@query(_SPARSE_COMPARE)
def compare_groups_routed(spark, d):
    """The same comparison, from the smallest stored strata that cover it."""
    root, s = _stored(spark, d, "strata")
    return rounded(router.compare_groups(spark, root, s, "priority", "1-URGENT", "5-LOW", 20))


@query(_SPARSE_MARKERS)
def find_markers_routed(spark, d):
    root, s = _stored(spark, d, "strata")
    return rounded(router.markers_of_all_groups(spark, root, s, "priority", 20))


_TOP = f"""WITH {SPARSE}, n AS (SELECT count(*) AS n FROM so WHERE priority = '1-URGENT')
SELECT gene_id, {R("sum(v) / any_value(n)")} AS mean, {R("count(*) FILTER (WHERE v > 0) / any_value(n)")} AS fraction FROM sx JOIN so USING (cell_id), n WHERE priority = '1-URGENT' GROUP BY gene_id ORDER BY sum(v) / any_value(n) DESC, gene_id LIMIT 10"""


@query(_TOP)
def top_expressed_genes(spark, d):
    return rounded(stats.top_expressed(st.sparse_store(spark, d), "priority", "1-URGENT", 10))


@query(_TOP)
def top_expressed_routed(spark, d):
    root, s = _stored(spark, d, "strata")
    return rounded(router.top_expressed(spark, root, s, "priority", "1-URGENT", 10))


@query(f"""WITH {SPARSE}, c AS (SELECT status, count(*) AS n FROM so GROUP BY 1), a AS (SELECT status, gene_id, sum(v) AS s, count(*) FILTER (WHERE v > 0) AS z FROM sx JOIN so USING (cell_id) GROUP BY ALL)
SELECT c.status AS "group", CAST(g AS BIGINT) AS gene_id, n AS n_cells, {R("coalesce(s, 0) / n")} AS mean, {R("coalesce(z, 0) / n")} AS fraction FROM c CROSS JOIN (VALUES (3), (4), (11)) v(g) LEFT JOIN a ON a.status = c.status AND a.gene_id = g""")
def gene_panel_routed(spark, d):
    """A panel by an axis that only a coarse table of two axes covers."""
    root, s = _stored(spark, d, "strata")
    return rounded(router.gene_panel(spark, root, s, "status", [3, 4, 11]).withColumn("gene_id", F.col("gene_id").cast("long")))


def _ingested(spark, d, store: st.Store | None = None) -> tuple[str, st.Store]:
    """A store of its own with strata over the priority, and over the priority and the status: (root, the store that was written)."""
    root, s = store_io.new_root(spark), store or st.sparse_store(spark, d)
    s = replace(s, x=store_io.staged_in(root, s.x))  # what overwrites it is derived from it
    store_io.write_store(root, s, staged=True)
    router.build_strata(spark, root, store_io.open_store(spark, root), ["priority", "status"], [["priority"]])
    return root, s


_TWICE = SPARSE.replace("sum(l_quantity)", "2 * sum(l_quantity)")


@query(_TOP.replace(SPARSE, _TWICE))
def top_expressed_after_overwrite(spark, d):
    """The matrix is overwritten under the strata: the answer is that of the new one."""
    root, s = _ingested(spark, d)
    store_io.add_part(root, "x", s.x.withColumn("value", F.col("value") * 2), overwrite=True, staged=True)
    return rounded(router.top_expressed(spark, root, store_io.open_store(spark, root), "priority", "1-URGENT", 10))


@query(_SPARSE_COMPARE.replace(SPARSE, _TWICE))
def compare_groups_after_rebuild(spark, d):
    """Overwritten and rebuilt without the coarse table: the atomic one of the new matrix answers, not the old coarse one."""
    root, s = _ingested(spark, d)
    store_io.add_part(root, "x", s.x.withColumn("value", F.col("value") * 2), overwrite=True, staged=True)
    new = store_io.open_store(spark, root)
    router.build_strata(spark, root, new, ["priority", "status"], force=True)
    return rounded(router.compare_groups(spark, root, store_io.open_store(spark, root), "priority", "1-URGENT", "5-LOW", 20))


@query("""WITH n AS (SELECT (SELECT count(*) FROM orders) AS obs, (SELECT count(*) FROM part) AS var, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS x,
(SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)) AS cells, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS groups, (SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) AS sums,
(SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) AS coarse,
(SELECT count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) + count(DISTINCT c_mktsegment) + count(DISTINCT n_name) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS labels)
SELECT unnest(['obs', 'var', 'x', 'categories', 'strata/atomic', 'strata/priority', 'strata_cells/atomic', 'strata_cells/priority']) AS part, unnest([obs, var, x, labels, sums, coarse, cells, groups]) AS rows FROM n""")
def store_layout(spark, d):
    """What a store has on disk, by its log."""
    root, _ = _ingested(spark, d)
    return store_io.actual_layout(spark, root).select(F.concat_ws("/", "part", F.nullif("key", F.lit(""))).alias("part"), "rows")


@query(f"""WITH {SPARSE} SELECT priority, status, rank() OVER (ORDER BY priority, status) AS place, count(*) AS n_cells FROM so GROUP BY priority, status""")
def strata_in_order(spark, d):
    """The strata of a stored table in their order."""
    root, _ = _ingested(spark, d)
    cells = store_io.strata_keys(spark, root, "atomic")  # strata.MOST_TUPLES at most
    rows = strata.in_order(cells.withColumn("gene_id", F.lit(0)), ["priority", "status"]).collect()
    return spark.createDataFrame([(r["priority"], r["status"], k + 1, r["n_cells"]) for k, r in enumerate(rows)], "priority string, status string, place long, n_cells long")


@query("""SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings""")
def stored_embedding(spark, d):
    """An embedding that was written and read back, and a failing overwrite of it that leaves it as it was."""
    root, s = store_io.new_root(spark), st.dense_store(spark, d)
    store_io.write_store(root, s)
    try:
        store_io.add_part(root, "obsm", s.embedding("X_2d"), "X_2d")
    except store_io.PartExists:
        return store_io.open_store(spark, root).embedding("X_2d").select("cell_id", F.col("coords")[0].cast("double").alias("x"), F.col("coords")[1].cast("double").alias("y"))
    raise AssertionError("a part was replaced unasked")


@query(f"""WITH {SPARSE} SELECT cell_id, list(gene_id ORDER BY gene_id)::VARCHAR AS indices, {R("sum(v)")} AS total FROM sx GROUP BY 1""")
def stored_by_cell(spark, d):
    """A matrix laid out by cell, with 32-bit indices, and read back as compressed rows."""
    root = store_io.new_root(spark)
    store_io.write_store(root, st.sparse_store(spark, d), order="cell", int32=True)
    rows = st.csr_from_coo(store_io.open_store(spark, root).x)
    return rounded(rows.select(F.col("row").alias("cell_id"), F.concat(F.lit("["), F.array_join("indices", ", "), F.lit("]")).alias("indices"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"""WITH {SPARSE} SELECT cell_id, coalesce(v, 0) AS value FROM so LEFT JOIN (SELECT * FROM sx WHERE gene_id = 7) USING (cell_id)""")
def stored_gene_column(spark, d):
    """One gene of a store that was written and read back, laid out by gene."""
    return _stored(spark, d)[1].gene(7)


@query(f"""WITH {SPARSE} SELECT cell_id, {R("2 * coalesce(sum(v), 0)")} AS total FROM so LEFT JOIN sx USING (cell_id) GROUP BY 1""")
def stored_layer_totals(spark, d):
    return rounded(matrix.cell_totals(_stored(spark, d, "layers")[1].from_layer("doubled")))


@query(f"""WITH {SPARSE} SELECT cell_id AS row_id, gene_id AS col_id, {R("v")} AS value FROM sx""")
def stored_pairs(spark, d):
    return rounded(_stored(spark, d, "obsp")[1].obsp["same_gene"])


@query(f"""WITH {SPARSE}, l AS (SELECT 'status' AS "column", status AS label FROM so UNION SELECT 'priority', priority FROM so UNION SELECT 'segment', segment FROM so UNION SELECT 'nation', nation FROM so)
SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY label) - 1 AS INTEGER) AS code, label FROM l""")
def stored_categories(spark, d):
    return _stored(spark, d)[1].categories.select("column", "code", "label")


@query(f"""WITH {SPARSE} SELECT priority, gene_id, {R("sum(v)")} AS sum_x, {R("sum(v * v)")} AS sum_xx, count(*) FILTER (WHERE v > 0) AS nnz FROM sx JOIN so USING (cell_id) WHERE priority IN ('1-URGENT', '5-LOW') AND gene_id IN (3, 4, 11) GROUP BY ALL""")
def strata_of_genes_and_rows(spark, d):
    """A few genes of a few strata from a stored table."""
    rows = spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "priority string")
    return rounded(store_io.read_strata(spark, _stored(spark, d, "strata")[0], "priority", [3, 4, 11], rows)[0])


@query(f"""WITH {SPARSE} SELECT status, segment, count(*) AS n_cells FROM so GROUP BY ALL""")
def strata_keys(spark, d):
    return store_io.strata_keys(spark, _stored(spark, d, "strata")[0], "status-segment")


@query("SELECT true AS has_atomic, CAST(2 AS BIGINT) AS n_coarse, 'priority,status-segment' AS coarse FROM (SELECT count(*) FROM orders)")
def strata_summary(spark, d):
    return store_io.strata_summary(spark, _stored(spark, d, "strata")[0]).withColumn("coarse", F.array_join("coarse", ","))


@query(f"""WITH {DENSE}, x AS (SELECT * FROM dx WHERE label = '4'), n AS (SELECT count(*) AS n FROM embeddings WHERE label = 4), f AS (SELECT gene_id, min(v) AS floor FROM x GROUP BY 1)
SELECT CAST(gene_id AS INTEGER) AS gene_id, {R("sum(v) / any_value(n)")} AS mean, {R("count(*) FILTER (WHERE v > floor) / any_value(n)")} AS fraction FROM x JOIN f USING (gene_id), n GROUP BY gene_id ORDER BY sum(v) / any_value(n) DESC, gene_id LIMIT 10""")
def top_expressed_above_min(spark, d):
    return rounded(stats.top_expressed(st.dense_store(spark, d), "label", "4", 10, "above_min"))


@query(f"""WITH {DENSE}, c AS (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label AS "group", CAST(gene_id AS INTEGER) AS gene_id, {R("sum(v) / any_value(n)")} AS mean, {R("count(*) FILTER (WHERE v > 0) / any_value(n)")} AS fraction, any_value(n) AS n_cells FROM dx JOIN c USING (label) WHERE gene_id IN (0, 5, 9) GROUP BY ALL""")
def gene_panel_by_obs(spark, d):
    return rounded(stats.gene_panel(st.dense_store(spark, d), "label", [0, 5, 9]))


@query(f"""WITH {DENSE}, c AS (SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT gene_id, min(v) AS floor FROM dx GROUP BY 1)
SELECT label AS "group", CAST(gene_id AS INTEGER) AS gene_id, {R("sum(v) / any_value(n)")} AS mean, {R("count(*) FILTER (WHERE v > floor) / any_value(n)")} AS fraction, any_value(n) AS n_cells FROM dx JOIN c USING (label) JOIN f USING (gene_id) WHERE gene_id IN (1, 2, 63) GROUP BY ALL""")
def gene_panel_above_min(spark, d):
    return rounded(stats.gene_panel(st.dense_store(spark, d), "label", [1, 2, 63], "above_min"))


_GAPS = DENSE.replace("CAST(label AS VARCHAR) AS label", "nullif(CAST(label AS VARCHAR), '4') AS label")


@query(f"""WITH {_GAPS}, c AS (SELECT nullif(CAST(label AS VARCHAR), '4') AS label, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT gene_id, min(v) AS floor FROM dx WHERE label IS NOT NULL GROUP BY 1)
SELECT dx.label AS "group", CAST(gene_id AS INTEGER) AS gene_id, {R("sum(v) / any_value(n)")} AS mean, {R("count(*) FILTER (WHERE v > floor) / any_value(n)")} AS fraction, any_value(n) AS n_cells FROM dx JOIN c ON c.label IS NOT DISTINCT FROM dx.label JOIN f USING (gene_id) WHERE gene_id IN (1, 2, 63) GROUP BY ALL""")
def gene_panel_above_min_gaps(spark, d):
    """The least value is that of the labelled cells; some cells have no label."""
    s = st.dense_store(spark, d)
    s = replace(s, obs=s.obs.withColumn("label", F.nullif("label", F.lit("4"))))
    return rounded(stats.gene_panel(s, "label", [1, 2, 63], "above_min"))


@query(f"""WITH {SPARSE}, c AS (SELECT priority, count(*) AS n FROM so GROUP BY 1), a AS (SELECT priority, gene_id, sum(v) AS s, count(*) FILTER (WHERE v > 0) AS z FROM sx JOIN so USING (cell_id) GROUP BY ALL)
SELECT c.priority AS "group", CAST(g AS BIGINT) AS gene_id, n AS n_cells, {R("coalesce(s, 0) / n")} AS mean, {R("coalesce(z, 0) / n")} AS fraction FROM c CROSS JOIN (VALUES (3), (4), (11)) v(g) LEFT JOIN a ON a.priority = c.priority AND a.gene_id = g""")
def strata_dotplot(spark, d):
    _, a, c = _atomic(spark, d)
    return rounded(strata.dotplot(a, c, "priority", [3, 4, 11]).withColumn("gene_id", F.col("gene_id").cast("long")))


@query(f"""WITH {SPARSE}, z AS (SELECT priority AS g, coalesce(v, 0) AS v FROM so LEFT JOIN (SELECT * FROM sx WHERE gene_id = 7) USING (cell_id))
SELECT g AS "group", {R("avg(v)")} AS mean, {R("avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END)")} AS fraction, count(*) AS n_cells FROM z GROUP BY GROUPING SETS ((), (g))""")
def gene_expression_summary(spark, d):
    return rounded(stats.gene_summary(st.sparse_store(spark, d), 7, "priority"))


_ATOMIC_SQL = f"""WITH {SPARSE} SELECT priority, status, segment, p_type AS type, {R("sum(v)")} AS sum_x, {R("sum(v * v)")} AS sum_xx, count(*) FILTER (WHERE v > 0) AS nnz
FROM sx JOIN so USING (cell_id) JOIN part ON gene_id = p_partkey GROUP BY ALL"""


@query(_ATOMIC_SQL)
def build_atomic(spark, d):
    s = st.sparse_store(spark, d)
    return rounded(strata.build_atomic(s, ("priority", "status", "segment"), s.var.select("gene_id", "type"), "type"))


@query(_ATOMIC_SQL.replace("status, segment, p_type", "p_type"))
def derive_coarse(spark, d):
    return rounded(strata.derive_coarse(build_atomic(spark, d), ["priority"], "type"))


@query(f"""WITH {SPARSE} SELECT priority, segment, p_type AS type, CAST(grouping(priority, segment, p_type) AS BIGINT) AS level, {R("sum(v)")} AS sum_x, {R("sum(v * v)")} AS sum_xx, count(*) FILTER (WHERE v > 0) AS nnz
FROM sx JOIN so USING (cell_id) JOIN part ON gene_id = p_partkey GROUP BY GROUPING SETS ((priority, segment, p_type), (priority, p_type), (p_type))""")
def strata_grouping_sets(spark, d):
    return rounded(strata.grouping_sets(build_atomic(spark, d), [["priority", "segment"], ["priority"], []], "type"))


@query(f"""WITH {SPARSE}, n AS (SELECT priority, count(*) AS n FROM so GROUP BY 1), a AS (SELECT priority, gene_id, sum(v) AS s, sum(v * v) AS q, count(*) FILTER (WHERE v > 0) AS z FROM sx JOIN so USING (cell_id) GROUP BY ALL)
SELECT priority, gene_id, n AS n_cells, {R("s / n")} AS mean, {R("z / n")} AS fraction, {R("CASE WHEN n < 2 THEN 0 ELSE greatest((q - s * s / n) / (n - 1), 0) END")} AS variance FROM a JOIN n USING (priority)""")
def strata_means_var_frac(spark, d):
    s = st.sparse_store(spark, d)
    return rounded(strata.statistics(strata.build_atomic(s, ["priority"]), strata.strata_cells(s, ["priority"]), ["priority"]))


@query(f"""WITH {SPARSE}, t AS (SELECT count(*) AS tuples FROM (SELECT DISTINCT priority, segment, nation FROM so))
SELECT axis, labels, {R("null_share")} AS null_share, tuples, tuples <= 50000 AND null_share <= 0.05 AS ok FROM t, (
SELECT 'priority' AS axis, count(DISTINCT priority) AS labels, avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0 END) AS null_share FROM so UNION ALL
SELECT 'segment', count(DISTINCT segment), avg(CASE WHEN segment IS NULL THEN 1.0 ELSE 0 END) FROM so UNION ALL SELECT 'nation', count(DISTINCT nation), avg(CASE WHEN nation IS NULL THEN 1.0 ELSE 0 END) FROM so)""")
def strata_preflight(spark, d):
    return rounded(strata.preflight(st.sparse_store(spark, d), ["priority", "segment", "nation"]))


@query(f"""WITH {SPARSE}, t AS (SELECT count(*) AS tuples FROM (SELECT DISTINCT priority, segment, nation FROM so))
SELECT axis, labels, CAST(0 AS DOUBLE) AS null_share, true AS near, tuples <= 50000 AS ok FROM t, (SELECT 'priority' AS axis, count(DISTINCT priority) AS labels FROM so UNION ALL SELECT 'segment', count(DISTINCT segment) FROM so UNION ALL SELECT 'nation', count(DISTINCT nation) FROM so)""")
def strata_preflight_sketched(spark, d):
    """The same from sketches of two parts of the cells, stored, added up and read back; ``near``: the count of tuples is within 2 %."""
    s, axes, root = st.sparse_store(spark, d), ["priority", "segment", "nation"], store_io.new_root(spark)
    parts = [strata.axis_sketches(s.obs.where(f"cell_id % 3 {sign} 0"), axes) for sign in ("=", "<>")]
    store_io.add_part(root, "sketches", strata.merge_sketches(parts))
    tuples = s.obs.select(*axes).distinct().count()
    found = strata.sketched_preflight(store_io.read_part(spark, root, "sketches"), axes)
    return found.select("axis", "labels", "null_share", F.lit(tuples).between(F.col("at_least"), F.col("at_most")).alias("near"), "ok")


@query("""WITH c AS (SELECT p_name AS label, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1), t AS (SELECT sum(n) AS total FROM c), k AS (SELECT * FROM c ORDER BY n DESC, f LIMIT 50)
SELECT label, n, CAST(total AS BIGINT) AS total, CAST(total - sum(n) OVER () AS BIGINT) AS other FROM k, t""")
def describe_categorical(spark, d):
    return an.describe_categorical(st.sparse_store(spark, d).var, "var_name", "gene_id")


@query(f"""SELECT count(p_retailprice) AS n, {R("min(p_retailprice)")} AS low, {R("max(p_retailprice)")} AS high, {R("avg(p_retailprice)")} AS mean, {R("quantile_cont(p_retailprice, 0.25)")} AS q1,
{R("quantile_cont(p_retailprice, 0.5)")} AS median, {R("quantile_cont(p_retailprice, 0.75)")} AS q3, {R("stddev_pop(p_retailprice)")} AS spread FROM part""")
def describe_numeric(spark, d):
    return rounded(an.describe_numeric(st.sparse_store(spark, d).var, "price"))


@query(f"""WITH {SPARSE} SELECT nation AS "group", count(*) AS n_cells, round_even(count(*) / sum(count(*)) OVER (), 4) AS fraction FROM so GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def cluster_stats(spark, d):
    return an.cluster_stats(st.sparse_store(spark, d).obs, "nation")


@query("""SELECT p_partkey AS gene_id, p_name AS label, false AS capped FROM part WHERE contains(lower(p_name), 're') ORDER BY 1 LIMIT 25""")
def search_genes(spark, d):
    return an.search_genes(st.sparse_store(spark, d).var, "RE", 25)


@query("SELECT p_name AS symbol, min(p_partkey) AS gene_id FROM part GROUP BY 1")
def gene_symbol_map(spark, d):
    return an.symbol_map(st.sparse_store(spark, d).var)


@query(f"""WITH {SPARSE} SELECT * FROM (SELECT priority AS "group", nation AS label, {R("count(*) / any_value(n)")} AS share FROM so JOIN (SELECT priority, count(*) AS n FROM so GROUP BY 1) USING (priority)
WHERE priority IN ('1-URGENT', '5-LOW') AND nation IN (SELECT nation FROM (SELECT nation, row_number() OVER (ORDER BY sum(s) DESC, nation) AS r FROM (SELECT nation, count(*) / any_value(n) AS s FROM so JOIN (SELECT priority, count(*) AS n FROM so GROUP BY 1) USING (priority) WHERE priority IN ('1-URGENT', '5-LOW') GROUP BY priority, nation) GROUP BY nation) WHERE r <= 10) GROUP BY 1, 2
UNION ALL SELECT priority, 'All other', {R("count(*) / any_value(n)")} FROM so JOIN (SELECT priority, count(*) AS n FROM so GROUP BY 1) USING (priority)
WHERE priority IN ('1-URGENT', '5-LOW') AND nation NOT IN (SELECT nation FROM (SELECT nation, row_number() OVER (ORDER BY round(sum(s), 12) DESC, nation) AS r FROM (SELECT nation, count(*) / any_value(n) AS s FROM so JOIN (SELECT priority, count(*) AS n FROM so GROUP BY 1) USING (priority) WHERE priority IN ('1-URGENT', '5-LOW') GROUP BY priority, nation) GROUP BY nation) WHERE r <= 10) GROUP BY 1)""".replace("ORDER BY sum(s) DESC", "ORDER BY round(sum(s), 12) DESC"))
def bar_composition(spark, d):
    return rounded(an.bar_composition(st.sparse_store(spark, d).obs, "priority", ["1-URGENT", "5-LOW"], "nation"))


@query(f"""WITH {SPARSE} SELECT g AS "group", count(cell_id) AS n_cells FROM (VALUES ('F'), ('O'), ('none')) v(g) LEFT JOIN (SELECT * FROM so WHERE segment = 'BUILDING') ON g = status GROUP BY 1""")
def bar_counts(spark, d):
    return an.bar_counts(st.sparse_store(spark, d).obs, "status", ["F", "O", "none", "F"], {"segment": "BUILDING"})


@query(f"""WITH {DENSE}, x AS (SELECT * FROM dx WHERE label IN ('1', '2') AND gene_id IN (0, 3)), f AS (SELECT gene_id, min(v) AS floor FROM x GROUP BY 1)
SELECT label AS "group", CAST(gene_id AS INTEGER) AS gene_id, {R("avg(v)")} AS mean, {R("count(*) FILTER (WHERE v > floor) / count(*)")} AS fraction, count(*) AS n_cells FROM x JOIN f USING (gene_id) GROUP BY ALL""")
def bar_gene_mean(spark, d):
    return rounded(an.bar_gene_mean(st.dense_store(spark, d), "label", ["1", "2"], [0, 3]))


@query(f"""WITH {SPARSE} SELECT cell_id, priority, nation FROM so WHERE cell_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)""")
def filter_by_ids(spark, d):
    ids = st.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select("l_orderkey").distinct()
    return an.filter_by_ids(st.sparse_store(spark, d).obs, "cell_id", ids).select("cell_id", "priority", "nation")


@query(f"""WITH {SPARSE}, z AS (SELECT cell_id, coalesce(v, 0) AS value FROM so LEFT JOIN (SELECT * FROM sx WHERE gene_id = 5) USING (cell_id)) SELECT * FROM z WHERE value BETWEEN 0 AND 20""")
def filter_by_expression(spark, d):
    return an.filter_by_expression(st.sparse_store(spark, d), 5, 0, 20)


@query(f"""WITH {SPARSE} SELECT cell_id, status, total_price FROM so WHERE segment = 'MACHINERY'""")
def obs_mask(spark, d):
    return an.mask(st.sparse_store(spark, d), "segment", "MACHINERY").select("cell_id", "status", "total_price")


@query(f"SELECT vec_id AS cell_id, {R('embedding[1]::DOUBLE')} AS x, {R('embedding[2]::DOUBLE')} AS y, {R('embedding[6]::DOUBLE')} AS value FROM embeddings")
def color_by_gene(spark, d):
    c = an.color_by_gene(st.dense_store(spark, d), 5, "X_2d")
    return rounded(c.select("cell_id", *[F.col(k).cast("double").alias(k) for k in ("x", "y", "value")]))


@query(f"SELECT vec_id AS cell_id, {R('embedding[1]::DOUBLE')} AS x, {R('embedding[2]::DOUBLE')} AS y, CAST(label AS VARCHAR) AS label, label IN (1, 2) AS highlighted FROM embeddings")
def color_by_category(spark, d):
    c = an.color_by_category(st.dense_store(spark, d), "label", "X_2d", ["1", "2"])
    return rounded(c.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "label", "highlighted"))


@query(f"SELECT CAST(label AS VARCHAR) AS label, {R('avg(embedding[1]::DOUBLE)')} AS x, {R('avg(embedding[2]::DOUBLE)')} AS y, count(*) AS n_cells FROM embeddings GROUP BY 1")
def category_centroids(spark, d):
    return rounded(an.centroids(st.dense_store(spark, d), "label", "X_2d"))


@query(f"SELECT {R('min(embedding[1]::DOUBLE)')} AS x_low, {R('max(embedding[1]::DOUBLE)')} AS x_high, {R('min(embedding[2]::DOUBLE)')} AS y_low, {R('max(embedding[2]::DOUBLE)')} AS y_high, count(*) AS n_cells FROM embeddings WHERE label = 5")
def selection_bbox(spark, d):
    s = st.dense_store(spark, d)
    b = an.bounding_box(s, an.mask(s, "label", "5"), "X_2d")
    return rounded(b.select(*[F.col(c).cast("double").alias(c) for c in b.columns[:4]], "n_cells"))


@query(f"""WITH {SPARSE}, k AS (SELECT * FROM so WHERE cell_id IN (SELECT cell_id FROM sx WHERE gene_id = 5 AND v >= 1)) SELECT priority AS "group", count(*) AS n_cells, round_even(count(*) / sum(count(*)) OVER (), 4) AS fraction FROM k GROUP BY 1""")
def selection_summary(spark, d):
    s = st.sparse_store(spark, d)
    return an.selection_summary(s, "priority", an.filter_by_expression(s, 5, low=1))


@query(f"""WITH {SPARSE} SELECT cell_id, {R("coalesce(sum(v), 0)")} AS total FROM so LEFT JOIN sx USING (cell_id) GROUP BY 1""")
def cell_totals(spark, d):
    return rounded(matrix.cell_totals(st.sparse_store(spark, d)))


@query(f"""WITH {SPARSE}, t AS (SELECT cell_id, sum(v) AS total FROM sx GROUP BY 1), m AS (SELECT quantile_cont(total, 0.5) AS med FROM t WHERE total > 0) SELECT cell_id, gene_id, {R("ln(1 + v * (med / total))")} AS value FROM sx JOIN t USING (cell_id), m""")
def normalize_log1p(spark, d):
    return rounded(matrix.normalize_log1p(st.sparse_store(spark, d)))


@query(f"""WITH {SPARSE}, t AS (SELECT cell_id, sum(v) AS total FROM sx GROUP BY 1) SELECT cell_id, gene_id, {R("ln(1 + v * (10000 / total))")} AS value FROM sx JOIN t USING (cell_id)""")
def normalize_fixed(spark, d):
    return rounded(matrix.normalize_log1p(st.sparse_store(spark, d), 10_000))


@query("""SELECT p_partkey AS gene_id, p_name AS var_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 200""")
def hvg_select_ranked(spark, d):
    v = st.sparse_store(spark, d).var.withColumnRenamed("price", "highly_variable_rank")
    return matrix.select_ranked(v, 200).select("gene_id", "var_name")


@query(f"""WITH {SPARSE}, t AS (SELECT cell_id, sum(v) AS total FROM sx GROUP BY 1) SELECT cell_id, gene_id, {R("ln(1 + v * (10000 / total))")} AS value FROM sx JOIN t USING (cell_id)
WHERE gene_id IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 150)""")
def hvg_matrix(spark, d):
    """The normalised matrix of the genes of largest variance: totals are of all genes."""
    s = st.sparse_store(spark, d)
    best = matrix.select_ranked(s.var.withColumnRenamed("price", "vst.variance.standardized"), 150)
    return rounded(matrix.restrict(matrix.normalize_log1p(s, 10_000), best))


@query(f"""WITH {SPARSE}, n AS (SELECT count(*)::DOUBLE AS n FROM so), g AS (SELECT gene_id, sum(v) / any_value(n) AS mean, (sum(v * v) - sum(v) * sum(v) / any_value(n)) / (any_value(n) - 1) AS var FROM sx, n GROUP BY 1 HAVING sum(v) > 0),
h AS (SELECT gene_id, mean, var / mean AS disp, ln(1 + mean) AS lm FROM g), b AS (SELECT *, least(floor((lm - min(lm) OVER ()) / nullif(max(lm) OVER () - min(lm) OVER (), 0) * 20), 19) AS bin FROM h),
z AS (SELECT gene_id, mean, disp, CASE WHEN stddev_samp(ln(disp)) OVER (PARTITION BY bin) > 0 THEN (ln(disp) - avg(ln(disp)) OVER (PARTITION BY bin)) / stddev_samp(ln(disp)) OVER (PARTITION BY bin) ELSE 1 END AS score FROM b WHERE disp > 0),
k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, gene_id) <= 100 AS hv FROM z)
SELECT p_partkey AS gene_id, {R("coalesce(mean, 0)")} AS mean, {R("coalesce(disp, 0)")} AS dispersion, {R("coalesce(score, 0)")} AS score, coalesce(hv, false) AS highly_variable FROM part LEFT JOIN k ON p_partkey = gene_id""")
def hvg_dispersion(spark, d):
    return rounded(matrix.dispersion_genes(st.sparse_store(spark, d), 100))


@query(f"""WITH {SPARSE} SELECT {R("min(v)")} AS low, {R("max(v)")} AS high, {R("avg(v)")} AS mean, {R("stddev_pop(v)")} AS spread, bool_and(abs(v - round(v)) <= 1e-8) AS whole, CASE WHEN bool_and(abs(v - round(v)) <= 1e-8) AND max(v) > 20 THEN 'raw counts (integers)' END AS state FROM sx WHERE v <> 0""")
def x_state(spark, d):
    return rounded(stats.scan_state(st.sparse_store(spark, d).x))


@query(f"""WITH {DENSE} SELECT {R("min(v)")} AS low, {R("max(abs(v))")} AS high, {R("avg(v)")} AS mean, {R("stddev_pop(v)")} AS spread, false AS whole,
CASE WHEN stddev_pop(v) > 0.5 AND stddev_pop(v) < 2 AND abs(avg(v)) < 1 THEN 'z-scored / scaled (negative values, std ~1)' ELSE 'z-scored / scaled (negative values present)' END AS state FROM dx WHERE v <> 0""")
def x_state_dense(spark, d):
    return rounded(stats.scan_state(st.dense_store(spark, d).x))


@query(f"WITH {DENSE} SELECT cell_id, CAST(gene_id AS INTEGER) AS gene_id, {R('v')} AS value FROM dx WHERE v <> 0")
def coo_from_dense(spark, d):
    return rounded(st.dense_store(spark, d).x)


@query(f"WITH {SPARSE} SELECT cell_id, gene_id, {R('v')} AS value FROM sx")
def csr_round_trip(spark, d):
    return rounded(st.coo_from_csr(st.csr_from_coo(st.sparse_store(spark, d).x)))


@query(f"WITH {DENSE} SELECT cell_id, CAST(gene_id AS INTEGER) AS gene_id, {R('v')} AS value FROM dx WHERE v <> 0")
def densify(spark, d):
    return rounded(st.coo_from_dense(st.densify(st.dense_store(spark, d).x, 64), "cell_id", "values"))


@query(f"WITH {SPARSE} SELECT max(cell_id) AS max_cell, max(gene_id) AS max_gene, count(*) AS entries, greatest(max(cell_id), max(gene_id), count(*)) <= 2147483647 AS fits_int32 FROM sx")
def index_bounds(spark, d):
    return st.index_bounds(st.sparse_store(spark, d).x)


@query(f"WITH {DENSE} SELECT cell_id, CAST(gene_id AS INTEGER) AS gene_id, {R('v')} AS value FROM dx")
def coo_from_triple(spark, d):
    e = st.table(spark, d, "embeddings")
    n, width = e.agg(F.count("*"), F.max(F.size("embedding"))).first()
    entries = e.select("vec_id", F.posexplode("embedding").alias("index", "value")).select((F.col("vec_id") * width + F.col("index")).alias("pos"), "index", "value")
    return rounded(st.coo_from_triple(entries, spark.range(n + 1).select(F.col("id").alias("row"), (F.col("id") * width).alias("start"))))


@query(f"""WITH {SPARSE} SELECT gene_id, sum(v * v * v)::BIGINT AS cubes FROM sx GROUP BY 1""")
def reduce_genes(spark, d):
    part = lambda rows: rows.assign(cubes=rows["value"] ** 3).groupby("gene_id", as_index=False)["cubes"].sum().astype({"cubes": "int64"})
    return matrix.reduce_genes(st.sparse_store(spark, d).x, part, lambda rows: rows.groupby("gene_id", as_index=False)["cubes"].sum(), "gene_id long, cubes long")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS p, o_orderstatus AS s FROM orders)
SELECT o_orderkey AS cell_id, 'priority' AS "column", CASE WHEN p IS NULL THEN -1 ELSE k END AS code FROM (SELECT *, dense_rank() OVER (ORDER BY p NULLS LAST) - 1 AS k FROM r)
UNION ALL SELECT o_orderkey, 'status', dense_rank() OVER (ORDER BY s) - 1 FROM r""")
def encode_categorical(spark, d):
    o = st.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.expr("if(o_orderkey % 7 = 0, null, o_orderpriority)").alias("priority"), F.col("o_orderstatus").alias("status"))
    return matrix.encode_categorical(o, ["priority", "status"])


@query("""WITH k AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey AS cell_id, 'priority' AS "column", CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS label FROM orders""")
def decode_categorical(spark, d):
    o = st.table(spark, d, "orders")
    rank = o.select("o_orderpriority").distinct().selectExpr("'priority' as column", "cast(row_number() over (partition by 1 order by o_orderpriority) - 1 as int) as code", "o_orderpriority as label")
    codes = o.join(F.broadcast(rank), F.col("o_orderpriority") == F.col("label")).select(F.col("o_orderkey").alias("cell_id"), "column", F.expr("if(o_orderkey % 7 = 0, -1, code)").alias("code"))
    return matrix.decode_categorical(codes, rank)


@query("""SELECT o_orderkey AS cell_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS value FROM orders""")
def decode_nullable(spark, d):
    o = st.table(spark, d, "orders")
    return matrix.decode_nullable(o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("value"), (F.col("o_orderkey") % 5 == 0).alias("mask")))


@query("SELECT p_partkey AS gene_id, p_name AS var_names, p_type AS ensembl, p_name AS gene_symbol FROM part")
def prepare_var(spark, d):
    p = st.table(spark, d, "part")
    return matrix.prepare_var(p.select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("var_names"), F.col("p_type").alias("ensembl"), "p_size"))


_PREPARED = """ob AS (SELECT o_orderkey::VARCHAR AS cell_name, 'sf_' || o_orderkey AS cell_id, o_custkey::VARCHAR AS sample, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END, 'unknown') AS cell_type, o_orderstatus AS author_cell_type, 't' AS technology,
  'UMI' AS expression_unit, o_clerk_ AS site, o_orderpriority AS disease, o_custkey::VARCHAR AS patient, 'd' AS dataset_id FROM (SELECT *, o_orderpriority AS o_clerk_ FROM orders) WHERE o_orderkey % 3 <> 0)"""


def _prepared(spark, d) -> st.Store:
    """Orders in two parts, each prepared on its own, as one joint matrix of counts."""
    o, s = st.table(spark, d, "orders"), st.sparse_store(spark, d)
    obs = o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("sample_id"), F.expr("if(o_orderkey % 4 = 0, null, o_orderstatus)").alias("cell_type"), F.col("o_orderstatus").alias("cell_type_study"), F.lit("t").alias("platform"), F.lit("TPM").alias("expression_unit"),
                   F.col("o_orderpriority").alias("tissue"), F.col("o_orderpriority").alias("disease"), F.col("o_custkey").alias("donor_id"), F.lit("d").alias("dataset"), F.expr("if(o_orderkey % 3 = 0, 'scaled', 'raw counts')").alias("matrix_type"))
    var = s.var.select("gene_id", F.col("var_name").alias("var_names"))
    parts = [st.Store(obs.where(f"cell_id % 2 = {k}"), var, s.x.withColumn("value", F.lit(0.0)), layers={"counts": s.x}) for k in (0, 1)]
    return matrix.concatenate_stores([matrix.prepare(p, "sf") for p in parts])


@query(f"WITH {_PREPARED} SELECT * FROM ob")
def preprocess_counts(spark, d):
    return _prepared(spark, d).obs


@query(f"WITH {SPARSE}, {_PREPARED} SELECT ob.cell_id, gene_id, {R('v')} AS value FROM sx JOIN ob ON ob.cell_name = sx.cell_id::VARCHAR")
def preprocess_matrix(spark, d):
    return rounded(_prepared(spark, d).x)


@query(f"""WITH {SPARSE} SELECT 'cell_id' AS "column", 'numeric' AS dtype, NULL::BIGINT AS cardinality, NULL::VARCHAR AS "values" UNION ALL SELECT 'total_price', 'numeric', NULL, NULL
UNION ALL SELECT 'status', 'categorical', count(DISTINCT status), string_agg(DISTINCT status, ',' ORDER BY status) FROM so UNION ALL SELECT 'priority', 'categorical', count(DISTINCT priority), string_agg(DISTINCT priority, ',' ORDER BY priority) FROM so
UNION ALL SELECT 'segment', 'categorical', count(DISTINCT segment), string_agg(DISTINCT segment, ',' ORDER BY segment) FROM so UNION ALL SELECT 'nation', 'categorical', count(DISTINCT nation), string_agg(DISTINCT nation, ',' ORDER BY nation) FROM so""")
def facet_discovery(spark, d):
    return an.schema_summary(st.sparse_store(spark, d).obs).withColumn("values", F.array_join("values", ","))


@query("""WITH l AS (SELECT 'var_name' AS "column", p_name AS label FROM part UNION SELECT 'brand', p_brand FROM part UNION SELECT 'type', p_type FROM part)
SELECT 'gene_id' AS "column", 'numeric' AS dtype, NULL::BIGINT AS cardinality, NULL::VARCHAR AS "values" UNION ALL SELECT 'price', 'numeric', NULL, NULL
UNION ALL SELECT "column", 'categorical', count(*), CASE WHEN count(*) <= 50 THEN string_agg(label, ',' ORDER BY label) END FROM l GROUP BY 1""")
def dataset_context(spark, d):
    return an.dataset_context(st.sparse_store(spark, d).var).withColumn("values", F.array_join("values", ","))


@query(f"""WITH {SPARSE} SELECT gene_id, p_brand AS label, {R("sum(v)")} AS total FROM sx JOIN part ON gene_id = p_partkey GROUP BY ALL""")
def gene_labels(spark, d):
    s = st.sparse_store(spark, d)
    return rounded(an.relabel(s.x.groupBy("gene_id").agg(F.sum("value").alias("total")), s.var, "brand"))


@query(f"""WITH {SPARSE}, l AS (SELECT 'status' AS c, status AS label FROM so UNION SELECT 'priority', priority FROM so UNION SELECT 'segment', segment FROM so UNION SELECT 'nation', nation FROM so),
k AS (SELECT c || ':categorical:' || count(*) || ':' || string_agg(label, ',' ORDER BY label) AS f FROM l GROUP BY c UNION ALL SELECT 'total_price:numeric')
SELECT (SELECT count(*) FROM so) AS n_obs, (SELECT count(*) FROM part) AS n_var, (SELECT count(*) FROM sx) AS entries, (SELECT string_agg(f, ';' ORDER BY f) FROM k) AS obs_facets, '' AS embeddings,
{R("(SELECT count(*) FROM sx) / ((SELECT count(*) FROM so) * (SELECT count(*) FROM part))")} AS density""")
def store_schema(spark, d):
    facts = an.store_facts(st.sparse_store(spark, d))
    facet = lambda f: F.concat_ws(":", f["column"], f["dtype"], f["cardinality"].cast("string"), F.array_join(f["values"], ","))
    return rounded(facts.withColumn("obs_facets", F.array_join(F.array_sort(F.transform("obs_facets", facet)), ";")).withColumn("embeddings", F.array_join("embeddings", ",")))


@query("SELECT p_name AS symbol, first AS gene_id FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 9 = 0) JOIN (SELECT p_name AS n, min(p_partkey) AS first FROM part GROUP BY 1) ON n = p_name UNION ALL SELECT 'no such gene', NULL FROM (SELECT count(*) FROM part)")
def gene_positions(spark, d):
    v = st.sparse_store(spark, d).var
    wanted = v.where("gene_id % 9 = 0").select(F.col("var_name").alias("symbol")).distinct().union(spark.range(1).select(F.lit("no such gene")))
    return an.gene_positions(v, wanted, "var_name")


@query("SELECT 'no ' || p_name AS symbol, min(p_partkey) AS place FROM part GROUP BY 1 ORDER BY place LIMIT 5")
def unknown_genes(spark, d):
    v = st.sparse_store(spark, d).var
    names = v.groupBy("var_name").agg(F.min("gene_id").alias("place"))
    wanted = names.select(F.concat(F.lit("no "), "var_name").alias("symbol"), "place").union(names.select("var_name", F.col("place") - 1))
    return an.unknown_genes(v, wanted, "var_name")


def _catalog(spark, d):
    c, n, r = (st.table(spark, d, t) for t in ("customer", "nation", "region"))
    data = c.select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("slug"), (F.col("c_acctbal") >= 0).alias("is_public"), F.array("c_mktsegment").alias("required_roles"), F.col("c_nationkey").alias("collection_id"), F.lit(1).alias("datasource_id"), F.col("c_custkey").alias("created_at"))
    coll = n.select(F.col("n_nationkey").alias("collection_id"), F.col("n_name").alias("collection_name"))
    meta = st.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(F.count("*").alias("n_obs"))
    return data, r.where("r_regionkey = 1").select(F.lit(1).alias("datasource_id"), F.col("r_name").alias("source")), coll, meta


_LIST = """SELECT c_custkey AS dataset_id, c_name AS slug, n_name AS collection_name, r_name AS source, n_obs FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = 1
LEFT JOIN (SELECT o_custkey, count(*) AS n_obs FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE (c_acctbal >= 0 OR c_mktsegment = 'BUILDING')"""


@query(_LIST)
def catalog_list(spark, d):
    return catalog.listing(*_catalog(spark, d), roles=["BUILDING"]).select("dataset_id", "slug", "collection_name", "source", "n_obs")


@query(_LIST + " AND c_name = 'Customer#000000007'")
def catalog_get(spark, d):
    return catalog.listing(*_catalog(spark, d), roles=["BUILDING"], slug="Customer#000000007").select("dataset_id", "slug", "collection_name", "source", "n_obs")


@query("SELECT n_nationkey AS collection_id, n_name AS collection_name, count(*) AS n_datasets FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 OR c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def collections_count(spark, d):
    data, _, coll, _ = _catalog(spark, d)
    return catalog.collection_counts(data, coll, ["BUILDING"])


@query("SELECT c_custkey AS dataset_id, c_name AS slug FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' AND (c_acctbal >= 0 OR c_mktsegment = 'BUILDING')")
def collection_detail(spark, d):
    data, _, coll, _ = _catalog(spark, d)
    return catalog.collection_detail(data, coll, "NATION_7", ["BUILDING"]).select("dataset_id", "slug")


def _harvested(spark, d):
    """Customers as datasets and their order priorities as columns; those in debt have names alone, those without orders nothing."""
    o = st.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    h = o.groupBy("o_custkey").agg(F.sum("n").alias("n_obs"), F.collect_list("o_orderpriority").alias("obs_columns"), F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct(F.lit("categorical").alias("dtype"), F.col("n").alias("cardinality"))))).alias("f"))
    c = st.table(spark, d, "customer").join(h, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("dataset_id"), "n_obs", F.col("n_obs").alias("n_vars"), "obs_columns", F.when(F.col("c_acctbal") < 0, F.map_filter("f", lambda k, v: F.lit(False))).otherwise(F.col("f")).alias("obs_facets"))


@query("""SELECT c_custkey AS dataset_id, o_orderpriority AS "column", CASE WHEN c_acctbal < 0 THEN 'string' ELSE 'categorical' END AS dtype, CASE WHEN c_acctbal >= 0 THEN count(*) END AS cardinality FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, o_orderpriority, c_acctbal""")
def described_columns(spark, d):
    return catalog.described_columns(_harvested(spark, d))


def _columns(spark, d):
    """Event types as the columns of datasets (users)."""
    e = st.table(spark, d, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_type").alias("column")).distinct()
    known = e.select("column").distinct().where("column < 'm'").select(F.upper("column").alias("key"), F.array("column").alias("names"))
    return e, known


@query("""SELECT DISTINCT user_id AS dataset_id, event_type AS "column", CASE WHEN event_type < 'm' THEN upper(event_type) END AS key FROM events""")
def facet_resolve(spark, d):
    return catalog.resolve_facets(*_columns(spark, d)).select("dataset_id", "column", "key")


@query("""SELECT event_type AS "column", count(DISTINCT user_id) AS n_datasets FROM events WHERE event_type >= 'm' GROUP BY 1""")
def unmapped_columns(spark, d):
    return catalog.unmapped_columns(*_columns(spark, d))


def _as_stream(spark, rows: DataFrame, folder: str, by: str, files: int = 3) -> DataFrame:
    """A stream of ``rows``: a batch for each third of them by ``by``, in as many files for each as keep a task's rows bounded."""
    at = F.col(by).cast("double")
    cuts = rows.select(at.alias("at")).approxQuantile("at", [k / files for k in range(1, files)], 0.001)
    thirds = [(F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
    sizes = rows.agg(*[F.count_if(third).alias(f"n{k}") for k, third in enumerate(thirds)]).first()
    # every third has the same number of files, none of them empty: that takes many rows for each of them
    each = max(1, min(st.task_count(max(sizes)), min(sizes) // 1_000))
    for third in thirds:
        part = rows.where(third)
        (part.coalesce(1) if each == 1 else part.repartition(each)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(folder)


_ATT = """a AS (SELECT user_id AS dataset_id, event_id AS eid, CASE WHEN event_id % 11 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, event_type AS value FROM events)"""


def _attempts(spark, d):
    status = F.expr("case when event_id % 11 = 0 then 'clear' when event_id % 3 = 0 then 'failed' else 'ok' end")
    return st.table(spark, d, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("at"), status.alias("status"), F.col("event_type").alias("value"), F.lit("e").alias("error"))


_MERGED = f"""WITH {_ATT}, c AS (SELECT dataset_id, max(eid) AS c FROM a WHERE status = 'clear' GROUP BY 1), k AS (SELECT a.*, status = 'ok' AND (c IS NULL OR eid > c) AS ok FROM a LEFT JOIN c USING (dataset_id))
SELECT dataset_id, arg_max(value, eid) FILTER (WHERE ok) AS value, coalesce(max(eid) FILTER (WHERE ok), -1) AS fetched_at, max(eid) AS attempted_at, arg_max(status, eid) AS status FROM k GROUP BY 1"""


@query(_MERGED)
def metadata_merge(spark, d):
    return catalog.merge_harvests(_attempts(spark, d)).withColumn("fetched_at", F.coalesce("fetched_at", F.lit(-1))).drop("error")


@query(_MERGED)
def harvest_stream(spark, d):
    """The same state, merged from a stream in batches."""
    root = store_io.new_root(spark)
    stream = _as_stream(spark, _attempts(spark, d), f"{root}-in", "at")
    catalog.harvest_stream(stream, root, f"{root}-checkpoint").awaitTermination()
    return catalog.harvests(spark, root).withColumn("fetched_at", F.coalesce("fetched_at", F.lit(-1))).drop("error")


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def stale_rows(spark, d):
    e = st.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("fetched_at"), F.count("*").alias("n"))
    return catalog.stale(last, F.lit(e.agg(F.max("ts")).first()[0])).select("user_id", "n")


@query("""SELECT 'lineitem.order' AS reference, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'events.customer', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def orphans(spark, d):
    li, o, c, e = (st.table(spark, d, t) for t in ("lineitem", "orders", "customer", "events"))
    return catalog.orphans({"lineitem.order": (li, "l_orderkey", o, "o_orderkey"), "orders.customer": (o, "o_custkey", c, "c_custkey"), "events.customer": (e, "user_id", c, "c_custkey")})


@query("SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(spark, d):
    return catalog.row_counts({t: st.table(spark, d, t) for t in ("orders", "lineitem", "events")})


@query("SELECT 'left' AS side, count(*) AS rows FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'right', 0")
def table_parity(spark, d):
    o = st.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return catalog.difference(o, o.where("o_orderstatus <> 'F'"))


@query(f"""WITH a AS (SELECT gene_id FROM ({_compare_sql(10, "WHERE label = '1'", "WHERE label = '2'")})), b AS (SELECT gene_id FROM ({_compare_sql(10, "WHERE label = '1'", "WHERE label = '3'")}))
SELECT count(*) AS shared, count(*) / 10 AS share FROM a JOIN b USING (gene_id)""")
def topn_overlap(spark, d):
    s = st.dense_store(spark, d)
    sums, cells = stats.group_sums(s, "label")
    return catalog.top_overlap(*[stats.compare_groups(sums, cells, s.var, "1", g, 10) for g in "23"], 10)


def _messages(spark, d):
    return st.table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", "text", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"))


@query("SELECT conv_id AS thread_id, max(turn) AS updated_at, count(*) AS n_messages FROM conversations GROUP BY 1")
def thread_list(spark, d):
    m = _messages(spark, d)
    return chat.thread_list(m.groupBy("thread_id").agg(F.max("turn").alias("updated_at")), m)


@query("SELECT conv_id || '-' || turn AS message_id, role, CASE WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN 'up' END AS rating FROM conversations")
def thread_detail(spark, d):
    m = _messages(spark, d)
    f = m.where("turn % 3 = 0").select("message_id", F.expr("if(thread_id % 2 = 0, 'me', 'other')").alias("user_sub"), F.lit("up").alias("rating"))
    return chat.thread_detail(m, f, "me").select("message_id", "role", "rating")


@query("""WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1), g AS (SELECT conv_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM f)
SELECT conv_id AS thread_id, CASE WHEN length(t) > 50 THEN rtrim(t[1:50]) || '…' ELSE t END AS title FROM g""")
def thread_title(spark, d):
    return chat.titles(_messages(spark, d))


@query("SELECT conv_id AS thread_id, count(*) AS n_messages, CAST(max(length(text)) AS INTEGER) AS longest, CAST(sum(length(text)) AS BIGINT) AS total, CAST(max(length(text)) * 3 AS INTEGER) AS view_size, count(*) > 30 OR max(length(text)) > 4000 OR sum(length(text)) > 40000 OR max(length(text)) * 3 > 4096 AS oversized FROM conversations GROUP BY 1")
def oversized_turns(spark, d):
    m = _messages(spark, d)
    return chat.oversized(m, views=m.select("thread_id", F.repeat("text", F.lit(3)).alias("view_state")))


@query("""WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id AS thread_id, bool_and(role = CASE WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END) AND arg_max(role, turn) = 'user' AS ok FROM m GROUP BY 1""")
def role_alternation(spark, d):
    return chat.alternating(_messages(spark, d))


@query("SELECT user_id % 50 AS message_id, user_id AS user_sub, arg_max(event_type, event_id) AS rating, min(event_id) AS created_at, max(event_id) AS updated_at FROM events GROUP BY 1, 2")
def feedback_latest(spark, d):
    e = st.table(spark, d, "events")
    return chat.latest_feedback(e.select((F.col("user_id") % 50).alias("message_id"), F.col("user_id").alias("user_sub"), F.col("event_type").alias("rating"), F.col("event_id").alias("at"), F.col("event_id").alias("seq")))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id + 1000000 ELSE user_id END AS user_sub, user_id % 2 = 0 AS moved FROM events")
def claim_history(spark, d):
    e = st.table(spark, d, "events").select("event_id", F.col("user_id").alias("user_sub"))
    c = e.where("user_sub % 2 = 0").select(F.col("user_sub").alias("anon_id")).distinct().withColumn("user_sub", F.col("anon_id") + 1_000_000)
    return chat.claim_history(e, c)


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'tool' ELSE role END AS role, CASE WHEN turn % 3 = 0 THEN repeat(text, 12) ELSE text END AS text FROM conversations)
SELECT conv_id AS thread_id, turn, CASE WHEN role <> 'tool' AND conv_id % 2 = 1 THEN '[redacted]' WHEN role <> 'tool' THEN text WHEN conv_id % 2 = 1 THEN '{"_redacted":"tool_result"}' WHEN length(text) > 4096 THEN '{"_truncated":true,"_size_bytes":' || length(text) || '}' ELSE text END AS text FROM m""")
def redact_private(spark, d):
    m = _messages(spark, d)
    tool = F.col("turn") % 3 == 0
    m = m.withColumn("text", F.when(tool, F.repeat("text", F.lit(12))).otherwise(F.col("text"))).withColumn("role", F.when(tool, "tool").otherwise(F.col("role")))
    return chat.redact_private(m, m.where("thread_id % 2 = 0")).select("thread_id", "turn", "text")


@query("SELECT user_id AS turn_id, count(*) AS generations, sum(length(event_type))::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens FROM events GROUP BY 1")
def token_usage(spark, d):
    e = st.table(spark, d, "events")
    return chat.token_usage(e.select(F.col("user_id").alias("turn_id"), F.length("event_type").alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens")))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS completed, {R('min(value) FILTER (WHERE event_type = $$purchase$$)')} AS fastest, {R('max(value) FILTER (WHERE event_type = $$purchase$$)')} AS best_ratio FROM events".replace("$$", "'"))
def run_summary(spark, d):
    e = st.table(spark, d, "events")
    return rounded(chat.run_summary(e.select(F.expr("if(event_type = 'purchase', 'completed', event_type)").alias("status"), F.col("value").alias("seconds"), F.col("value").alias("ratio"))))


@query("""SELECT event_id::INTEGER AS run, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE event_type END AS status, event_id AS n_obs, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS n_vars FROM events
UNION ALL SELECT max(event_id)::INTEGER + 1, 'new', 9, NULL FROM events""")
def run_log_merge(spark, d):
    """A run for each event; every second one gets an update of its status and of one nested field; one run is appended."""
    e = st.table(spark, d, "events").withColumn("run", F.col("event_id").cast("int"))
    nested = lambda a, b: F.struct(a.cast("long").alias("n_obs"), b.cast("long").alias("n_vars")).alias("dataset")
    runs = e.select("run", F.col("event_type").alias("status"), nested(F.col("event_id"), F.lit(None)))
    updates = e.where("run % 2 = 0").select("run", F.lit("completed").alias("status"), nested(F.lit(None), F.col("run") % 5))
    new = spark.range(1).select(F.lit("new").alias("status"), nested(F.lit(9), F.lit(None)))
    return chat.append_run(chat.merge_runs(runs, updates), new).select("run", "status", "dataset.n_obs", "dataset.n_vars")


def _questions(spark, d):
    return st.table(spark, d, "events").select(F.col("event_id").alias("question_id"), F.col("user_id").alias("visitor"), F.col("ts").cast("timestamp").alias("at"))


@query("SELECT 'visitor' AS kind, user_id::VARCHAR AS key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'day', 'all', strftime(date_trunc('day', ts), '%Y-%m-%d %H'), count(*) FROM events GROUP BY ALL")
def usage_windows(spark, d):
    return usage.usage_windows(_questions(spark, d)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


@query("SELECT event_id AS question_id, user_id AS visitor, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS admitted FROM events")
def admit_visitor(spark, d):
    return usage.admit_visitors(_questions(spark, d), 1)


@query("""WITH q AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS ok FROM events),
r AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q)
SELECT event_id AS question_id, user_id AS visitor, CASE WHEN before >= 50 THEN 'day' WHEN ok THEN 'admitted' ELSE 'visitor' END AS verdict FROM r""")
def admit_coupled(spark, d):
    return usage.admit_coupled(_questions(spark, d), 1, 50)


def _with_address(spark, d):
    """Every seventh question comes without an address; the others share forty, each visitor three."""
    return _questions(spark, d).withColumn("ip", F.expr("if(question_id % 7 = 0, null, concat('10.0.0.', (visitor + question_id % 3) % 40))"))


_ADMITTED = """WITH RECURSIVE q AS MATERIALIZED (SELECT event_id AS id, user_id AS v, CASE WHEN event_id % 7 <> 0 THEN '10.0.0.' || ((user_id + event_id % 3) % 40) END AS ip, ts, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS h,
  row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT h, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, false AS v_full, false AS ok, CAST([] AS BIGINT[]) AS vs, CAST([] AS VARCHAR[]) AS ips FROM q
  UNION ALL SELECT h, n, id, v_full, ok, CASE WHEN ok THEN list_append(vs, v) ELSE vs END, CASE WHEN ok AND ip IS NOT NULL THEN list_append(ips, ip) ELSE ips END
  FROM (SELECT q.h, q.n, q.id, q.v, q.ip, r.vs, r.ips, len(list_filter(r.vs, lambda x: x = q.v)) >= 2 AS v_full, len(list_filter(r.vs, lambda x: x = q.v)) < 2 AND (q.ip IS NULL OR len(list_filter(r.ips, lambda x: x = q.ip)) < 2) AS ok
    FROM r JOIN q ON q.h = r.h AND q.n = r.n + 1)),
k AS (SELECT q.id, q.v, ok, v_full, count(*) FILTER (WHERE ok) OVER (PARTITION BY day ORDER BY ts, q.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q JOIN r USING (id))
SELECT id AS question_id, v AS visitor, CASE WHEN before >= 80 THEN 'day' WHEN ok THEN 'admitted' WHEN v_full THEN 'visitor' ELSE 'ip' END AS verdict FROM k"""


@query(_ADMITTED)
def admit_with_addresses(spark, d):
    return usage.admit_coupled(_with_address(spark, d), 2, 80, 2)


@query(_ADMITTED)
def admit_stream(spark, d):
    """The same verdicts from a stream in batches."""
    root = store_io.new_root(spark)
    usage.admit_stream(_as_stream(spark, _with_address(spark, d), f"{root}-in", "at"), root, f"{root}-checkpoint", 2, 80, 2).awaitTermination()
    usage.close_stream(spark, root, 2, 80, 2)
    return usage.verdicts(spark, root)


@query("SELECT 'visitor' AS kind, user_id::VARCHAR AS key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'day', 'all', strftime(date_trunc('day', ts), '%Y-%m-%d %H'), count(*) FROM events GROUP BY ALL")
def usage_updates(spark, d):
    """Counters of a stream that delivers every fifth question twice, as they stand after its last batch."""
    root, q = store_io.new_root(spark), _questions(spark, d)
    stream = _as_stream(spark, q.union(q.where("question_id % 5 = 0")), f"{root}-in", "at")
    keep = lambda rows, k: rows.write.mode("overwrite").parquet(f"{root}-out/batch={k}")
    usage.usage_updates(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return usage.latest(spark.read.parquet(f"{root}-out")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


@query("SELECT 'completed' AS status, CAST(3 AS BIGINT) AS batches, count(*) AS rows FROM events")
def stream_log(spark, d):
    """The run log of a stream over all events."""
    root = store_io.new_root(spark)
    stream = _as_stream(spark, _questions(spark, d), f"{root}-in", "at")
    with progress.RunLog(spark, f"{root}-log"):
        stream.writeStream.format("noop").option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    return progress.stream_summary(progress.read_events(spark, f"{root}-log")).select("status", "batches", "rows")


@query("""SELECT 'visitor' AS kind, user_id::VARCHAR AS key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'ip', sha256('10.0.' || (user_id % 50)), strftime(date_trunc('hour', ts), '%Y-%m-%d %H'), count(*) FROM events WHERE event_id % 7 <> 0 GROUP BY ALL
UNION ALL SELECT 'day', 'all', strftime(date_trunc('day', ts), '%Y-%m-%d %H'), count(*) FROM events GROUP BY ALL""")
def usage_windows_addresses(spark, d):
    q = _questions(spark, d).withColumn("ip", F.expr("if(question_id % 7 = 0, null, concat('10.0.', visitor % 50))"))
    return usage.usage_windows(q).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


@query(f"SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(coalesce(sum(event_id) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) AS bytes, {R('sum(value)')} AS elapsed_ms FROM events")
def trace_summary(spark, d):
    e = st.table(spark, d, "events")
    bad = F.col("event_type") == "error"
    return rounded(usage.trace_summary(e.select(F.when(bad, F.col("event_type")).alias("error"), F.when(~bad, F.col("event_id")).alias("bytes"), F.col("value").alias("elapsed_ms"))))


@query(f"SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(coalesce(sum(event_id) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) AS bytes, {R('sum(value)')} AS elapsed_ms FROM events")
def trace_stream(spark, d):
    """The trace as lines of JSON, summed up by a stream in batches."""
    root, bad = store_io.new_root(spark), F.col("event_type") == "error"
    e = st.table(spark, d, "events").select(F.col("ts").cast("timestamp").cast("double").alias("ts"), F.when(bad, F.col("event_type")).alias("error"), F.when(~bad, F.col("event_id")).alias("bytes"), F.col("value").alias("elapsed_ms"))
    e.repartitionByRange(3, "ts").write.json(f"{root}-in")
    keep = lambda rows, k: rows.write.mode("overwrite").parquet(f"{root}-out")
    summary = usage.trace_summary(usage.read_trace(spark, f"{root}-in", stream=True))
    summary.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{root}-out"))


@query(f"SELECT vec_id AS cell_id, {R('list_sum([x::DOUBLE * x::DOUBLE for x in embedding])')} AS squares FROM embeddings")
def svd_norms(spark, d):
    """On all singular directions a cell keeps its length."""
    scores = matrix.svd_scores(st.dense_store(spark, d), 64)[0]
    return rounded(scores.groupBy("cell_id").agg(F.sum(F.col("score") * F.col("score")).alias("squares")))


@query(f"SELECT vec_id AS cell_id, {R('list_sum([x::DOUBLE * x::DOUBLE for x in embedding[1:12]])')} AS squares FROM embeddings")
def svd_of_selected_genes(spark, d):
    """A selection of genes whose numbers have gaps and are large: a cell keeps its length on all directions."""
    s = st.dense_store(spark, d)
    few = replace(s, x=s.x.where("gene_id < 12").withColumn("gene_id", F.col("gene_id") * 1_000_003))
    scores = matrix.svd_scores(few, 12)[0]
    return rounded(scores.groupBy("cell_id").agg(F.sum(F.col("score") * F.col("score")).alias("squares")))


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM p) SELECT a AS row_id, b AS col_id, (round(dist, 6) + 0.0) AS value FROM r WHERE k <= 10""")
def knn_all_cells(spark, d):
    """The neighbours of all cells, among all cells; those of every tenth are compared."""
    v = st.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("coords"))
    return rounded(neighbours.knn_all(v, 10)).where("row_id % 10 = 0")


@query()
def svd_scores(spark, d):
    return matrix.svd_scores(st.dense_store(spark, d), 5)[0]


@query("""WITH q AS (SELECT vec_id AS a, embedding AS e FROM embeddings), p AS (SELECT a, vec_id AS b, list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE) for x in list_zip(e, embedding)]) AS dist FROM q, embeddings WHERE a <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM p) SELECT a AS cell_id, b AS neighbour, (round(dist, 6) + 0.0) AS distance, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 10""")
def knn_graph(spark, d):
    v = st.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("coords"))
    return rounded(matrix.knn_graph(v, 10))
