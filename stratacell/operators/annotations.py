"""Descriptions, filters, charts and layouts over the annotation of cells and genes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import exact_quantiles
from ..sources.store import Store
from .stats import MOST, clamp, panel_above_min

#: Gene label columns, of which the first that is there counts; without one the gene's id is the label.
LABEL_COLUMNS = (
    "feature_name",
    "gene_symbol",
    "GeneSymbol",
    "gene_symbols",
    "var_name",
    "gene_name",
    "gene_short_name",
    "symbol",
    "name",
    "gene",
)


def describe_categorical(table: DataFrame, column: str, order: str) -> DataFrame:
    """The most frequent labels, and how many rows the others have; equal counts in order of first appearance."""
    counts = table.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("labels"))
    top = counts.orderBy(F.desc("n"), "first").limit(MOST)
    return top.crossJoin(F.broadcast(total)).select("label", "n", "total", (F.col("total") - F.sum("n").over(Window.partitionBy("total"))).alias("other"))


def describe_numeric(table: DataFrame, column: str) -> DataFrame:
    kind = dict(table.dtypes)[column]
    if kind in ("string", "boolean") or kind.startswith(("array", "map", "struct")):
        raise ValueError(f"{column} is {kind}, neither numeric nor categorical")
    v = F.col(column).cast("double")
    q = exact_quantiles(table.select(v), [0.25, 0.5, 0.75]) or [None] * 3
    return table.agg(
        F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"),
        *[F.lit(x).cast("double").alias(name) for x, name in zip(q, ("q1", "median", "q3"), strict=True)], F.stddev_pop(v).alias("spread"),
    )


def cluster_stats(cells: DataFrame, column: str) -> DataFrame:
    """Cells of each group and their share, rounded half to even."""
    counts = cells.groupBy(F.col(column).alias("group")).agg(F.count("*").alias("n_cells"))
    total = counts.agg(F.sum("n_cells").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("group", "n_cells", F.bround(F.col("n_cells") / F.col("total"), 4).alias("fraction")).orderBy(F.desc("n_cells"), "group").limit(MOST)


def search_genes(var: DataFrame, query: str, limit: int = 20, label: str = "var_name") -> DataFrame:
    """Genes whose label contains the text, in any case."""
    return var.where(F.contains(F.lower(F.col(label)), F.lit(query.lower()))).orderBy("gene_id").limit(clamp(limit)).select(
        "gene_id", F.col(label).alias("label"), F.lit(limit > MOST).alias("capped")
    )


def label_column(var: DataFrame) -> str:
    return next((c for c in LABEL_COLUMNS if c in var.columns), "gene_id")


def symbol_map(var: DataFrame, label: str | None = None) -> DataFrame:
    """(symbol, gene_id): a symbol that several genes have means the first."""
    return var.groupBy(F.col(label or label_column(var)).cast("string").alias("symbol")).agg(F.min("gene_id").alias("gene_id"))


def gene_positions(var: DataFrame, wanted: DataFrame, label: str | None = None) -> DataFrame:
    """``wanted`` (symbol, ..) with the ``gene_id`` of each symbol, null where no gene has it."""
    return wanted.join(symbol_map(var, label), "symbol", "left")


def unknown_genes(var: DataFrame, wanted: DataFrame, label: str | None = None) -> DataFrame:
    """The first five of ``wanted`` (symbol, place), in the order of the request, that no gene has."""
    return gene_positions(var, wanted, label).where("gene_id is null").orderBy("place").limit(5).select("symbol", "place")


def genes_named(var: DataFrame, names: Sequence[str], label: str | None = None) -> list[int]:
    """The positions of the named genes, in the order of the request; an error names the first five that there are not."""
    found = {r["symbol"]: r["gene_id"] for r in symbol_map(var, label).where(F.col("symbol").isin(list(names))).collect()}
    unknown = [n for n in names if n not in found][:5]
    if unknown:
        raise ValueError(f"no such genes: {', '.join(unknown)}")
    return [found[n] for n in names]


def matches(where: dict[str, object]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in where.items()], F.lit(True))


def mask(store: Store, column: str, value: str) -> DataFrame:
    if dict(store.obs.dtypes).get(column) != "string":
        raise ValueError(f"{column} is not categorical")
    return store.obs.where(F.col(column) == value)


def filter_by_ids(table: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (one column), of which there may be any number."""
    return table.join(ids.toDF(column), column, "left_semi")


def filter_by_expression(store: Store, gene_id: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Cells with the gene's value in [low, high]; either may be open."""
    if low is None and high is None:
        raise ValueError("a bound is needed")
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound is above the upper")
    v = F.col("value")
    return store.gene(gene_id).where((v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True)))


def select_by_expression(store: Store, gene_id: int, low: float | None = None, high: float | None = None) -> tuple[DataFrame, int]:
    """The cells of :func:`filter_by_expression` and their number; none is an error."""
    cells = filter_by_expression(store, gene_id, low, high)
    n = cells.count()
    if not n:
        raise ValueError(f"no cell has gene {gene_id} within [{low}, {high}]")
    return cells, n


def bar_counts(obs: DataFrame, column: str, groups: Sequence[str], where: dict[str, object] | None = None) -> DataFrame:
    """Cells of 1 to 8 named groups under equality conditions; empty groups count 0."""
    names = list(dict.fromkeys(groups))
    if not 0 < len(names) <= 8:
        raise ValueError("1 to 8 groups")
    row = obs.where(matches(where or {})).agg(F.array(*[F.struct(F.lit(g).alias("group"), F.count_if(F.col(column) == g).alias("n_cells")) for g in names]).alias("g"))
    return row.select(F.inline("g"))


def bar_composition(obs: DataFrame, column: str, groups: Sequence[str], of: str, most: int = 10, where: dict[str, object] | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Share of each ``of`` label in each group, under equality conditions; beyond ten labels by summed share the rest is one.
    Cells without label stay in the denominator. Equal shares go by the labels' positions in ``declared`` (label, code), or by label."""
    own = obs.where(F.col(column).isin(list(groups)) & matches(where or {}))
    n = own.groupBy(F.col(column).alias("group")).agg(F.count("*").alias("n_cells"))
    share = own.where(F.col(of).isNotNull()).groupBy(F.col(column).alias("group"), F.col(of).alias("label")).agg(F.count("*").alias("n")).join(n, "group").withColumn("share", F.col("n") / F.col("n_cells"))
    weight = share.groupBy("label").agg(F.round(F.sum("share"), 12).alias("weight"))
    if declared is not None:
        weight = weight.join(declared.select("label", "code"), "label", "left")
    top = weight.orderBy(F.desc("weight"), *(["code"] if declared is not None else []), "label").limit(most)
    top = F.broadcast(top.select("label", F.lit(True).alias("named")))  # ten labels
    label = F.when(F.col("named"), F.col("label")).otherwise("All other")
    return share.join(top, "label", "left").groupBy("group", label.alias("label")).agg(F.sum("share").alias("share"))


def bar_gene_mean(store: Store, column: str, groups: Sequence[str], genes: Sequence[int], where: dict[str, object] | None = None) -> DataFrame:
    """Mean and fraction expressing, of 1 to 10 genes in the named groups under equality conditions; a value counts above the
    gene's least one there. Groups without cells count 0."""
    if not 0 < len(genes) <= 10:
        raise ValueError("1 to 10 genes")
    cells = store.obs.where(F.col(column).isin(list(groups)) & matches(where or {})).select("cell_id", column)
    named = store.obs.sparkSession.createDataFrame([(g,) for g in dict.fromkeys(groups)], "label string")
    return panel_above_min(store, cells, genes, named)


def color_by_gene(store: Store, gene_id: int, key: str) -> DataFrame:
    return store.embedding(key).join(store.gene(gene_id), "cell_id").select("cell_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"), "value")


def color_by_category(store: Store, column: str, key: str, highlight: Sequence[str] = ()) -> DataFrame:
    unknown = set(highlight) - {r[0] for r in store.obs.where(F.col(column).isin(list(highlight))).select(column).distinct().collect()}
    if unknown:
        raise ValueError(f"no such labels: {sorted(unknown)}")
    lit = F.col(column).isin(list(highlight)) if highlight else F.lit(True)
    return store.embedding(key).join(store.column(column), "cell_id").select("cell_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"), F.col(column).alias("label"), lit.alias("highlighted"))


def centroids(store: Store, column: str, key: str) -> DataFrame:
    """Where to put each label."""
    rows = store.embedding(key).join(store.column(column), "cell_id")
    return rows.groupBy(F.col(column).alias("label")).agg(F.avg(F.col("coords")[0]).alias("x"), F.avg(F.col("coords")[1]).alias("y"), F.count("*").alias("n_cells"))


def bounding_box(store: Store, cells: DataFrame, key: str) -> DataFrame:
    x, y = F.col("coords")[0], F.col("coords")[1]
    rows = store.embedding(key).join(cells.select("cell_id"), "cell_id", "left_semi")
    return rows.agg(F.min(x).alias("x_low"), F.max(x).alias("x_high"), F.min(y).alias("y_low"), F.max(y).alias("y_high"), F.count("*").alias("n_cells"))


def selection_summary(store: Store, column: str, cells: DataFrame | None = None) -> DataFrame:
    """:func:`cluster_stats` of all cells, or of a selection."""
    obs = store.obs if cells is None else store.obs.join(cells.select("cell_id"), "cell_id", "left_semi")
    return cluster_stats(obs, column)


def schema_summary(table: DataFrame, cap: int = 100, ontology: bool = False) -> DataFrame:
    """(column, dtype, cardinality, values) of each column: values of categorical ones up to ``cap`` labels, those of
    ontology ids only if asked for. Labels are gathered only where there are so few."""
    dtype = {"string": "categorical"}
    kinds = {c: dtype.get(t, "numeric" if t not in ("boolean",) and not t.startswith(("array", "map", "struct")) else "string") for c, t in table.dtypes}
    text = [c for c in table.columns if kinds[c] == "categorical"]
    names = table.sparkSession.createDataFrame(list(kinds.items()), "column string, dtype string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in text]).cast("array<struct<column:string,label:string>>")
    labels = table.select(F.inline(pairs)).where("label is not null").distinct()
    n = labels.groupBy("column").agg(F.count("*").alias("cardinality"))  # one row for each column
    few = n.where((F.col("cardinality") <= cap) & (F.lit(ontology) | ~F.col("column").endswith("_ontology_term_id")))
    found = labels.join(F.broadcast(few), "column", "left_semi").groupBy("column").agg(F.sort_array(F.collect_list("label")).alias("values"))
    return names.join(n, "column", "left").join(found, "column", "left").select("column", "dtype", "cardinality", "values")


def dataset_context(table: DataFrame, cap: int = 50) -> DataFrame:
    """What an assistant is told of each column: its labels where there are at most ``cap``."""
    return schema_summary(table, cap, ontology=True)


def relabel(genes: DataFrame, var: DataFrame, label: str) -> DataFrame:
    """``genes`` (gene_id, ..) with the label that the column ``label`` of ``var`` gives; unlabelled ones keep their number."""
    if label not in var.columns:
        raise KeyError(f"no var column {label}; there are {var.columns}")
    names = var.select("gene_id", F.col(label).cast("string").alias("label"))
    return genes.join(names, "gene_id", "left").withColumn("label", F.coalesce("label", F.col("gene_id").cast("string")))


def store_facts(store: Store, cap: int = 100) -> DataFrame:
    """Cells, genes, entries, density, embeddings, and each cell column's type, cardinality and values up to ``cap``, in one row."""
    n = store.obs.agg(F.count("*").alias("n_obs")).crossJoin(store.var.agg(F.count("*").alias("n_var"))).crossJoin(store.x.agg(F.count("*").alias("entries")))  # one row each
    if store.obsm is None:
        n = n.withColumn("embeddings", F.array().cast("array<string>"))
    else:
        n = n.crossJoin(store.obsm.agg(F.sort_array(F.collect_set("key")).alias("embeddings")))
    facets = schema_summary(store.obs.drop("cell_id"), cap).agg(F.sort_array(F.collect_list(F.struct("column", "dtype", "cardinality", "values"))).alias("obs_facets"))
    return n.crossJoin(facets).withColumn("density", F.try_divide(F.col("entries"), F.col("n_obs") * F.col("n_var")))
