"""Differential expression, markers, summaries and panels, over sums of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import cohens_d, sample_variance, welch_t
from ..sources.store import Store

MOST = 50
#: Groups of which markers are found at once.
MOST_GROUPS = 50_000


def clamp(n: int) -> int:
    return max(1, min(n, MOST))


def group_sums(store: Store, column: str, layer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(group, gene_id, sum_x, sum_xx, nnz, stored, low) of the stored entries, and (group, n_cells) from the cells."""
    groups = store.column(column).withColumnRenamed(column, "group")
    v = F.col("value").cast("double")
    sums = store.matrix(layer).join(groups, "cell_id").groupBy("group", "gene_id").agg(
        F.sum(v).alias("sum_x"), F.sum(v * v).alias("sum_xx"), F.count_if(v > 0).alias("nnz"), F.count("*").alias("stored"), F.min(v).alias("low")
    )
    return sums, groups.groupBy("group").agg(F.count("*").alias("n_cells"))


def two_sample(sums: DataFrame) -> DataFrame:
    """Means, Cohen's d and Welch's t from sum_x_a, sum_xx_a, n_a, sum_x_b, sum_xx_b, n_b."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    mean_a, mean_b = F.try_divide("sum_x_a", n_a), F.try_divide("sum_x_b", n_b)
    var_a, var_b = sample_variance(F.col("sum_x_a"), F.col("sum_xx_a"), n_a), sample_variance(F.col("sum_x_b"), F.col("sum_xx_b"), n_b)
    args = (mean_a, var_a, n_a, mean_b, var_b, n_b)
    return sums.select("*", mean_a.alias("mean_a"), mean_b.alias("mean_b"), cohens_d(*args).alias("cohens_d"), welch_t(*args).alias("t"))


def rank_by_effect(stats: DataFrame, n: int) -> DataFrame:
    """The ``n`` strongest effects; undefined ones last, ties by gene."""
    return stats.orderBy(F.abs("cohens_d").desc_nulls_last(), "gene_id").limit(clamp(n))


def _two(sums: DataFrame, cells: DataFrame, var: DataFrame, a: Column, b: Column) -> DataFrame:
    """One pass over the group sums: those of ``a`` and of ``b`` for every gene, zero genes included."""
    pick = lambda c, k: F.sum(F.when(k, F.col(c)).otherwise(0.0))
    s = sums.groupBy("gene_id").agg(
        pick("sum_x", a).alias("sum_x_a"), pick("sum_xx", a).alias("sum_xx_a"), pick("sum_x", b).alias("sum_x_b"), pick("sum_xx", b).alias("sum_xx_b")
    )
    count = lambda k: F.coalesce(F.sum(F.when(k, F.col("n_cells"))), F.lit(0))
    n = cells.agg(count(a).alias("n_a"), count(b).alias("n_b"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sum_x_a", "sum_xx_a", "sum_x_b", "sum_xx_b")]
    return var.select("gene_id").join(s, "gene_id", "left").select("gene_id", *zero).crossJoin(F.broadcast(n))  # n is one row


def need_cells(cells: DataFrame, groups: list[str], least: int = 2) -> None:
    found = {r["group"]: r["n_cells"] for r in cells.where(F.col("group").isin(groups)).collect()}
    for g in groups:
        if found.get(g, 0) < least:
            raise ValueError(f"group {g!r} has {found.get(g, 0)} cells; {least} are needed")


def compare_groups(sums: DataFrame, cells: DataFrame, var: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """The genes that differ most between two groups. ``sums`` and ``cells`` come from a scan or from strata."""
    need_cells(cells, [a, b])
    s = _two(sums.where(F.col("group").isin(a, b)), cells.where(F.col("group").isin(a, b)), var, F.col("group") == a, F.col("group") == b)
    return rank_by_effect(two_sample(s), n).select("gene_id", "mean_a", "mean_b", "cohens_d", "t", "n_a", "n_b")


def find_markers(sums: DataFrame, cells: DataFrame, var: DataFrame, group: str, n: int = 10) -> DataFrame:
    """One group against all other cells, those without a label included."""
    need_cells(cells, [group])
    own = F.coalesce(F.col("group") == group, F.lit(False))
    rest = cells.where(~own).agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0]
    if rest < 2:
        raise ValueError(f"the rest beside {group!r} has {rest} cells; 2 are needed")
    return rank_by_effect(two_sample(_two(sums, cells, var, own, ~own)), n).select("gene_id", "mean_a", "mean_b", "cohens_d", "t", "n_a", "n_b")


def markers_of_all_groups(sums: DataFrame, cells: DataFrame, var: DataFrame, n: int = 5) -> DataFrame:
    """The markers of every group at once: the rest is the total less the group. A gene that a group does not express
    counts there too, with zeros; so the work is as large as groups times genes, of which the groups are few."""
    total = sums.groupBy("gene_id").agg(F.sum("sum_x").alias("all_x"), F.sum("sum_xx").alias("all_xx"))
    groups = cells.agg(F.collect_list(F.struct("group", "n_cells")).alias("g"), F.sum("n_cells").alias("n_all"), F.count("*").alias("n_groups"))
    if groups.first()["n_groups"] > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    grid = var.select("gene_id").join(total, "gene_id", "left").crossJoin(F.broadcast(groups)).select("gene_id", "all_x", "all_xx", "n_all", F.inline("g"))  # one row
    own = sums.select(F.col("group").alias("own_group"), F.col("gene_id").alias("own_gene"), "sum_x", "sum_xx")
    t = grid.join(own, (F.col("gene_id") == F.col("own_gene")) & F.col("group").eqNullSafe(F.col("own_group")), "left")
    x, xx, all_x, all_xx = (F.coalesce(c, F.lit(0.0)) for c in ("sum_x", "sum_xx", "all_x", "all_xx"))
    s = two_sample(t.select(
        "group", "gene_id", x.alias("sum_x_a"), xx.alias("sum_xx_a"), F.col("n_cells").alias("n_a"),
        (all_x - x).alias("sum_x_b"), (all_xx - xx).alias("sum_xx_b"), (F.col("n_all") - F.col("n_cells")).alias("n_b"),
    ).where("n_a >= 2 and n_b >= 2"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.abs("cohens_d").desc_nulls_last(), "gene_id"))
    return s.withColumn("rank", rank).where(F.col("rank") <= clamp(n)).select("group", "rank", "gene_id", "mean_a", "mean_b", "cohens_d", "t")


def top_of_sums(sums: DataFrame, cells: DataFrame, var: DataFrame, group: str, n: int = 10) -> DataFrame:
    """The genes of highest mean in a group, with the fraction of cells above 0. ``sums`` and ``cells`` come from a scan or from strata."""
    need_cells(cells, [group], 1)
    own = sums.where(F.col("group") == group).groupBy("gene_id").agg(F.sum("sum_x").alias("s"), F.sum("nnz").alias("pos"))
    n_cells = cells.where(F.col("group") == group).agg(F.sum("n_cells").alias("n_cells"))
    rows = var.select("gene_id").join(own, "gene_id", "left").crossJoin(F.broadcast(n_cells))  # one row
    share = lambda c: (F.coalesce(c, F.lit(0)) / F.col("n_cells"))
    return rows.select("gene_id", share("s").alias("mean"), share("pos").alias("fraction")).orderBy(F.desc("mean"), "gene_id").limit(clamp(n))


def top_expressed(store: Store, column: str, group: str, n: int = 10, rule: str = "positive") -> DataFrame:
    """:func:`top_of_sums` by a scan; ``above_min`` counts the cells above the gene's least value in the group."""
    if rule == "positive":
        return top_of_sums(*group_sums(store, column), store.var, group, n)
    cells = store.column(column).where(F.col(column) == group).select("cell_id")
    n_cells = cells.count()
    if not n_cells:
        raise ValueError(f"group {group!r} has no cells")
    x = store.x.join(cells, "cell_id").select("gene_id", F.col("value").cast("double").alias("v"))
    s = x.groupBy("gene_id").agg(F.sum("v").alias("s"), F.min("v").alias("low"), F.count("*").alias("stored"))
    floor = F.when(F.col("stored") < n_cells, F.least("low", F.lit(0.0))).otherwise(F.col("low"))
    s = s.withColumn("floor", floor)
    above = x.join(s.select("gene_id", "floor"), "gene_id").groupBy("gene_id").agg(F.count_if(F.col("v") > F.col("floor")).alias("above"))
    zeros = F.when(F.col("floor") < 0, n_cells - F.col("stored")).otherwise(0)
    s = s.join(above, "gene_id").select("gene_id", "s", (F.col("above") + zeros).alias("pos"))
    share = lambda c: (F.coalesce(c, F.lit(0)) / n_cells)
    return store.var.select("gene_id").join(s, "gene_id", "left").select("gene_id", share("s").alias("mean"), share("pos").alias("fraction")).orderBy(F.desc("mean"), "gene_id").limit(clamp(n))


def _grid(cells: DataFrame, var: DataFrame, genes: Sequence[int]) -> DataFrame:
    """Every group with every named gene."""
    return cells.crossJoin(F.broadcast(var.where(F.col("gene_id").isin(list(genes))).select("gene_id")))  # the named genes, 50 at most


def panel_above_min(store: Store, labels: DataFrame, genes: Sequence[int], declared: DataFrame | None = None) -> DataFrame:
    """(group, gene_id, mean, fraction, n_cells) over the cells of ``labels`` (cell_id, label): a value counts if it is above
    the gene's least one among the cells that have a label, zeros that are not stored included. Cells without a label are a group that has no part in that least value."""
    cells = labels.toDF("cell_id", "group")
    n = _with_declared(cells.groupBy("group").agg(F.count("*").alias("n_cells")), declared)
    n_all = n.where(F.col("group").isNotNull()).agg(F.coalesce(F.sum("n_cells"), F.lit(0))).first()[0]
    x = store.entries(genes).join(cells, "cell_id").select("group", "gene_id", F.col("value").cast("double").alias("v"))
    low = x.where(F.col("group").isNotNull()).groupBy("gene_id").agg(F.when(F.count("*") < n_all, F.least(F.min("v"), F.lit(0.0))).otherwise(F.min("v")).alias("floor"))
    s = x.join(low, "gene_id").groupBy("group", "gene_id").agg(F.sum("v").alias("s"), F.count_if(F.col("v") > F.col("floor")).alias("above"), F.count("*").alias("stored"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    zeros = F.when(F.col("floor") < 0, F.col("n_cells") - zero("stored")).otherwise(0)
    return _grid(n, store.var, genes).join(s.withColumnRenamed("group", "g").withColumnRenamed("gene_id", "k"), F.col("group").eqNullSafe(F.col("g")) & (F.col("gene_id") == F.col("k")), "left").join(
        low, "gene_id", "left"
    ).select("group", "gene_id", _share("s").alias("mean"), F.coalesce(F.try_divide(zero("above") + zeros, F.col("n_cells")), F.lit(0.0)).alias("fraction"), "n_cells")


def _share(c: str) -> Column:
    return F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col("n_cells")), F.lit(0.0))


def _with_declared(cells: DataFrame, declared: DataFrame | None) -> DataFrame:
    """``cells`` (group, n_cells) with the labels of ``declared`` (label) that no cell has, as 0."""
    if declared is None:
        return cells
    return cells.unionByName(declared.select(F.col("label").alias("group"), F.lit(0).cast("long").alias("n_cells"))).groupBy("group").agg(F.sum("n_cells").alias("n_cells"))


def gene_panel(store: Store, column: str, genes: Sequence[int], rule: str = "positive") -> DataFrame:
    """Mean, fraction expressing and cells of each gene in each category; categories without entries, or that the store
    declares and no cell has, give 0. ``rule``: values count above 0 (``positive``) or above the gene's least value (``above_min``)."""
    if not 0 < len(genes) <= MOST:
        raise ValueError(f"1 to {MOST} genes")
    if rule == "above_min":
        return panel_above_min(store, store.column(column), genes, store.labels(column))
    return panel_of_sums(*group_sums(store, column), store.var, genes, store.labels(column))


def panel_of_sums(sums: DataFrame, cells: DataFrame, var: DataFrame, genes: Sequence[int], declared: DataFrame | None = None) -> DataFrame:
    """The panel of values above 0. ``sums`` and ``cells`` come from a scan or from strata."""
    sums = sums.where(F.col("gene_id").isin(list(genes))).withColumnRenamed("group", "g").withColumnRenamed("gene_id", "k")
    return _grid(_with_declared(cells, declared), var, genes).join(sums, F.col("group").eqNullSafe(F.col("g")) & (F.col("gene_id") == F.col("k")), "left").select(
        "group", "gene_id", _share("sum_x").alias("mean"), _share("nnz").alias("fraction"), "n_cells"
    )


def gene_summary(store: Store, gene_id: int, by: str) -> DataFrame:
    """Mean and fraction above 0 of one gene: overall (null group) and in each group, the highest means first."""
    rows = store.gene(gene_id).join(store.column(by), "cell_id").select(F.col(by).alias("group"), "value")
    agg = lambda d: d.agg(F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("double")).alias("fraction"), F.count("*").alias("n_cells"))
    by_group = agg(rows.groupBy("group")).orderBy(F.desc("mean"), "group").limit(MOST)
    return agg(rows.groupBy(F.lit(None).cast("string").alias("group"))).unionByName(by_group)


#: What the stored values may be.
STATES = (
    "empty (all zeros)",
    "z-scored / scaled (negative values, std ~1)",
    "z-scored / scaled (negative values present)",
    "raw counts (integers)",
    "likely raw counts (small integers)",
    "log-normalized (floats, range 0-15)",
    "normalized (floats, not log-transformed)",
)


def scan_state(x: DataFrame) -> DataFrame:
    """What the stored values look like, by those that are not 0."""
    v = F.col("value").cast("double")
    near = F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v))
    a = x.where(v != 0).agg(F.min(v).alias("low"), F.max(F.abs(v)).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("spread"), F.every(near).alias("whole"))
    standard = (F.col("spread") > 0.5) & (F.col("spread") < 2.0) & (F.abs("mean") < 1.0)
    state = (
        F.when(F.col("low").isNull(), STATES[0]).when((F.col("low") < 0) & standard, STATES[1]).when(F.col("low") < 0, STATES[2])
        .when(F.col("whole") & (F.col("high") > 20), STATES[3]).when(F.col("whole"), STATES[4]).when(F.col("high") < 15, STATES[5]).otherwise(STATES[6])
    )
    return a.withColumn("state", state)
