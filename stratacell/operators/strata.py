"""Strata: additive sums for each tuple of cell categories and gene, and what can be read from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain, combinations
from math import ceil, prod
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import sample_variance
from ..sources.store import Store

MOST_TUPLES = 50_000
MOST_NULL = 0.05
SUMS = ("sum_x", "sum_xx", "nnz")


def strata_cells(store: Store, axes: Sequence[str]) -> DataFrame:
    """Cells of each populated tuple."""
    return store.obs.groupBy(*axes).agg(F.count("*").alias("n_cells"))


def build_atomic(store: Store, axes: Sequence[str], genes: DataFrame | None = None, gene: str = "gene_id", layer: str | None = None) -> DataFrame:
    """(axes, gene, sum_x, sum_xx, nnz). ``genes`` (gene_id, ``gene``) may put genes into groups."""
    v = F.col("value").cast("double")
    x = store.matrix(layer)
    if genes is not None:
        x = x.join(genes, "gene_id")
    rows = x.join(store.obs.select("cell_id", *axes), "cell_id")
    return rows.groupBy(*axes, gene).agg(F.sum(v).alias("sum_x"), F.sum(v * v).alias("sum_xx"), F.count_if(v > 0).alias("nnz"))


def numbered(cells: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``cells``, a row for each stratum, with its number in their order (``stratum``); a table of strata has MOST_TUPLES at most."""
    order = [F.col(a).asc_nulls_first() for a in axes]
    number = F.row_number().over(Window.orderBy(*order)) - 1 if axes else F.lit(0)  # without axes there is one stratum
    return cells.withColumn("stratum", number.cast("int"))


def numbers_of(rows: DataFrame, strata: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``rows`` with the ``stratum`` that their labels have in ``strata``, the output of :func:`numbered`, instead of these."""
    own = strata.select("stratum", *[F.col(a).alias(f"own_{a}") for a in axes])
    same = reduce(and_, [F.col(a).eqNullSafe(F.col(f"own_{a}")) for a in axes], F.lit(True))
    return rows.join(F.broadcast(own), same).select("stratum", *[c for c in rows.columns if c not in axes])  # MOST_TUPLES at most


def numbered_sums(store: Store, axes: Sequence[str], strata: DataFrame, tasks: int) -> DataFrame:
    """:func:`build_atomic` by the numbers of ``strata``: (stratum, gene_id, sums). Entries meet the numbers of their cells, so no labels are
    shuffled; a task has a table of its cells, and ``tasks`` are as many as keep that small."""
    v = F.col("value").cast("double")
    cells = numbers_of(store.obs.select("cell_id", *axes), strata, axes)
    rows = store.x.repartition(tasks, "cell_id").join(cells.repartition(tasks, "cell_id").hint("shuffle_hash"), "cell_id")
    return rows.groupBy("stratum", "gene_id").agg(F.sum(v).alias("sum_x"), F.sum(v * v).alias("sum_xx"), F.count_if(v > 0).alias("nnz"))


def derive_coarse(atomic: DataFrame, axes: Sequence[str], gene: str = "gene_id") -> DataFrame:
    """The same sums over fewer axes; the matrix is not read again."""
    return atomic.groupBy(*axes, gene).agg(*[F.sum(c).alias(c) for c in SUMS])


def in_order(strata: DataFrame, axes: Sequence[str], gene: str = "gene_id") -> DataFrame:
    """Strata by their axes, one after the other, and then by gene."""
    return strata.orderBy(*axes, gene)


def grouping_sets(atomic: DataFrame, sets: Sequence[Sequence[str]], gene: str = "gene_id") -> DataFrame:
    """Several coarse tables in one pass; ``level`` has a bit for each axis that was summed over."""
    axes = sorted(set(chain.from_iterable(sets)))
    columns = [F.col(a) for a in [*axes, gene]]
    return atomic.groupingSets([[F.col(c) for c in [*s, gene]] for s in sets], *columns).agg(
        F.grouping_id(*columns).alias("level"), *[F.sum(c).alias(c) for c in SUMS]
    )


def surely_too_many(store: Store, axes: Sequence[str], most: int = MOST_TUPLES) -> bool:
    """A cheap first look: whether an approximate count of tuples is far above the cap."""
    return (store.obs.agg(F.approx_count_distinct(F.struct(*axes))).first()[0] or 0) > 2 * most


def preflight(store: Store, axes: Sequence[str], most: int = MOST_TUPLES) -> DataFrame:
    """For each axis its labels and share of nulls, beside the number of tuples; ``ok`` if the strata may be built."""
    missing = [a for a in axes if a not in store.obs.columns]
    if missing:
        raise ValueError(f"no obs columns {missing}")
    wrong = [a for a, t in store.obs.select(*axes).dtypes if t != "string"]
    if wrong:
        raise ValueError(f"not categorical: {wrong}")
    one = store.obs.agg(
        F.count_distinct(F.struct(*axes)).alias("tuples"),
        F.array(*[F.struct(F.lit(a).alias("axis"), F.count_distinct(a).alias("labels"), F.avg(F.col(a).isNull().cast("double")).alias("null_share")) for a in axes]).alias("a"),
    )
    return one.select("tuples", F.inline("a")).select("axis", "labels", "null_share", "tuples", ((F.col("tuples") <= most) & (F.coalesce("null_share", F.lit(0.0)) <= MOST_NULL)).alias("ok"))


#: Axes of a sketch at most, sketches of a table at most, and the logarithm of a sketch's registers (a relative error of about 0.4 %).
SKETCHED, MOST_SKETCHES, REGISTERS = 3, 1_000, 16


def axis_sketches(obs: DataFrame, axes: Sequence[str], most: int = SKETCHED) -> DataFrame:
    """(axes, rows, nulls, sketch) for each choice of up to ``most`` of the axes: a sketch of its distinct tuples, all in one pass; ``nulls``
    counts the rows where one is missing. Sketches of parts of the cells add up: :func:`merge_sketches`."""
    choices = [c for k in range(1, most + 1) for c in combinations(sorted(axes), k)]
    if len(choices) > MOST_SKETCHES:
        raise ValueError(f"{len(choices)} sketches; {MOST_SKETCHES} at most")
    tuple_of = lambda c: F.xxhash64(*[x for a in c for x in (F.col(f"`{a}`"), F.col(f"`{a}`").isNull())])
    missing = lambda c: reduce(lambda x, y: x | y, [F.col(f"`{a}`").isNull() for a in c])
    one = lambda c: F.struct(F.array(*map(F.lit, c)).alias("axes"), F.count(F.lit(1)).alias("rows"), F.count_if(missing(c)).alias("nulls"), F.hll_sketch_agg(tuple_of(c), REGISTERS).alias("sketch"))
    return obs.agg(F.array(*map(one, choices)).alias("s")).select(F.inline("s"))


def merge_sketches(parts: Sequence[DataFrame]) -> DataFrame:
    """The sketches of all parts of the cells together."""
    return reduce(DataFrame.unionByName, parts).groupBy("axes").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_tuples(sketches: DataFrame, axes: Sequence[str]) -> tuple[int, int]:
    """At least and at most how many tuples of ``axes`` there are, by their sketch; of more axes than a sketch has, by those of some."""
    named = F.array(*map(F.lit, axes))
    found = {tuple(r["axes"]): (r["n"], r["rows"]) for r in sketches.where(F.size(F.array_except("axes", named)) == 0).select("axes", "rows", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    unknown = [a for a in axes if (a,) not in found]
    if unknown:
        raise ValueError(f"no sketches of {unknown}")
    whole = tuple(sorted(set(axes)))
    if whole in found:
        return found[whole][0], found[whole][0]
    width, rows = max(map(len, found)), found[whole[:1]][1]
    split = [whole[i : i + width] for i in range(0, len(whole), width)]
    return max(n for n, _ in found.values()), min(rows, prod(found[c][0] for c in split))


def sketched_preflight(sketches: DataFrame, axes: Sequence[str], most: int = MOST_TUPLES, error: float = 0.02) -> DataFrame:
    """:func:`preflight` without a scan of the cells: (axis, labels, null_share, at_least, at_most, ok); ``ok`` is null where the sketches
    cannot tell, and the cells have to be counted."""
    low, high = sketched_tuples(sketches, axes)
    low, high = ceil(low / (1 + error)), ceil(high * (1 + error))
    fits = F.when(F.lit(low > most), False).when(F.lit(high <= most), True)
    share = F.coalesce(F.try_divide("nulls", "rows"), F.lit(0.0))
    one = sketches.where((F.size("axes") == 1) & F.col("axes")[0].isin(list(axes))).select(F.col("axes")[0].alias("axis"), F.hll_sketch_estimate("sketch").alias("n"), "nulls", share.alias("null_share"))
    labels = (F.col("n") - (F.col("nulls") > 0).cast("int")).alias("labels")
    return one.select("axis", labels, "null_share", F.lit(low).alias("at_least"), F.lit(high).alias("at_most"), F.when(F.col("null_share") > MOST_NULL, False).otherwise(fits).alias("ok"))


def statistics(strata: DataFrame, cells: DataFrame, axes: Sequence[str], gene: str = "gene_id") -> DataFrame:
    """Mean, fraction expressing and sample variance of each stratum and gene; a missing category is one of its own."""
    n = F.col("n_cells")
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), n), F.lit(0.0))
    own = cells.select("n_cells", *[F.col(a).alias(f"own_{a}") for a in axes])
    same = reduce(and_, [F.col(a).eqNullSafe(F.col(f"own_{a}")) for a in axes], F.lit(True))
    return strata.join(own, same).select(
        *axes, gene, n, ratio("sum_x").alias("mean"), ratio("nnz").alias("fraction"), sample_variance(F.col("sum_x"), F.col("sum_xx"), n).alias("variance")
    )


def dotplot(strata: DataFrame, cells: DataFrame, axis: str, genes: Sequence[int], groups: Sequence[str] | None = None) -> DataFrame:
    """(group, gene_id, n_cells, mean, fraction) of the named genes in each group of ``axis``, those without entries as 0."""
    sums, n = as_groups(strata.where(F.col("gene_id").isin(list(genes))), cells, axis)
    if groups is not None:
        n = n.where(F.col("group").isin(list(groups)))
    grid = n.select("group", "n_cells", F.explode(F.array(*[F.lit(g) for g in genes])).alias("gene_id"))
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_cells")), F.lit(0.0))
    sums = sums.withColumnRenamed("group", "g").withColumnRenamed("gene_id", "k")
    return grid.join(sums, F.col("group").eqNullSafe(F.col("g")) & (F.col("gene_id") == F.col("k")), "left").select("group", "gene_id", "n_cells", ratio("sum_x").alias("mean"), ratio("nnz").alias("fraction"))


def as_groups(strata: DataFrame, cells: DataFrame, axis: str) -> tuple[DataFrame, DataFrame]:
    """Strata in the shape that the comparisons take: any table that has the axis serves, summed over its others."""
    sums = derive_coarse(strata, [axis]).withColumnRenamed(axis, "group")
    return sums, cells.groupBy(F.col(axis).alias("group")).agg(F.sum("n_cells").alias("n_cells"))
