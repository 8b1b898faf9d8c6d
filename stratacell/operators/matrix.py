"""Normalisation, gene selection and preparation of the matrix, and its decompositions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import checkpointed
from ..functions.quantiles import exact_quantiles
from ..functions.scalars import as_label
from ..sources.store import Store
from .neighbours import knn_of, knn_ranked


def cell_totals(store: Store, layer: str | None = None) -> DataFrame:
    """Sum over all genes, 0 for cells without entries."""
    t = store.matrix(layer).groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).alias("total"))
    return store.obs.select("cell_id").join(t, "cell_id", "left").select("cell_id", F.coalesce("total", F.lit(0.0)).alias("total"))


def normalize_log1p(store: Store, target: float | None = None, layer: str | None = None) -> DataFrame:
    """log1p of values scaled so that each cell sums to ``target``: the median of the positive totals by default. The totals are
    summed once, stored, and meet the entries in a join by cell."""
    x = store.matrix(layer)
    totals = x.groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).alias("total"))
    if target is None:
        totals = checkpointed(totals)
        found = exact_quantiles(totals.where("total > 0").select("total"), [0.5])
        if found is None:
            raise ValueError("all cells are empty")
        target = found[0]
    scale = F.coalesce(F.try_divide(F.lit(float(target)), F.col("total")), F.lit(0.0))
    return x.join(totals, "cell_id").select("cell_id", "gene_id", F.log1p(F.col("value").cast("double") * scale).alias("value"))


def select_ranked(var: DataFrame, n: int) -> DataFrame:
    """The ``n`` best genes by the first present of: rank, standardised variance, flag; in file order. All genes without such a column."""
    q = lambda c: F.col(f"`{c}`")
    if "highly_variable_rank" in var.columns:
        best = var.where(q("highly_variable_rank").isNotNull()).orderBy("highly_variable_rank", "gene_id").limit(n)
    elif "vst.variance.standardized" in var.columns:
        best = var.where(q("vst.variance.standardized").isNotNull()).orderBy(q("vst.variance.standardized").desc(), "gene_id").limit(n)
    elif "highly_variable" in var.columns:
        best = var.where(q("highly_variable")).orderBy("gene_id").limit(n)
    else:
        return var
    return best.orderBy("gene_id")


def restrict(x: DataFrame, genes: DataFrame) -> DataFrame:
    return x.join(genes.select("gene_id"), "gene_id", "left_semi")


def dispersion_genes(store: Store, n: int, bins: int = 20) -> DataFrame:
    """(gene_id, mean, dispersion, score, highly_variable) of all genes: the score is the log dispersion, standardised among genes of like mean."""
    cells = store.obs.agg(F.count("*").alias("n"))
    v = F.col("value").cast("double")
    g = store.x.groupBy("gene_id").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss")).crossJoin(F.broadcast(cells))
    mean = F.col("s") / F.col("n")
    g = g.where("s > 0").select("gene_id", mean.alias("mean"), ((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("variance"))
    g = g.select("gene_id", "mean", (F.col("variance") / F.col("mean")).alias("dispersion"), F.log1p("mean").alias("lm"))
    ends = g.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    g = g.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor((F.col("lm") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)))
    w, d = Window.partitionBy("bin"), F.log("dispersion")
    spread = F.stddev_samp(d).over(w)
    g = g.where("dispersion > 0").withColumn("score", F.when(spread > 0, (d - F.avg(d).over(w)) / spread).otherwise(F.lit(1.0)))
    best = g.orderBy(F.desc(F.round("score", 9)), "gene_id").limit(n).select("gene_id", F.lit(True).alias("hv"))
    return store.var.select("gene_id").join(g, "gene_id", "left").join(best, "gene_id", "left").select(
        "gene_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "dispersion", "score")], F.coalesce("hv", F.lit(False)).alias("highly_variable")
    )


def categories(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, code, label): the labels of each column in order, numbered from 0. Labels are few beside rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in columns])
    labels = table.select(F.inline(pairs)).where("label is not null").distinct()
    return labels.select("column", (F.row_number().over(Window.partitionBy("column").orderBy("label")) - 1).alias("code"), "label")


def encode_categorical(table: DataFrame, columns: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """(cell_id, column, code) with code -1 for missing labels and for those that ``labels`` lacks."""
    labels = categories(table, columns) if labels is None else labels
    rows = table.select("cell_id", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in columns])))
    return rows.join(labels, ["column", "label"], "left").select("cell_id", "column", F.coalesce("code", F.lit(-1)).alias("code"))


def decode_categorical(codes: DataFrame, categories: DataFrame) -> DataFrame:
    """(cell_id, column, label): code -1 and unknown codes give null. ``categories`` (column, code, label)."""
    return codes.join(categories, ["column", "code"], "left").select("cell_id", "column", "label")


def decode_nullable(rows: DataFrame) -> DataFrame:
    return rows.select("cell_id", F.when(F.col("mask"), F.lit(None)).otherwise(F.col("value")).alias("value"))


#: Columns of other names that give a required one where it is absent, and the columns of prepared cells.
ALIASES = {
    "sample_id": "sample",
    "donor_id": "patient",
    "platform": "technology",
    "tissue": "site",
    "cell_type_study": "author_cell_type",
    "dataset": "dataset_id",
}
REQUIRED = ("sample", "cell_type", "author_cell_type", "technology", "expression_unit", "site", "disease", "patient", "dataset_id", "cell_name")


def _labels(table: DataFrame, columns: Sequence[str]) -> dict:
    kinds = dict(table.dtypes)
    return {c: as_label(F.col(c), kinds[c] in ("double", "float")) for c in columns}


def prepare_obs(obs: DataFrame, dataset: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """(cell_id, cell_key, ``required``): raw counts only, columns under their required names, all labels as text. The
    cell's own name is kept, and its key is made unique by the dataset's name."""
    if "matrix_type" in obs.columns:
        obs = obs.where("matrix_type = 'raw counts'")
    for old, new in ALIASES.items():
        if old in obs.columns and new not in obs.columns:
            obs = obs.withColumn(new, F.col(old))
    obs = obs.withColumn("expression_unit", F.lit("UMI")).withColumn("cell_name", F.col("cell_id").cast("string"))
    missing = [c for c in required if c not in obs.columns]
    if missing:
        raise ValueError(f"no columns for {missing}")
    return obs.withColumns(_labels(obs, required)).select("cell_id", F.concat_ws("_", F.lit(dataset), "cell_name").alias("cell_key"), *required)


#: The gene columns that preparation keeps, and those that give the symbol, in order.
KNOWN_VAR = ("var_names", "GeneSymbol", "ensembl", "Chromosome")
SYMBOLS = ("GeneSymbol", "var_names")


def prepare_var(var: DataFrame) -> DataFrame:
    """(gene_id, known columns that are there, gene_symbol), all labels as text; without a symbol column the gene's id is the symbol."""
    known = [c for c in KNOWN_VAR if c in var.columns]
    symbol = next((c for c in SYMBOLS if c in var.columns), "gene_id")
    var = var.select("gene_id", *known, F.col(symbol).alias("gene_symbol"))
    return var.withColumns(_labels(var, [*known, "gene_symbol"]))


def prepare(store: Store, dataset: str, layer: str = "counts") -> Store:
    """A dataset's part of a joint matrix: raw counts from ``layer``, of the cells that are kept, cells by their keys."""
    obs, x = prepare_obs(store.obs, dataset), store.matrix(layer)
    x = x.join(obs.select("cell_id", "cell_key"), "cell_id").select(F.col("cell_key").alias("cell_id"), "gene_id", "value")
    return Store(obs.drop("cell_id").withColumnRenamed("cell_key", "cell_id"), prepare_var(store.var), x)


#: Cells of a gene that one call of a user's function sees, at most about; rows of a call, about.
GENE_BLOCK, CALL_ROWS = 100_000, 50_000


def reduce_genes(x: DataFrame, part: Callable, merge: Callable, schema: str, block: int = GENE_BLOCK) -> DataFrame:
    """A user's reduction of each gene, in two steps so that no call sees all cells of a gene: ``part`` takes the entries
    (cell_id, gene_id, value) of some genes in ``block`` consecutive cell ids, ``merge`` the rows that ``part`` returned for some
    genes. Both are pandas functions that group by gene_id and return rows of ``schema``, which has gene_id. A call has as many
    genes as make CALL_ROWS entries, about, so that calls are as many as the entries ask for, and not as the genes."""
    at = F.floor(F.col("cell_id") / block)
    n, blocks = x.agg(F.count("*"), F.count_distinct(at)).first()
    slots = lambda rows: F.pmod(F.xxhash64("gene_id"), F.lit(max(1, -(-rows // CALL_ROWS))))
    own = lambda f, *names: lambda rows: f(rows.drop(columns=list(names)))
    dealt = x.withColumn("block", at).withColumn("slot", slots(-(-n // max(1, blocks))))
    parts = dealt.groupBy("slot", "block").applyInPandas(own(part, "slot", "block"), schema)
    return parts.withColumn("slot", slots(n)).groupBy("slot").applyInPandas(own(merge, "slot"), schema)


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def concatenate_stores(parts: Sequence[Store]) -> Store:
    """Cells and entries of all parts; the genes are those of the first, which all share."""
    return Store(concatenate([p.obs for p in parts]), parts[0].var, concatenate([p.x for p in parts]))


def normalized(store: Store, target: float | None = None, layer: str | None = None) -> Store:
    """The store with a normalised matrix, and the mark in ``uns`` that says so."""
    mark = store.obs.sparkSession.range(1).select(F.lit("log1p").alias("path"), F.lit("{}").alias("value_json"))
    uns = mark if store.uns is None else store.uns.where("path <> 'log1p'").unionByName(mark)
    return replace(store, x=normalize_log1p(store, target, layer), uns=uns)


#: Numbers of a thin matrix (genes times directions) that goes to the tasks, at most, and directions beside those asked for.
MOST_THIN, SPARE = 8_000_000, 8
#: Blocks of directions that are kept before they are folded into one, and passes at most.
BLOCKS, PASSES = 8, 100


def _products(rows: DataFrame, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The sum over all cells of (cell's entries)' (cell's entries) v: each task sums a thin matrix, and the sums are added in a tree."""
    table = rows.sparkSession.sparkContext.broadcast((ids, v))  # MOST_THIN numbers

    def part(batches):
        ids, v = table.value
        total = np.zeros_like(v)
        for b in batches:
            ends = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(b["genes"]), np.int64))]
            genes, values = (np.asarray(pc.list_flatten(b[c])) for c in ("genes", "v"))
            at, to = 0, 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 21) // v.shape[1], "right")) - 1)
                lo, hi = ends[at], ends[to]
                g, x = np.searchsorted(ids, genes[lo:hi]), values[lo:hi]
                cell = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
                z = np.zeros((to - at, v.shape[1]))
                if len(g):
                    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    z[cell[starts]] = np.add.reduceat(x[:, None] * v[g], starts)
                    order = np.argsort(g, kind="stable")
                    firsts = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]])
                    total[g[order][firsts]] += np.add.reduceat((x[:, None] * z[cell])[order], firsts)
                at = to
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["g"])

    def add(batches):
        total = None
        for b in batches:
            for g in b["g"]:
                one = np.frombuffer(g.as_py())
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["g"])

    sums, parts = rows.mapInArrow(part, "g binary"), rows.rdd.getNumPartitions()
    while parts > 4:
        parts = -(-parts // 8)
        sums = sums.repartition(parts).mapInArrow(add, "g binary")
    return sum((np.frombuffer(r["g"]) for r in sums.collect()), np.zeros(v.size)).reshape(v.shape)  # four thin matrices at most


def _orthonormal(block: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Directions of ``block`` beside those of ``basis``; those that it holds already are left out."""
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        scale = np.abs(np.diag(r))
        block = q[:, scale > 1e-10 * max(scale.max(initial=0), 1e-300)]
    return block


def singular(rows: DataFrame, ids: np.ndarray, k: int, seed: int = 1, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values of the cells' entries and their directions over the genes ``ids``, by randomised blocks:
    each pass over the cells multiplies a thin block, the best directions of all blocks so far are found among them on the driver, and what
    they still lack is the next block. Ends when that is within ``tolerance`` of the largest."""
    n = len(ids)
    k = min(k, n)
    width = min(n, k + SPARE)
    if n * width > MOST_THIN:
        raise ValueError(f"{n} genes times {width} directions; {MOST_THIN} at most")
    block = _orthonormal(np.random.default_rng(seed).normal(size=(n, width)))
    basis, image = block, _products(rows, ids, block)
    for _ in range(PASSES):
        values, turn = np.linalg.eigh((lambda m: (m + m.T) / 2)(basis.T @ image))
        turn = turn[:, ::-1][:, :width]
        values = values[::-1][:width]
        best, best_image = basis @ turn, image @ turn
        lacks = best_image - best * values
        if np.linalg.norm(lacks[:, :k], axis=0).max(initial=0) <= tolerance * max(abs(values[0]), 1e-300) or basis.shape[1] >= n:
            break
        if basis.shape[1] + width > BLOCKS * width:
            basis, image = best, best_image
        block = _orthonormal(lacks, basis)
        if not block.shape[1]:
            break
        basis, image = np.hstack([basis, block]), np.hstack([image, _products(rows, ids, block)])
    else:
        raise RuntimeError(f"singular values are not settled after {PASSES} passes")
    v = best[:, :k]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)  # the largest weight of a direction is positive
    return np.sqrt(np.maximum(values[:k], 0)), v


def svd_scores(store: Store, k: int) -> tuple[DataFrame, list[float]]:
    """Coordinates (cell_id, component, score) of the cells that have entries on the first ``k`` singular directions, without
    centring, and the singular values; see :func:`singular`. Genes are those that have entries, whatever their numbers are; the
    largest weight of a direction is positive."""
    value = F.col("value").cast("double")
    x = store.x.where(value != 0)
    ids = np.sort(np.array([r[0] for r in x.select(F.col("gene_id").cast("long")).distinct().limit(MOST_THIN + 1).collect()], np.int64))  # MOST_THIN at most
    if not len(ids):
        return store.x.sparkSession.createDataFrame([], "cell_id long, component int, score double"), []
    entries = F.collect_list(F.struct(F.col("gene_id").cast("long").alias("g"), value.alias("v")))  # a cell has as many as there are genes, at most
    rows = checkpointed(x.groupBy("cell_id").agg(entries.alias("e")).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("e.g").alias("genes"), F.col("e.v").alias("v")))
    values, v = singular(rows, ids, k)
    table = rows.sparkSession.sparkContext.broadcast((ids, v))

    def scores(batches):
        ids, v = table.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                length = np.asarray(pc.list_value_length(part["genes"]), np.int64)
                weights = v[np.searchsorted(ids, np.asarray(pc.list_flatten(part["genes"])))] * np.asarray(pc.list_flatten(part["v"]))[:, None]
                s = np.add.reduceat(weights, np.r_[0, np.cumsum(length)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(part["cell_id"]), v.shape[1])), pa.array(np.tile(np.arange(v.shape[1], dtype=np.int32), part.num_rows)), pa.array(s.ravel())], ["cell_id", "component", "score"]
                )

    return rows.mapInArrow(scores, "cell_id long, component int, score double"), values.tolist()


def knn_within(vectors: DataFrame, k: int, radius: float, tables: int = 8, width: float | None = None, seed: int = 1) -> DataFrame:
    """(row_id, col_id, value): edges from every cell to the ``k`` nearest that lie within ``radius``, by distance, for ``obsp``.
    Pairs are met in buckets of random projections, so neighbours that share no bucket are missed: see :func:`knn_recall`."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = vectors.select("cell_id", array_to_vector(F.transform("coords", lambda c: c.cast("double"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width or radius, numHashTables=tables, seed=seed).fit(v)
    pairs = model.approxSimilarityJoin(v, v, radius, distCol="value").select(F.col("datasetA.cell_id").alias("row_id"), F.col("datasetB.cell_id").alias("col_id"), "value").where("row_id <> col_id")
    best = F.row_number().over(Window.partitionBy("row_id").orderBy("value", "col_id"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k).select("row_id", "col_id", "value")


def knn_recall(edges: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> float:
    """The share of the ``k`` nearest of ``queries``, found by comparison with all ``vectors``, that ``edges`` has."""
    true = knn(queries, vectors, k).select(F.col("cell_id").alias("row_id"), F.col("neighbour").alias("col_id"))
    hit = true.join(edges.select("row_id", "col_id", F.lit(1).alias("hit")), ["row_id", "col_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0


#: Queries that are met with all vectors; for all cells there is :func:`knn_graph`.
MOST_QUERIES = 1_000_000


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(cell_id, neighbour, distance, rank): the ``k`` nearest of all ``vectors`` (cell_id, coords) to each query, by squared
    Euclidean distance. The query set is given and met with all rows in blocks; at most ``k`` candidates of each block go on.
    Vectors with no place (:mod:`neighbours`) have no neighbours and are none."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    return _named(knn_of(queries, vectors, k))


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """(cell_id, neighbour, distance, rank): as :func:`knn`, of every cell of ``vectors``, however many there are."""
    return _named(knn_ranked(vectors, k, squared=True))


def _named(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("row_id").alias("cell_id"), F.col("col_id").alias("neighbour"), F.col("value").alias("distance"), "rank")
