"""A store: cells, genes, and the expression matrix as coordinates with zeros left out."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INT32 = 2**31 - 1


@dataclass
class Store:
    """``obs(cell_id, ..)``, ``var(gene_id, ..)``, ``x(cell_id, gene_id, value)``, ``obsm(key, cell_id, coords)``; by name ``layers``
    (like ``x``), ``obsp`` and ``varp`` (row_id, col_id, value); ``uns(path, value_json)``; ``categories(column, code, label)``,
    the declared labels of cell columns in their order. A store that was opened from a disk has its ``root`` and the rows of its
    log then (``parts``)."""

    obs: DataFrame
    var: DataFrame
    x: DataFrame
    obsm: DataFrame | None = None
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    varp: dict[str, DataFrame] = field(default_factory=dict)
    uns: DataFrame | None = None
    categories: DataFrame | None = None
    root: str | None = None
    parts: tuple = ()
    seal: tuple | None = None
    ranges: tuple | None = None

    def sealed(self, content: str | None) -> Store:
        """The store with the ``content`` that its cells and its matrix are known by."""
        return replace(self, seal=(self.obs, self.x, content))

    @property
    def content(self) -> str | None:
        """What the cells and the matrix are known by; none once either has been replaced."""
        return self.seal[2] if self.seal and self.seal[0] is self.obs and self.seal[1] is self.x else None

    def labels(self, column: str) -> DataFrame | None:
        """(label, code) of the labels that are declared for a cell column; none where nothing is declared."""
        return None if self.categories is None else self.categories.where(F.col("column") == column).select("label", "code")

    def from_layer(self, layer: str = "counts") -> Store:
        """The store with a layer as its matrix."""
        return replace(self, x=self.matrix(layer))

    def matrix(self, layer: str | None = None) -> DataFrame:
        if layer is None:
            return self.x
        if layer not in self.layers:
            raise KeyError(f"no layer {layer}; there are {sorted(self.layers)}")
        return self.layers[layer]

    def column(self, name: str, of: str = "obs") -> DataFrame:
        table, key = (self.obs, "cell_id") if of == "obs" else (self.var, "gene_id")
        if name not in table.columns:
            raise KeyError(f"no {of} column {name}; there are {table.columns}")
        return table.select(key, name)

    def embedding(self, key: str) -> DataFrame:
        if self.obsm is None:
            raise KeyError("the store has no embeddings")
        return self.obsm.where(F.col("key") == key).select("cell_id", "coords")

    def ranged(self, x: DataFrame, rows: DataFrame, cuts: list[int]) -> Store:
        """The store with its matrix ``x`` also as ``rows`` that have the range of their gene (``genes``), as they are laid out."""
        return replace(self, x=x, ranges=(x, rows, cuts))

    def entries(self, genes: Sequence[int]) -> DataFrame:
        """The entries of some genes; of a stored matrix only the folders of their ranges are read."""
        own = F.col("gene_id").isin(list(genes))
        if not self.ranges or self.ranges[0] is not self.x:
            return self.x.where(own)
        _, rows, cuts = self.ranges
        return rows.where(F.col("genes").isin(sorted({bisect_left(cuts, g) for g in genes})) & own).select(*self.x.columns)

    def gene(self, gene_id: int) -> DataFrame:
        """(cell_id, value) of one gene for every cell, zeros included."""
        one = self.entries([gene_id]).select("cell_id", "value")
        return self.obs.select("cell_id").join(one, "cell_id", "left").select("cell_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def coo_from_dense(rows: DataFrame, cell: str, values: str) -> DataFrame:
    """Coordinates of the non-zero entries of an array column."""
    return rows.select(F.col(cell).alias("cell_id"), F.posexplode(values).alias("gene_id", "v")).where("v <> 0").select(
        "cell_id", "gene_id", F.col("v").cast("double").alias("value")
    )


def coo_from_csr(rows: DataFrame) -> DataFrame:
    """Coordinates from compressed rows ``(row, indices, data)``."""
    return rows.select(F.col("row").alias("cell_id"), F.explode(F.arrays_zip("indices", "data")).alias("e")).select(
        "cell_id", F.col("e.indices").alias("gene_id"), F.col("e.data").cast("double").alias("value")
    )


def coo_from_triple(entries: DataFrame, pointers: DataFrame, by_cell: bool = True) -> DataFrame:
    """Coordinates from one compressed matrix: ``entries`` (pos, index, value) and ``pointers`` (row, start), which has one
    row more than the matrix. Each row's range of positions is spelt out and meets the entries in an equi-join, so work
    is linear in the entries. ``by_cell`` says whether rows are cells (CSR) or genes (CSC)."""
    ends = pointers.select((F.col("row") - 1).alias("row"), F.col("start").alias("end"))
    places = pointers.join(ends, "row").where("end > start").select("row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    cell, gene = ("row", "index") if by_cell else ("index", "row")
    return entries.join(places, "pos").select(F.col(cell).alias("cell_id"), F.col(gene).alias("gene_id"), F.col("value").cast("double").alias("value"))


def csr_from_coo(x: DataFrame) -> DataFrame:
    """Compressed rows: each cell's genes in order. A row is as wide as the genes, which is bounded by the panel."""
    entry = F.sort_array(F.collect_list(F.struct("gene_id", "value")))
    return x.groupBy("cell_id").agg(entry.alias("e")).select(F.col("cell_id").alias("row"), F.col("e.gene_id").alias("indices"), F.col("e.value").alias("data"))


def densify(x: DataFrame, n_genes: int, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, values) with ``n_genes`` values for each cell that has an entry, or for all ``cells`` (cell_id)."""
    entries = x.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("gene_id").cast("int"), "value"))).alias("m"))
    if cells is not None:
        entries = cells.select("cell_id").join(entries, "cell_id", "left")
    value = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
    return entries.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(n_genes - 1)), value).alias("values"))


def index_bounds(x: DataFrame) -> DataFrame:
    """Largest indices and entry count, and whether each fits 32 bits."""
    out = x.agg(F.max("cell_id").cast("long").alias("max_cell"), F.max("gene_id").cast("long").alias("max_gene"), F.count("*").alias("entries"))
    return out.select("*", (F.greatest("max_cell", "max_gene", "entries") <= INT32).alias("fits_int32"))


def need_int32(x: DataFrame) -> DataFrame:
    """``x`` itself; an error where an index or the number of entries does not fit 32 bits."""
    bounds = index_bounds(x).first()
    if bounds["fits_int32"] is False:
        raise ValueError(f"too large for 32-bit indices: {bounds.asDict()}")
    return x


#: Bytes of a matrix file at most, about; what an entry takes on disk, about; ranges of genes at most.
FILE_BYTES, ENTRY_BYTES, MOST_RANGES = 128 << 20, 8, 256
#: Rows that a task of a shuffle sorts or groups, about.
TASK_ROWS = 500_000


def gene_cuts(x: DataFrame, file_bytes: int = FILE_BYTES, ranges: int | None = None) -> list[int]:
    """The last genes of all ranges but the highest: ranges of equal entries, each about a file, or so many. One pass with a mergeable sketch."""
    steps = 10 * MOST_RANGES
    shares = F.expr(f"array({', '.join(f'{i / steps!r}D' for i in range(1, steps))})")
    n, places = x.agg(F.count("*"), F.percentile_approx(F.col("gene_id").cast("long"), shares, steps)).first()
    if ranges is None:
        ranges = min(MOST_RANGES, -(-n * ENTRY_BYTES // file_bytes))
    return sorted({places[i * steps // ranges - 1] for i in range(1, ranges)}) if places else []


def range_of(gene: Column, cuts: Sequence[int], low: int = 0) -> Column:
    """The number of the range that a gene is in, by halves."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(gene <= cuts[mid], range_of(gene, cuts[:mid], low)).otherwise(range_of(gene, cuts[mid + 1 :], low + mid + 1))


def task_count(rows: int) -> int:
    """Tasks for a shuffle of ``rows``, so that what one sorts or groups does not grow with the table."""
    return max(1, -(-rows // TASK_ROWS))


#: The order of a task's rows in a layout by gene and by cell, so that Parquet statistics prune.
GENE_ORDER, CELL_ORDER = ("genes", "gene_id", "cell_id"), ("cell_id", "gene_id")


def by_gene(x: DataFrame, cuts: Sequence[int] = (), tasks: int | None = None) -> DataFrame:
    """The matrix dealt out for reads of one gene, with its range (``genes``): by gene and then by cell, so that a gene with a large share of
    all entries is in several tasks. A task's rows are yet to be sorted, by GENE_ORDER."""
    return x.withColumn("genes", range_of(F.col("gene_id"), list(cuts))).repartitionByRange(*[tasks] * bool(tasks), "gene_id", "cell_id")


def by_cell(x: DataFrame, tasks: int | None = None) -> DataFrame:
    """The matrix dealt out for reads of one cell; a task's rows are yet to be sorted, by CELL_ORDER."""
    return x.repartitionByRange(*[tasks] * bool(tasks), "cell_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_store(spark: SparkSession, sf_dir: str) -> Store:
    """Vectors as cells, their dimensions as genes, labels as cell types; the first two dimensions are an embedding."""
    e = table(spark, sf_dir, "embeddings")
    obs = e.select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("label"))
    width = e.select(F.max(F.size("embedding"))).first()[0] or 0
    var = spark.range(width).select(F.col("id").cast("int").alias("gene_id"), F.concat(F.lit("g"), "id").alias("var_name"))
    obsm = e.select(F.lit("X_2d").alias("key"), F.col("vec_id").alias("cell_id"), F.slice("embedding", 1, 2).alias("coords"))
    return Store(obs, var, coo_from_dense(e, "vec_id", "embedding"), obsm)


def sparse_store(spark: SparkSession, sf_dir: str) -> Store:
    """Orders as cells, parts as genes, ordered quantities as counts."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    obs = (
        o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation: 25 rows by definition
        .select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("o_totalprice").alias("total_price"))
    )
    var = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("var_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price")
    )
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    return Store(obs, var, x)
