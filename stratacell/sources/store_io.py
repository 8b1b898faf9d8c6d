"""Stores on disk: folders of Parquet tables beside a log of commits, each of which makes a generation.

Each part is written to a folder of its own. A commit is one file of one write
and names all folders of a build together; it comes last. So whatever is being
written, or whose write failed, is invisible as a whole, and what it would
replace stays readable. Folders that no live row names are left for readers that
still use them. One writer at a time: a build that finds another commit since it
began is an error.

A part's content is known by sums of its rows' hashes, taken while it is written.
Strata name the contents of the cells and the matrix that they were summed from,
so whether they fit a store is read from the log.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.lineage import shared
from ..operators.matrix import categories
from .store import CELL_ORDER, ENTRY_BYTES, FILE_BYTES, GENE_ORDER, MOST_RANGES, Store, by_cell, by_gene, gene_cuts, need_int32, range_of, task_count

PARTS = ("obs", "var", "x", "obsm", "obsp", "varp", "uns", "layers", "categories", "strata", "strata_cells", "sketches", "harvests", "verdicts", "counters", "waiting")
KEYED = ("obsm", "obsp", "varp", "layers", "strata", "strata_cells", "verdicts")
#: Parts that may have no rows.
MAYBE_EMPTY = ("x", "obsm", "layers", "strata", "strata_cells", "categories", "harvests", "verdicts", "counters", "waiting")
#: A row of the commit log: what a part is from this generation on. Without a path the part is gone.
COMMIT = "generation long, part string, key string, axes array<string>, path string, rows long, content string, source string, schema string, cuts array<long>"


COLUMNS = [c.split()[0] for c in COMMIT.split(", ")]


#: Ranges of strata, and of genes, that strata are laid out by at most; bytes of a row of sums, about; share of the strata beyond which all are read.
MOST_SIDES, SUMS_BYTES, MOST_SHARE = 16, 32, 0.5


class PartExists(ValueError):
    """The part is there already; ``overwrite`` replaces it."""


def new_root(spark: SparkSession) -> str:
    """A new folder name in the folder that ``spark.checkpoint.dir`` names."""
    shared(spark)
    sc = spark.sparkContext
    return f"{(sc.getConf().get('spark.checkpoint.dir') or sc.getCheckpointDir()).rstrip('/')}/store-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder; a folder that may not be looked at is an error, and not an empty store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def log(spark: SparkSession, root: str) -> list[Row]:
    """The live parts: the last row of each in the log of commits. A store has a few parts, a row each."""
    if not exists(spark, f"{root}/commits"):
        return []
    rows = spark.read.schema(COMMIT).parquet(f"{root}/commits")
    last = rows.groupBy("part", "key").agg(F.max_by(F.struct(*rows.columns), "generation").alias("last"))
    return sorted(last.select("last.*").where("path is not null").collect(), key=lambda r: (r["part"], r["key"]))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The live parts as a table."""
    return spark.createDataFrame(log(spark, root), COMMIT)


def _sums(df: DataFrame) -> list[Column]:
    """Sums that any order of the rows gives alike."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    # the sum in two halves, which long numbers hold for 2^31 rows
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.shiftright(h, 32)).alias("high"), F.sum(h.bitwiseAND(F.lit(2**32 - 1))).alias("low"), F.bit_xor(h).alias("xor")]


def _content(schema: StructType, sums: dict) -> str:
    kinds = hashlib.md5(json.dumps(sorted((f.name, f.dataType.simpleString()) for f in schema)).encode()).hexdigest()[:8]
    return f"{kinds}-{sums['rows']}-{((sums['high'] or 0) << 32) + (sums['low'] or 0)}-{sums['xor'] or 0}"


def content(df: DataFrame) -> str:
    """A fingerprint of the rows of ``df``, by a scan; that of a stored part is in the log."""
    return _content(df.schema, df.agg(*_sums(df)).first().asDict())


def staged_in(root: str, df: DataFrame) -> DataFrame:
    """``df`` as it is worked out once, in a folder of the store that no commit names."""
    path = f"{root}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Build:
    """Parts that are written together: ``with Build(spark, root) as b: b.put(..)``. They are live from the end on, all at
    once; after an error none is."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.live = {(r["part"], r["key"]): r for r in log(spark, root)}
        self.generation = self._last() + 1
        self.rows: list[tuple] = []

    def _last(self) -> int:
        if not exists(self.spark, f"{self.root}/commits"):
            return 0
        return self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits").agg(F.max("generation")).first()[0] or 0

    def put(self, part: str, df: DataFrame, key: str = "", overwrite: bool = False, axes: Sequence[str] | None = None, source: str | None = None, int32: bool = False, order: str = "gene", file_bytes: int = FILE_BYTES, staged: bool = False) -> str:
        """Writes a part and returns its content. ``int32``: its indices must fit 32 bits. ``order``: a matrix is laid out by ``gene``, in
        folders of ranges of genes, or by ``cell``; none of its files holds more entries than go into ``file_bytes``, about. ``staged``: it is
        cheap to read, as what :func:`staged_in` gives, and is not written out first."""
        if part not in PARTS:
            raise ValueError(f"cannot add {part}")
        if bool(key) != (part in KEYED):
            raise ValueError(f"{part} needs a key" if part in KEYED else f"{part} has no keys")
        if not overwrite and (part, key) in self.live:
            raise PartExists(f"{part}/{key}")
        if part == "obsm":
            df = df.withColumn("coords", F.transform("coords", lambda c: c.cast("float")))
        rows, cuts, order_of = df, None, ()
        if part in ("x", "layers"):
            df = df if staged else staged_in(self.root, df)  # it is gone through for bounds, for cuts, for a sample and to be written
            df = need_int32(df) if int32 else df
            cuts = gene_cuts(df, file_bytes) if order == "gene" else None
            tasks = task_count(df.count())
            rows, order_of = (by_cell(df, tasks), CELL_ORDER) if cuts is None else (by_gene(df, cuts, tasks), GENE_ORDER)
        return self._write(part, key, df, rows, axes, source, cuts, () if cuts is None else ("genes",), file_bytes if part in ("x", "layers") else None, order_of)

    def _write(self, part: str, key: str, df: DataFrame, rows: DataFrame, axes: Sequence[str] | None, source: str | None, cuts: list[int] | None, folders: tuple, file_bytes: int | None = None, order: tuple = ()) -> str:
        """Writes ``rows``, which are those of ``df`` with the columns of their folders and of their ``order`` in a task, which begins with the folders."""
        path, seen = "/".join([part, *[key] * bool(key), uuid.uuid4().hex]), Observation()
        rows = rows.observe(seen, *_sums(df))
        # sorted last: after an observation Spark takes rows for unsorted, and a write to folders sorts them once more
        if order:
            rows = rows.sortWithinPartitions(*order).select(*[f"`{c}`" for c in df.columns], *folders)
        writer = rows.write
        if file_bytes:
            writer = writer.option("maxRecordsPerFile", max(1, file_bytes // ENTRY_BYTES))
        (writer.partitionBy(*folders) if folders else writer).parquet(f"{self.root}/{path}")
        found = _content(df.schema, seen.get)
        if part not in MAYBE_EMPTY and not seen.get["rows"]:
            raise ValueError(f"{part} is empty")
        row = (self.generation, part, key, None if axes is None else list(axes), path, seen.get["rows"], found, source, df.schema.json(), cuts)
        self.rows = [r for r in self.rows if r[1:3] != (part, key)] + [row]
        return found

    def put_strata(self, key: str, axes: Sequence[str], sums: DataFrame, cells: DataFrame, genes: DataFrame, source: str, file_bytes: int = FILE_BYTES) -> None:
        """Writes the sums of strata (stratum, gene_id, ..) and their cells, the output of :func:`strata.numbered`, in folders for ranges of strata and
        of ``genes`` (gene_id), so that the read of a gene and that of a stratum both list a few of them. The strata are few (a build's preflight
        bounds them), and so are the ranges. ``sums`` are gone through twice. Rows are dealt out by pieces of these folders and by number, and get
        their labels where they are written."""
        n, rows = cells.count(), sums.count()
        sides = min(MOST_SIDES, max(1, ceil(sqrt(n * genes.count() * SUMS_BYTES / file_bytes))))
        tasks = task_count(rows)
        each = max(1, ceil(4 * tasks / sides**2))  # pieces of a folder
        cuts = gene_cuts(genes, ranges=sides)
        fine = cuts if each == 1 else sorted({*cuts, *gene_cuts(genes, ranges=min(sides * each, 10 * MOST_RANGES))})
        cells = cells.withColumn("strata_range", F.floor(F.col("stratum") * F.lit(sides) / F.lit(max(n, 1))).cast("int"))
        gene, labels = F.col("gene_id"), F.broadcast(cells.select("stratum", *axes))
        ranged = sums.withColumn("genes", range_of(gene, cuts)).withColumn("strata_range", F.floor(F.col("stratum") * F.lit(sides) / F.lit(max(n, 1))).cast("int"))
        dealt = ranged.repartition(tasks, "strata_range", range_of(gene, fine)).join(labels, "stratum")
        columns, folders = [*axes, *[c for c in sums.columns if c != "stratum"]], ("strata_range", "genes")
        self._write("strata", key, dealt.select(*columns), dealt, axes, source, cuts, folders, order=(*folders, "stratum", "gene_id"))
        cells = cells.drop("stratum")
        self._write("strata_cells", key, cells, cells, axes, source, None, ())

    def drop(self, part: str, key: str = "") -> None:
        """The part is gone from this generation on."""
        if (part, key) in self.live:
            self.rows.append((self.generation, part, key, *[None] * 7))

    def read(self, part: str, key: str = "") -> DataFrame:
        """A part as this build leaves it."""
        own = {r[1:3]: r for r in self.rows}
        if (part, key) in own:
            return _read(self.spark, self.root, dict(zip(COLUMNS, own[part, key], strict=True)))
        return _read(self.spark, self.root, self.live[part, key])

    def commit(self) -> None:
        if not self.rows:
            return
        if self._last() >= self.generation:
            raise RuntimeError(f"{self.root} has changed since this build began")
        self.spark.createDataFrame(self.rows, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def __enter__(self) -> Build:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()


def add_part(root: str, part: str, df: DataFrame, key: str = "", overwrite: bool = False, **how) -> None:
    """A build of one part; see :meth:`Build.put`."""
    with Build(df.sparkSession, root) as b:
        b.put(part, df, key, overwrite, **how)


def _read(spark: SparkSession, root: str, row: Row | dict, ranges: bool = False) -> DataFrame:
    """A part as its row of the log names it; with ``ranges`` a matrix by gene has the column of its folders (``genes``)."""
    schema = StructType.fromJson(json.loads(row["schema"]))
    if row["cuts"] is None:
        return spark.read.schema(schema).parquet(f"{root}/{row['path']}")
    folders = ["strata_range"] * (row["part"] == "strata") + ["genes"]
    whole = StructType(schema.fields + [StructField(f, IntegerType()) for f in folders])
    rows = spark.read.schema(whole).parquet(f"{root}/{row['path']}")
    return rows if ranges else rows.select(*schema.names)


def read_part(spark: SparkSession, root: str, part: str, key: str | None = "") -> DataFrame:
    """A live part; without a key (None) the rows of all keys."""
    found = [r for r in log(spark, root) if r["part"] == part and (key is None or r["key"] == key)]
    if not found:
        raise KeyError(f"no finished part {part}/{key}")
    if len(found) == 1:
        return _read(spark, root, found[0])
    return spark.read.schema(StructType.fromJson(json.loads(found[0]["schema"]))).parquet(*[f"{root}/{r['path']}" for r in found])


def source_of(parts: Sequence[Row]) -> str | None:
    """What strata of the live cells and matrix name as their source."""
    found = {r["part"]: r["content"] for r in parts if r["part"] in ("obs", "x")}
    return f"{found['obs']}/{found['x']}" if len(found) == 2 else None


def strata_tables(spark: SparkSession, root: str, fresh: bool = False) -> DataFrame:
    """(key, axes, source) of the strata; with ``fresh`` only of those that were summed from the live cells and matrix."""
    parts = log(spark, root)
    source = source_of(parts)
    rows = [(r["key"], r["axes"], r["source"]) for r in parts if r["part"] == "strata" and (not fresh or r["source"] == source)]
    return spark.createDataFrame(rows, "key string, axes array<string>, source string")


def has_strata(spark: SparkSession, root: str, key: str = "atomic") -> bool:
    return not strata_tables(spark, root).where(F.col("key") == key).isEmpty()


def strata_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row: whether the atomic table is there, how many coarse ones, and their keys."""
    t = strata_tables(spark, root)
    coarse = F.col("key") != "atomic"
    return t.agg(F.coalesce(F.bool_or(~coarse), F.lit(False)).alias("has_atomic"), F.count_if(coarse).alias("n_coarse"), F.sort_array(F.collect_list(F.when(coarse, F.col("key")))).alias("coarse"))


def read_strata(spark: SparkSession, root: str, key: str, genes: Sequence[int] | None = None, strata: DataFrame | None = None, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The sums and the cells of a table. ``genes`` keeps the sums of those genes, and of none the strata stay; ``strata``
    (some of the axes) keeps the strata that it names, missing labels included. ``mode``: ``rows`` reads the folders of these strata only,
    ``full`` all of them, ``auto`` the former unless they are more than MOST_SHARE of all strata."""
    if mode not in ("auto", "rows", "full"):
        raise ValueError(f"no mode {mode}")
    parts = {r["part"]: r for r in log(spark, root) if r["key"] == key}
    if "strata" not in parts:
        raise KeyError(f"no finished part strata/{key}")
    sums, cells, columns = _read(spark, root, parts["strata"], ranges=True), _read(spark, root, parts["strata_cells"]), StructType.fromJson(json.loads(parts["strata"]["schema"])).names
    if genes is not None:
        cuts = parts["strata"]["cuts"]
        sums = sums.where(F.col("gene_id").isin(list(genes)) & F.col("genes").isin(sorted({bisect_left(cuts, g) for g in genes}))) if genes else sums.where("false")
    if strata is not None:
        named = strata.distinct()
        some = lambda t: t.join(named, [t[c].eqNullSafe(named[c]) for c in strata.columns], "left_semi")
        cells = some(cells)
        found = cells.groupBy("strata_range").count().collect() if mode != "full" else []  # MOST_SIDES at most
        if mode == "rows" or mode == "auto" and sum(r["count"] for r in found) <= MOST_SHARE * (parts["strata_cells"]["rows"] or 0):
            sums = sums.where(F.col("strata_range").isin([r["strata_range"] for r in found])) if found else sums.where("false")
        sums = some(sums)
    return sums.select(*columns), cells.drop("strata_range")


def strata_keys(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The strata of a table and their cells; the sums are not read."""
    return read_part(spark, root, "strata_cells", key).drop("strata_range")


def declared(obs: DataFrame) -> DataFrame:
    """(column, code, label): every text column of the cells is categorical, its labels in order."""
    text = [c for c, t in obs.dtypes if t == "string"]
    if not text:
        return obs.sparkSession.createDataFrame([], "column string, code int, label string")
    return categories(obs, text)


def write_store(root: str, store: Store, overwrite: bool = False, hook: Callable[[str, str], None] = lambda event, part: None, **how) -> None:
    """Write all parts, live all at once. ``hook`` hears (event, part): ``done`` after each part, ``error`` before what went wrong is
    raised, ``complete``. ``how`` is for the matrix and the layers; see :meth:`Build.put`."""
    labels = store.categories if store.categories is not None else declared(store.obs)
    parts = [("obs", "", store.obs), ("var", "", store.var), ("x", "", store.x), ("categories", "", labels)]
    parts += [(part, name, table) for part in ("layers", "obsp", "varp") for name, table in getattr(store, part).items()]
    if store.uns is not None:
        parts.append(("uns", "", store.uns))
    if store.obsm is not None:  # a handful of embedding names
        parts += [("obsm", key, store.embedding(key)) for (key,) in store.obsm.select("key").distinct().collect()]
    with Build(store.obs.sparkSession, root) as b:
        for part, key, df in parts:
            name = f"{part}/{key}" if key else part
            try:
                b.put(part, df, key, overwrite, **(how if part in ("x", "layers") else {}))
            except Exception:
                hook("error", name)
                raise
            hook("done", name)
    hook("complete", "")


def open_store(spark: SparkSession, root: str) -> Store:
    """The live parts of a store, by one read of its log; they stay those of this generation whatever is written later."""
    parts = {(r["part"], r["key"]): r for r in log(spark, root)}
    missing = [p for p in ("obs", "var", "x") if (p, "") not in parts]
    if missing:
        raise ValueError(f"not a finished store: {missing}")
    read = lambda part, key="": _read(spark, root, parts[part, key])
    obsm = None
    for _, key in sorted(k for k in parts if k[0] == "obsm"):
        one = read("obsm", key).select(F.lit(key).alias("key"), "cell_id", "coords")
        obsm = one if obsm is None else obsm.unionByName(one)
    named = {part: {key: read(part, key) for p, key in sorted(parts) if p == part} for part in ("layers", "obsp", "varp")}
    single = {part: read(part) for part in ("uns", "categories") if (part, "") in parts}
    store = Store(*(read(p) for p in ("obs", "var", "x")), obsm, **named, **single, root=root, parts=tuple(parts.values()))
    if parts["x", ""]["cuts"] is not None:
        rows = _read(spark, root, parts["x", ""], ranges=True)
        store = store.ranged(rows.drop("genes"), rows, parts["x", ""]["cuts"])
    return store.sealed(source_of(store.parts))


def fresh_strata(spark: SparkSession, root: str, store: Store) -> list[Row]:
    """The rows of the log for strata that were summed from the cells and the matrix that ``store`` has. A store that was opened
    from ``root`` is asked for the log of then; one that was not read from a disk has no known content, and so no strata."""
    if store.content is None:
        return []
    parts = store.parts if store.root == root else log(spark, root)
    return [r for r in parts if r["part"] == "strata" and r["source"] == store.content]


def stratum_tables(spark: SparkSession, root: str, store: Store, key: str) -> tuple[DataFrame, DataFrame]:
    """The sums and the cells of a table of :func:`fresh_strata`."""
    parts = {r["part"]: r for r in (store.parts if store.root == root else log(spark, root)) if r["key"] == key}
    return _read(spark, root, parts["strata"]), _read(spark, root, parts["strata_cells"]).drop("strata_range")


def layout(spark: SparkSession, root: str, value_bytes: int = 4) -> DataFrame:
    """Files and bytes of each finished part, and for the matrix the ratio of a dense array's bytes to those on disk."""
    parts = log(spark, root)
    live = spark.createDataFrame(parts, COMMIT)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path", "length")
    folder = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), r"(/(strata_range|genes)=[^/]*)*/[^/]*$", "")
    files = files.select(folder.alias("path"), "length").join(live.select("part", "path"), "path")
    out = files.groupBy("part").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.avg("length").alias("mean_bytes"))
    rows = {r["part"]: r["rows"] for r in parts}
    if not {"obs", "var"} <= set(rows):
        return out.withColumn("ratio", F.lit(None).cast("double"))
    dense = rows["obs"] * rows["var"] * value_bytes
    return out.withColumn("ratio", F.when(F.col("part") == "x", F.lit(float(dense)) / F.col("bytes")))


def actual_layout(spark: SparkSession, root: str) -> DataFrame:
    """(part, key, columns, rows) of each live part, as the log has them from its write; ``columns`` is JSON of names and types."""
    types = lambda r: json.dumps({f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(r["schema"]))})
    return spark.createDataFrame([(r["part"], r["key"], types(r), r["rows"]) for r in log(spark, root)], "part string, key string, columns string, rows long")
