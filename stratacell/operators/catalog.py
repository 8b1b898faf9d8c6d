"""The catalogue of datasets: listings, access, facets, harvests, and checks between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.scalars import visible
from ..sources.store_io import Build, read_part


def listing(datasets: DataFrame, sources: DataFrame, collections: DataFrame, metadata: DataFrame, roles: Sequence[str] | None = None, slug: str | None = None) -> DataFrame:
    """Datasets with source, collection and metadata, those that the roles may see, oldest first."""
    r = F.array(*[F.lit(x) for x in roles or ()]).cast("array<string>")
    rows = datasets.where(visible(F.col("is_public"), F.col("required_roles"), r))
    if slug is not None:
        rows = rows.where(F.col("slug") == slug)
    return rows.join(sources, "datasource_id").join(collections, "collection_id", "left").join(metadata, "dataset_id", "left").orderBy("created_at", "dataset_id")


def collection_counts(datasets: DataFrame, collections: DataFrame, roles: Sequence[str] = ()) -> DataFrame:
    """Collections with the number of datasets that the roles may see; those without any are left out."""
    r = F.array(*[F.lit(x) for x in roles]).cast("array<string>")
    n = datasets.where(visible(F.col("is_public"), F.col("required_roles"), r)).groupBy("collection_id").agg(F.count("*").alias("n_datasets"))
    return collections.join(n, "collection_id").orderBy("collection_name")


def collection_detail(datasets: DataFrame, collections: DataFrame, name: str, roles: Sequence[str] = ()) -> DataFrame:
    """The datasets of one collection that the roles may see, oldest first, a row each; none if it is unknown."""
    r = F.array(*[F.lit(x) for x in roles]).cast("array<string>")
    own = datasets.where(visible(F.col("is_public"), F.col("required_roles"), r))
    return own.join(collections.where(F.col("collection_name") == name), "collection_id").orderBy("created_at", "dataset_id")


def resolve_facets(columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """``columns`` (column, ..) with the canonical key of each name; exact, case counts. ``aliases`` (key, names)."""
    return columns.join(aliases.select("key", F.explode("names").alias("column")), "column", "left")


def unmapped_columns(columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """Columns without a key, by the number of datasets that have them."""
    known = aliases.select(F.explode("names").alias("column"))
    return columns.join(known, "column", "left_anti").groupBy("column").agg(F.count_distinct("dataset_id").alias("n_datasets")).orderBy(F.desc("n_datasets"), "column")


def merge_harvests(attempts: DataFrame) -> DataFrame:
    """The state of each dataset after its attempts (dataset_id, at, status, value, error): values of the last success
    after the last clearing, bookkeeping of the last attempt; a success clears the error."""
    cleared = F.max(F.when(F.col("status") == "clear", F.col("at"))).over(Window.partitionBy("dataset_id"))
    ok = (F.col("status") == "ok") & (F.col("cleared").isNull() | (F.col("at") > F.col("cleared")))
    return attempts.withColumn("cleared", cleared).groupBy("dataset_id").agg(
        F.max_by(F.when(ok, F.col("value")), F.when(ok, F.col("at"))).alias("value"), F.max(F.when(ok, F.col("at"))).alias("fetched_at"),
        F.max("at").alias("attempted_at"), F.max_by("status", "at").alias("status"), F.max_by(F.when(F.col("status") != "ok", F.col("error")), F.col("at")).alias("error"),
    )


#: What a harvest must have found before it is served.
VALUES = ("n_obs", "n_vars", "obs_columns", "obs_facets")


def served(state: DataFrame, values: Sequence[str] = VALUES) -> DataFrame:
    """The rows of ``state`` (dataset_id, ``values``) with all values: half a harvest is not served."""
    return state.where(F.forall(F.array(*[F.col(v).isNotNull() for v in values]), lambda x: x))


def described_columns(state: DataFrame) -> DataFrame:
    """(dataset_id, column, dtype, cardinality): from the facets (column -> dtype, cardinality), or the bare names as text where there are none."""
    bare = F.transform("obs_columns", lambda c: F.struct(c.alias("column"), F.lit("string").alias("dtype"), F.lit(None).cast("long").alias("cardinality")))
    full = F.transform(F.map_entries("obs_facets"), lambda e: F.struct(e["key"].alias("column"), e["value"]["dtype"].alias("dtype"), e["value"]["cardinality"].cast("long").alias("cardinality")))
    return served(state).select("dataset_id", F.inline(F.when(F.size("obs_facets") == 0, bare).otherwise(full)))


def log_harvests(attempts: DataFrame, path: str, checkpoint: str):
    """A stream of attempts appended to a log; :func:`merge_harvests` of the log is the state, whichever batch a row came with."""
    return attempts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def harvest_state(state: DataFrame | None, attempts: DataFrame) -> DataFrame:
    """(dataset_id, ok_at, ok_value, cleared_at, attempted_at, status, error): what has to be kept of all attempts so far. Each is the
    last of its kind, so attempts may come in any order and more than once."""
    last = F.max(F.struct("at", "status", "error")).alias("last")
    new = attempts.groupBy("dataset_id").agg(F.max(F.when(F.col("status") == "ok", F.struct("at", "value"))).alias("ok"), F.max(F.when(F.col("status") == "clear", F.col("at"))).alias("cleared_at"), last)
    if state is not None:
        old = state.select("dataset_id", F.when(F.col("ok_at").isNotNull(), F.struct(F.col("ok_at").alias("at"), F.col("ok_value").alias("value"))).alias("ok"), "cleared_at", F.struct(F.col("attempted_at").alias("at"), "status", "error").alias("last"))
        new = new.unionByName(old).groupBy("dataset_id").agg(F.max("ok").alias("ok"), F.max("cleared_at").alias("cleared_at"), F.max("last").alias("last"))
    return new.select("dataset_id", F.col("ok.at").alias("ok_at"), F.col("ok.value").alias("ok_value"), "cleared_at", F.col("last.at").alias("attempted_at"), "last.status", "last.error")


def harvested(state: DataFrame) -> DataFrame:
    """The rows of :func:`merge_harvests` from the kept state."""
    there = F.col("ok_at").isNotNull() & (F.col("cleared_at").isNull() | (F.col("ok_at") > F.col("cleared_at")))
    return state.select(
        "dataset_id", F.when(there, F.col("ok_value")).alias("value"), F.when(there, F.col("ok_at")).alias("fetched_at"), "attempted_at", "status", F.when(F.col("status") != "ok", F.col("error")).alias("error")
    )


def harvest_stream(attempts: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """A stream of attempts that is merged into the state in ``root``, batch by batch. Each batch publishes a generation that names the
    batch, so one that is run again changes nothing, and readers see the state before or after it. :func:`harvests` reads it."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        with Build(batch.sparkSession, root) as b:
            there = b.live.get(("harvests", ""))
            if there is None or int(there["source"]) < batch_id:
                b.put("harvests", harvest_state(b.read("harvests") if there else None, batch), overwrite=True, source=str(batch_id))

    return attempts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def harvests(spark, root: str) -> DataFrame:
    return harvested(read_part(spark, root, "harvests"))


def stale(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return rows.where(F.col("fetched_at").isNull() | (F.col("fetched_at") <= now - F.make_interval(hours=F.lit(hours))))


def orphans(tables: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(reference, orphans): for each ``name: (child, key, parent, key)`` the non-null keys without a parent."""
    out = None
    for name, (child, ck, parent, pk) in tables.items():
        c = child.where(F.col(ck).isNotNull()).select(F.col(ck).alias("k"))
        n = c.join(parent.select(F.col(pk).alias("k")), "k", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("reference"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        n = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeats counted, as (side, rows)."""
    only = lambda x, y, side: x.exceptAll(y).agg(F.count("*").alias("rows")).select(F.lit(side).alias("side"), "rows")
    return only(a, b, "left").unionByName(only(b, a, "right"))


def copy_table(table: DataFrame, path: str) -> DataFrame:
    """A verified copy: written, read back, and equal."""
    table.write.mode("errorifexists").parquet(path)
    back = table.sparkSession.read.parquet(path)
    if difference(table, back).where("rows > 0").count():
        raise ValueError("the copy differs")
    return back


def copy_tables(tables: dict[str, DataFrame], references: dict[str, tuple[str, str, str, str]], root: str, revision: str, expected: str) -> DataFrame:
    """Verified copies of all tables, and their (table, rows). Nothing is written unless the ``revision`` of the tables is
    the ``expected`` one and no reference ``name: (child, key, parent, key)`` lacks its parent; a target that is there is an error."""
    if revision != expected:
        raise ValueError(f"the tables are at {revision}, not {expected}")
    lost = orphans({name: (tables[c], ck, tables[p], pk) for name, (c, ck, p, pk) in references.items()}).where("orphans > 0").collect() if references else []
    if lost:
        raise ValueError(f"rows without a parent: {[tuple(r) for r in lost]}")
    return row_counts({name: copy_table(t, f"{root}/{name}") for name, t in tables.items()})


def top_overlap(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Shared genes of two rankings (gene_id, ..) of ``n`` genes."""
    both = a.select("gene_id").intersect(b.select("gene_id"))
    return both.agg(F.count("*").alias("shared")).select("shared", (F.col("shared") / n).alias("share"))
