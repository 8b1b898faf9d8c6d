"""Which table answers a question: the smallest strata that cover its axes, or else a scan of the matrix; and the named operators."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..operators import annotations, catalog, chat, matrix, neighbours, stats, strata
from ..sources.store import Store, task_count
from ..sources import store_io
from ..streaming import usage

OPERATORS: dict[str, Callable] = {}


def register(name: str) -> Callable:
    """Adds an operator under a name; a name is taken once."""

    def put(f: Callable) -> Callable:
        if name in OPERATORS:
            raise ValueError(f"{name} is taken")
        OPERATORS[name] = f
        return f

    return put


# what gives a table, or tables, is an operator; helpers and expressions are not
for _module in (stats, annotations, matrix, neighbours, strata, catalog, chat, usage):
    for _name, _f in sorted(vars(_module).items()):
        if inspect.isfunction(_f) and _f.__module__ == _module.__name__ and not _name.startswith("_") and "DataFrame" in str(_f.__annotations__.get("return")):
            register(_name)(_f)

#: JSON types of the arguments that a caller writes down; tables and stores are objects that the caller has.
JSON_TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "Sequence": "array", "list": "array", "tuple": "array", "dict": "object"}


def arguments(name: str) -> dict:
    """The JSON schema of an operator's arguments."""
    properties, required = {}, []
    for p in inspect.signature(OPERATORS[name]).parameters.values():
        kinds = [JSON_TYPES.get(k.strip().split("[")[0], "null" if k.strip() == "None" else "object") for k in str(p.annotation).split("|")]
        properties[p.name] = {"type": kinds[0] if len(kinds) == 1 else kinds}
        if p.default is inspect.Parameter.empty:
            required.append(p.name)
        elif isinstance(p.default, (str, int, float, bool)):
            properties[p.name]["default"] = p.default
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


def call(name: str, **given):
    """Runs an operator by name; arguments that it lacks or does not know are an error that names them."""
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}")
    schema = arguments(name)
    wrong = [k for k in given if k not in schema["properties"]] + [k for k in schema["required"] if k not in given]
    if wrong:
        raise ValueError(f"{name}: arguments missing or unknown: {wrong}")
    python = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": (list, tuple), "object": object, "null": type(None)}
    for k, v in given.items():
        kinds = schema["properties"][k]["type"]
        if not isinstance(v, tuple(t for kind in ([kinds] if isinstance(kinds, str) else kinds) for t in (python[kind] if isinstance(python[kind], tuple) else (python[kind],)))):
            raise ValueError(f"{name}: {k} is {type(v).__name__}, not {kinds}")
    return OPERATORS[name](**given)


def covering(tables: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The table of ``tables`` (key, axes) with all of ``axes`` and the fewest others; ties by key."""
    need = F.array(*[F.lit(a) for a in axes]).cast("array<string>")
    return tables.where(F.size(F.array_except(need, "axes")) == 0).orderBy(F.size("axes"), "key").limit(1)


def exact(tables: DataFrame, axes: Sequence[str]) -> DataFrame:
    """The table with just these axes, in any order."""
    return covering(tables, axes).where(F.size("axes") == len(set(axes)))


def build_strata(spark: SparkSession, root: str, store: Store, atomic: Sequence[str], coarse: Sequence[Sequence[str]] = (), force: bool = False, add_only: bool = False, file_bytes: int = store_io.FILE_BYTES) -> None:
    """Write the atomic table and the coarse ones, live all at once, and marked with the content of the cells and the matrix that they
    are summed from. ``force`` rebuilds: coarse tables that it does not name are gone. ``add_only`` derives coarse tables from the
    atomic table that is there, which must be of ``store``."""
    source = store.content or f"{store_io.content(store.obs)}/{store_io.content(store.x)}"
    with store_io.Build(spark, root) as b:
        there = {key: r for (part, key), r in b.live.items() if part == "strata"}
        if add_only:
            if "atomic" not in there:
                raise ValueError("there is no atomic table to derive from")
            if there["atomic"]["source"] != source:
                raise ValueError("the atomic table is of other cells or another matrix; force rebuilds it")
            atomic = there["atomic"]["axes"]
        elif "atomic" in there and not force:
            raise ValueError("the atomic table exists; force rebuilds it")
        unknown = [a for c in coarse for a in c if a not in atomic]
        if unknown:
            raise ValueError(f"axes that the atomic table lacks: {unknown}")
        if not add_only:
            if strata.surely_too_many(store, atomic) or strata.preflight(store, atomic).where("not ok").count():
                raise ValueError("preflight failed")
            for key in there:
                b.drop("strata", key)
                b.drop("strata_cells", key)
            b.rows = [r for r in b.rows if r[2] != "atomic"]
            cells = checkpointed(strata.numbered(strata.strata_cells(store, atomic), atomic))
            known = {r["part"]: r["rows"] for r in store.parts if store.content}
            tasks = max(task_count(known[part] if part in known else table.count()) for part, table in (("x", store.x), ("obs", store.obs)))
            base = store_io.staged_in(root, strata.numbered_sums(store, atomic, cells, tasks))
            b.put_strata("atomic", atomic, base, cells, store.var, source, file_bytes)
        else:
            cells = checkpointed(strata.numbered(b.read("strata_cells", "atomic").drop("strata_range"), atomic))
            base = strata.numbers_of(b.read("strata", "atomic"), cells, atomic)
        for axes in coarse:
            key = "-".join(axes) or "all"
            few = checkpointed(strata.numbered(cells.groupBy(*axes).agg(F.sum("n_cells").alias("n_cells")), axes))
            # the coarse stratum of each atomic one
            into = strata.numbers_of(cells.select(F.col("stratum").alias("atomic"), *axes), few, axes)
            sums = base.withColumnRenamed("stratum", "atomic").join(F.broadcast(into), "atomic").drop("atomic")
            b.put_strata(key, axes, store_io.staged_in(root, strata.derive_coarse(sums, ["stratum"])), few, store.var, source, file_bytes)


def group_sums(spark: SparkSession, root: str | None, store: Store, axis: str) -> tuple[DataFrame, DataFrame, str]:
    """The sums of each group of ``axis``, from the smallest strata that cover it and were summed from what ``store`` has, or from a
    scan; and which it was. Of strata, the cells of each group are few, and come as rows that the driver has."""
    fit = [r for r in (store_io.fresh_strata(spark, root, store) if root else []) if axis in r["axes"]]
    if not fit:
        return *stats.group_sums(store, axis), "scan"
    key = min(fit, key=lambda r: (len(r["axes"]), r["key"]))["key"]
    sums, cells = strata.as_groups(*store_io.stratum_tables(spark, root, store, key), axis)
    return sums, spark.createDataFrame(cells.limit(strata.MOST_TUPLES).collect(), cells.schema), key  # strata have MOST_TUPLES at most


def compare_groups(spark: SparkSession, root: str | None, store: Store, axis: str, a: str, b: str, n: int = 10) -> DataFrame:
    """:func:`stats.compare_groups` from strata where they are fresh and know both groups, else by a scan."""
    return stats.compare_groups(*_knowing(spark, root, store, axis, (a, b)), store.var, a, b, n)


def find_markers(spark: SparkSession, root: str | None, store: Store, axis: str, group: str, n: int = 10) -> DataFrame:
    return stats.find_markers(*_knowing(spark, root, store, axis, (group,)), store.var, group, n)


def markers_of_all_groups(spark: SparkSession, root: str | None, store: Store, axis: str, n: int = 5) -> DataFrame:
    return stats.markers_of_all_groups(*group_sums(spark, root, store, axis)[:2], store.var, n)


def top_expressed(spark: SparkSession, root: str | None, store: Store, axis: str, group: str, n: int = 10) -> DataFrame:
    return stats.top_of_sums(*_knowing(spark, root, store, axis, (group,)), store.var, group, n)


def gene_panel(spark: SparkSession, root: str | None, store: Store, axis: str, genes: Sequence[int]) -> DataFrame:
    return stats.panel_of_sums(*group_sums(spark, root, store, axis)[:2], store.var, genes, store.labels(axis))


def _knowing(spark: SparkSession, root: str | None, store: Store, axis: str, groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The sums of :func:`group_sums`; of a scan if the strata lack one of the groups."""
    sums, cells, route = group_sums(spark, root, store, axis)
    if route != "scan" and cells.where(F.col("group").isin(list(groups))).count() < len(set(groups)):
        return stats.group_sums(store, axis)
    return sums, cells
