import datetime
import json
import math
import os
import random
import re
import statistics
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacell import Store, queries
from stratacell.functions import scalars
from stratacell.functions.quantiles import exact_quantiles
from stratacell.functions.scalars import as_label
from stratacell.operators import annotations, catalog, chat, matrix, neighbours, stats, strata
from stratacell.plans import router
from stratacell.sources import store as st
from stratacell.sources import store_io
from stratacell.streaming import usage


KINDS, SUBJECTS = ["gut", "lung", "gut", "skin", "lung", "gut", "lung"], ["p", "p", "q", "q", "q", "p", "q"]
#: Seven cells and four genes: a rule with some zeros; no cell has the last gene but the fourth one.
GRID = [[float((3 * i + 2 * j * j + i * j) % 5) if j < 3 else float(i == 3) for j in range(4)] for i in range(7)]


@pytest.fixture(scope="module")
def tiny(spark):
    obs = spark.createDataFrame(list(zip(range(7), KINDS, SUBJECTS, strict=True)), "cell_id long, kind string, subject string")
    var = spark.createDataFrame([(j, f"name{j}") for j in range(4)], "gene_id int, var_name string")
    rows = spark.createDataFrame(list(enumerate(GRID)), "cell_id long, v array<float>")
    return Store(obs, var, st.coo_from_dense(rows, "cell_id", "v"))


def _of(kind: str, gene: int) -> list[float]:
    return [row[gene] for row, k in zip(GRID, KINDS, strict=True) if k == kind]


def test_atomic_and_coarse(tiny):
    atomic = strata.build_atomic(tiny, ["kind", "subject"])
    assert strata.strata_cells(tiny, ["kind", "subject"]).count() == len(set(zip(KINDS, SUBJECTS, strict=True)))
    got = {(r["kind"], r["gene_id"]): (r["sum_x"], r["sum_xx"], r["nnz"]) for r in strata.derive_coarse(atomic, ["kind"]).collect()}
    want = {(k, j): (sum(x), sum(v * v for v in x), sum(v > 0 for v in x)) for k in set(KINDS) for j in range(4) if any(x := _of(k, j))}
    assert got == want
    rows = strata.in_order(strata.derive_coarse(atomic, ["subject", "kind"]), ["subject", "kind"]).select("subject", "kind", "gene_id").collect()
    assert rows == sorted(rows) and len(rows) > 8


def test_statistics_from_sums(spark):
    pairs = [([2.0, 7.0, 3.0, 9.0], [1.0, 0.0, 4.0]), ([6.0, 6.0], [6.0, 6.0, 6.0]), ([0.5, 1.5, 0.0], [8.0, 2.5])]
    rows = [tuple(x for g in p for x in (sum(g), sum(v * v for v in g), len(g))) for p in pairs]
    s = spark.createDataFrame(rows, "sum_x_a double, sum_xx_a double, n_a long, sum_x_b double, sum_xx_b double, n_b long")
    for (a, b), r in zip(pairs, stats.two_sample(s).collect(), strict=True):
        va, vb, diff = statistics.variance(a), statistics.variance(b), statistics.mean(a) - statistics.mean(b)
        if va + vb == 0:
            assert (r["cohens_d"], r["t"]) == (None, None)
        else:
            assert r["cohens_d"] == pytest.approx(diff / math.sqrt(((len(a) - 1) * va + (len(b) - 1) * vb) / (len(a) + len(b) - 2)))
            assert r["t"] == pytest.approx(diff / math.sqrt(va / len(a) + vb / len(b)))


def test_markers_of_all_groups_equal_those_of_each(spark, tiny):
    """In a store that leaves zeros out, a gene that a group does not express is a marker like any other."""
    sums, cells = stats.group_sums(tiny, "kind")
    every = stats.markers_of_all_groups(sums, cells, tiny.var, 4).collect()
    for kind in ("gut", "lung"):
        one = stats.find_markers(sums, cells, tiny.var, kind, 4).collect()
        got = sorted((r for r in every if r["group"] == kind), key=lambda r: r["rank"])
        assert [r["gene_id"] for r in got] == [r["gene_id"] for r in one] and len(got) == 4
        assert [r["cohens_d"] for r in got] == pytest.approx([r["cohens_d"] for r in one])
    assert not [r for r in every if r["group"] == "skin"]  # one cell is no group


def test_routes_agree(spark, tiny, tmp_path):
    root = str(tmp_path / "store")
    store_io.write_store(root, tiny)
    with pytest.raises(store_io.PartExists):
        store_io.add_part(root, "obs", tiny.obs)
    back = store_io.open_store(spark, root)
    router.build_strata(spark, root, back, ["kind", "subject"], [["kind"]])
    with pytest.raises(ValueError):
        router.build_strata(spark, root, back, ["kind"])
    answers = []
    for axis, where, of in (("kind", root, back), ("subject", root, back), ("subject", root, tiny), ("subject", None, back)):
        s, c, route = router.group_sums(spark, where, store_io.open_store(spark, root) if of is back else of, axis)
        answers.append((route, sorted(map(tuple, s.select("group", "gene_id", "sum_x", "sum_xx", "nnz").collect())), sorted(map(tuple, c.collect()))))
    assert [a[0] for a in answers] == ["kind", "atomic", "scan", "scan"]
    assert answers[1][1:] == answers[2][1:] == answers[3][1:]
    router.build_strata(spark, root, back, [], [["subject"]], add_only=True)
    assert router.group_sums(spark, root, back, "subject")[2] == "scan"  # the log of when it was opened has no strata
    back = store_io.open_store(spark, root)
    assert router.group_sums(spark, root, back, "subject")[2] == "subject"
    assert back.content and replace(back, x=back.x.where("gene_id > 0")).content is None
    for where in (root, None):
        assert router.top_expressed(spark, where, back, "kind", "gut", 4).collect() == stats.top_expressed(tiny, "kind", "gut", 4).collect()
        assert router.find_markers(spark, where, back, "kind", "lung", 4).collect() == stats.find_markers(*stats.group_sums(tiny, "kind"), tiny.var, "lung", 4).collect()
        assert router.compare_groups(spark, where, back, "kind", "gut", "lung", 4).collect() == stats.compare_groups(*stats.group_sums(tiny, "kind"), tiny.var, "gut", "lung", 4).collect()
    tables = store_io.strata_tables(spark, root)
    assert router.exact(tables, ["subject", "kind"]).first()["key"] == "atomic" and router.exact(tables, ["kind"]).first()["key"] == "kind"
    assert router.exact(tables.where("key <> 'kind'"), ["kind"]).count() == 0 and router.covering(tables.where("key <> 'kind'"), ["kind"]).first()["key"] == "atomic"
    assert store_io.has_strata(spark, root) and not store_io.has_strata(spark, root, "none")
    assert tuple(store_io.strata_summary(spark, root).first()) == (True, 2, ["kind", "subject"])
    sums, cells = store_io.read_strata(spark, root, "atomic", genes=[])
    assert sums.count() == 0 and cells.count() == strata.strata_cells(tiny, ["kind", "subject"]).count()
    sums, cells = store_io.read_strata(spark, root, "atomic", [0, 2], spark.createDataFrame([("gut",)], "kind string"))
    assert {r["gene_id"] for r in sums.collect()} <= {0, 2} and {r["kind"] for r in cells.collect()} == {"gut"}


def test_a_failed_overwrite_leaves_what_was_there(spark, tiny, tmp_path):
    root = str(tmp_path / "store")
    store_io.write_store(root, tiny)
    router.build_strata(spark, root, tiny, ["kind"])
    before = sorted(map(tuple, store_io.read_part(spark, root, "obs").collect()))
    sums = store_io.read_strata(spark, root, "atomic")[0].count()
    broken = tiny.obs.withColumn("kind", F.raise_error(F.lit("no luck")).cast("string"))
    with pytest.raises(Exception, match="no luck"):
        store_io.add_part(root, "obs", broken, overwrite=True)
    assert sorted(map(tuple, store_io.read_part(spark, root, "obs").collect())) == before
    bad = Store(tiny.obs, tiny.var, tiny.x.withColumn("value", F.raise_error(F.lit("no luck")).cast("double")))
    with pytest.raises(Exception, match="no luck"):
        router.build_strata(spark, root, bad, ["kind"], force=True)
    assert store_io.read_strata(spark, root, "atomic")[0].count() == sums
    # a reader that opened the store before an overwrite keeps reading what it opened
    old = store_io.open_store(spark, root)
    store_io.add_part(root, "obs", tiny.obs.limit(2), overwrite=True)
    assert old.obs.count() == 7 and store_io.open_store(spark, root).obs.count() == 2


def _same_as_scan(spark, root, scan=None):
    """All routed answers of the store as it is now equal those of a scan; the routes."""
    back = store_io.open_store(spark, root)
    plain = scan or Store(back.obs, back.var, back.x)
    routes = []
    for axis, group, other in (("kind", "gut", "lung"), ("subject", "p", "q")):
        rows = lambda d: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()]
        for routed in (lambda r, s: router.top_expressed(spark, r, s, axis, group, 4), lambda r, s: router.find_markers(spark, r, s, axis, group, 4), lambda r, s: router.compare_groups(spark, r, s, axis, group, other, 4)):  # noqa: B023
            assert rows(routed(root, back)) == rows(routed(None, plain))
        assert sorted(rows(router.gene_panel(spark, root, back, axis, [0, 1, 2]))) == sorted(rows(router.gene_panel(spark, None, plain, axis, [0, 1, 2])))
        routes.append(router.group_sums(spark, root, back, axis)[2])
    return routes


def test_strata_follow_the_store(spark, tiny, tmp_path):
    """After each overwrite and rebuild, every route equals the scan, and strata serve again once they are rebuilt or the content is back."""
    root = str(tmp_path / "store")
    store_io.write_store(root, tiny)
    build = lambda *a, **b: router.build_strata(spark, root, store_io.open_store(spark, root), *a, **b)
    build(["kind", "subject"], [["kind"]])
    assert _same_as_scan(spark, root) == ["kind", "atomic"]
    store_io.add_part(root, "x", tiny.x.withColumn("value", F.col("value") + F.col("gene_id")), overwrite=True)
    assert _same_as_scan(spark, root) == ["scan", "scan"] and store_io.strata_tables(spark, root, fresh=True).count() == 0
    with pytest.raises(ValueError, match="force"):
        build([], [["subject"]], add_only=True)
    build(["kind", "subject"], force=True)  # the coarse table that it does not name is gone
    assert _same_as_scan(spark, root) == ["atomic", "atomic"] and store_io.strata_summary(spark, root).first()["n_coarse"] == 0
    store_io.add_part(root, "obs", tiny.obs.withColumn("kind", F.when(F.col("cell_id") < 2, "lung").otherwise(F.col("kind"))), overwrite=True)
    assert _same_as_scan(spark, root) == ["scan", "scan"]
    store_io.add_part(root, "obs", tiny.obs.repartition(3), overwrite=True)  # the old rows, in another order
    assert _same_as_scan(spark, root) == ["atomic", "atomic"]
    store_io.add_part(root, "obs", tiny.obs.withColumn("more", F.lit(1)), overwrite=True)
    assert _same_as_scan(spark, root) == ["scan", "scan"]


def test_a_crash_between_any_two_writes_shows_the_old_build(spark, tiny, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store_io.write_store(root, tiny)
    router.build_strata(spark, root, store_io.open_store(spark, root), ["kind", "subject"], [["kind"]])
    before = [tuple(r) for r in store_io.log(spark, root)]
    put, doubled = store_io.Build._write, replace(tiny, x=tiny.x.withColumn("value", F.col("value") * 2))
    for crash in (1, 4):
        calls = []

        def failing(self, *a, **b):
            calls.append(a)  # noqa: B023
            if len(calls) == crash:  # noqa: B023
                raise OSError("gone")
            return put(self, *a, **b)

        monkeypatch.setattr(store_io.Build, "_write", failing)
        for work in (lambda: store_io.write_store(root, doubled, overwrite=True), lambda: router.build_strata(spark, root, doubled, ["kind"], [["kind"], []], force=True)):
            calls.clear()
            if crash <= (4 if work.__code__.co_names[0] == "store_io" else 6):
                with pytest.raises(OSError, match="gone"):
                    work()
                assert [tuple(r) for r in store_io.log(spark, root)] == before
    monkeypatch.undo()
    assert _same_as_scan(spark, root, tiny) == ["kind", "atomic"]
    late = store_io.Build(spark, root)
    store_io.add_part(root, "obs", tiny.obs, overwrite=True)
    late.put("var", tiny.var, overwrite=True)
    with pytest.raises(RuntimeError, match="changed"):
        late.commit()


def test_least_value_is_of_labelled_cells(spark):
    obs = spark.createDataFrame([(0, "a"), (1, "a"), (2, None)], "cell_id long, t string")
    var = spark.createDataFrame([(0, "g")], "gene_id int, var_name string")
    x = spark.createDataFrame([(0, 0, 2.0), (1, 0, 3.0), (2, 0, -5.0)], "cell_id long, gene_id int, value double")
    got = {r["group"]: r["fraction"] for r in stats.gene_panel(Store(obs, var, x), "t", [0], "above_min").collect()}
    assert got == {"a": 0.5, None: 0.0}


def test_a_rest_of_one_cell_is_refused(spark, tiny):
    two = replace(tiny, obs=tiny.obs.where("cell_id < 4").withColumn("kind", F.when(F.col("cell_id") < 3, "gut").otherwise("lung")))
    with pytest.raises(ValueError, match="rest"):
        stats.find_markers(*stats.group_sums(two, "kind"), two.var, "gut")


def test_layouts_by_gene_and_by_cell(spark, tiny, tmp_path):
    for order in ("gene", "cell"):
        root = str(tmp_path / order)
        store_io.write_store(root, tiny, order=order, int32=True)
        assert sorted(map(tuple, store_io.open_store(spark, root).x.collect())) == sorted(map(tuple, tiny.x.collect()))
    with pytest.raises(ValueError, match="32-bit"):
        store_io.add_part(root, "x", tiny.x.withColumn("cell_id", F.col("cell_id") + 2**31), overwrite=True, int32=True)


def test_strata_are_laid_out_for_genes_and_for_strata(spark, tmp_path):
    """The read of a gene and that of a stratum take a small part of the files each; both modes give the same rows."""
    obs = spark.range(600).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 31 > 0, (F.col("id") % 30).cast("string")).alias("a"), (F.col("id") % 2).cast("string").alias("b"))
    var = spark.range(300).select(F.col("id").cast("int").alias("gene_id"), F.lit("v").alias("var_name"))
    x = spark.range(600 * 40).select((F.col("id") % 600).alias("cell_id"), ((F.col("id") * 7) % 300).cast("int").alias("gene_id"), F.lit(1.0).alias("value"))
    root = str(tmp_path / "store")
    store_io.write_store(root, Store(obs, var, x))
    router.build_strata(spark, root, store_io.open_store(spark, root), ["a", "b"], [["a"]], file_bytes=8_000)
    files = lambda d: d.withColumn("file", F.input_file_name()).select("file").distinct().count()
    whole = store_io.read_strata(spark, root, "atomic")[0]
    every = files(store_io._read(spark, root, next(r for r in store_io.log(spark, root) if (r["part"], r["key"]) == ("strata", "atomic"))))
    assert every >= 40
    assert files(store_io.read_strata(spark, root, "atomic", [17])[0]) <= every / 4
    rows = lambda d: sorted(map(str, d.collect()))
    for names in ([("7", "1")], [(None, "0"), ("3", "1")], [("none", "0")]):
        some = spark.createDataFrame(names, "a string, b string")
        got = {mode: store_io.read_strata(spark, root, "atomic", None, some, mode) for mode in ("auto", "rows", "full")}
        assert rows(got["auto"][0]) == rows(got["rows"][0]) == rows(got["full"][0]) and rows(got["rows"][1]) == rows(got["full"][1])
        assert got["rows"][0].count() == whole.where(" or ".join(f"(a <=> {'null' if a is None else repr(a)} and b = '{b}')" for a, b in names)).count()
        plan = lambda mode: got[mode][0]._jdf.queryExecution().executedPlan().toString()  # noqa: B023, E731
        assert got["rows"][1].isEmpty() or "strata_range" in plan("auto") and "strata_range" in plan("rows")
    assert files(store_io.read_strata(spark, root, "atomic", None, spark.createDataFrame([("7", "1")], "a string, b string"))[0]) <= every / 4
    most = obs.select("b").distinct()  # all strata: the whole table is read
    assert "strata_range#" not in store_io.read_strata(spark, root, "atomic", None, most)[0]._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert rows(store_io.read_strata(spark, root, "atomic", [], None)[1]) == rows(obs.groupBy("a", "b").agg(F.count("*").alias("n_cells")))


def test_sketches_of_axes(spark):
    """Sketches of parts add up to that of all; nulls are a label of their own; more axes than a sketch has are bounded."""
    obs = spark.range(40_000).select(F.col("id").alias("cell_id"), (F.col("id") % 97).cast("string").alias("a"), F.when(F.col("id") % 50 > 0, (F.col("id") % 89).cast("string")).alias("b"), F.expr("string(id div 400)").alias("c"), F.lit("x").alias("d"))
    axes = ["a", "b", "c", "d"]
    merged = strata.merge_sketches([strata.axis_sketches(obs.where(f"cell_id % 4 = {k}"), axes) for k in range(4)])
    for some in (["a"], ["b"], ["a", "b"], ["c", "a"], ["a", "b", "c"], ["d", "b"]):
        n = obs.select(*some).distinct().count()
        assert strata.sketched_tuples(merged, some) == (pytest.approx(n, rel=0.02),) * 2
    low, high = strata.sketched_tuples(merged, axes)
    assert low <= 1.02 * obs.select(*axes).distinct().count() and high * 1.02 >= obs.select(*axes).distinct().count()
    got = {r["axis"]: r for r in strata.sketched_preflight(merged, ["a", "b"], most=20_000).collect()}
    assert (got["a"]["labels"], got["b"]["labels"], got["b"]["null_share"], got["a"]["ok"]) == (97, 89, 0.02, True)
    assert not any(r["ok"] for r in strata.sketched_preflight(merged, ["a", "b", "c"], most=1_000).collect())
    assert [r["ok"] for r in strata.sketched_preflight(merged, axes, most=int(1.5 * low)).collect()] in ([True] * 4, [None] * 4)
    with pytest.raises(ValueError):
        strata.sketched_tuples(merged, ["e"])


def test_matrix_files_are_bounded(spark, tmp_path):
    """A gene with a third of all entries is in several files, none of which is large; a gene's read lists the folders of its range."""
    rows = [(c, 7, 1.0) for c in range(3000)] + [(c, g, float(g)) for g in range(0, 400, 2) for c in range(30)]
    x = spark.createDataFrame(rows, "cell_id long, gene_id int, value double")
    s = Store(x.select("cell_id").distinct(), x.select("gene_id").distinct().withColumn("var_name", F.lit("v")), x)
    root, most = str(tmp_path / "store"), 500
    store_io.write_store(root, s, file_bytes=most * st.ENTRY_BYTES)
    back = store_io.open_store(spark, root)
    assert sorted(map(tuple, back.x.collect())) == sorted(rows) and back.x.columns == x.columns
    found = back.ranges[1].withColumn("file", F.input_file_name()).groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("gene_id") == 7).alias("hot"), F.max("genes").alias("genes")).collect()
    assert max(r["n"] for r in found) <= most and sum(r["hot"] > 0 for r in found) >= 6 and len({r["genes"] for r in found}) >= 10
    for g in (7, 0, 398, 122, 1, 999):
        read = back.entries([g])
        files = read.withColumn("file", F.input_file_name()).select("file").distinct().count()
        assert read.count() == sum(r[1] == g for r in rows) and files <= (7 if g == 7 else 2)
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "genes" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert back.gene(122).where("value > 0").count() == 30 and back.gene(1).where("value = 0").count() == 3000
    assert {r["part"]: r["files"] for r in store_io.layout(spark, root).collect()}["x"] == len(found)
    store_io.add_part(root, "layers", x, "again")
    assert store_io.open_store(spark, root).from_layer("again").entries([7]).count() == 3000


def test_all_parts_come_back(spark, tiny, tmp_path):
    root = str(tmp_path / "store")
    coords = spark.createDataFrame([("flat", i, [float(i), 0.5]) for i in range(7)], "key string, cell_id long, coords array<double>")
    pairs = spark.createDataFrame([(0, 1, 0.25), (1, 0, 0.25)], "row_id long, col_id long, value double")
    uns = spark.createDataFrame([("colours", "[1]")], "path string, value_json string")
    labels = spark.createDataFrame([("kind", 0, "skin"), ("kind", 1, "gut"), ("kind", 2, "lung"), ("kind", 3, "eye")], "column string, code int, label string")
    full = Store(tiny.obs, tiny.var, tiny.x, coords, {"counts": tiny.x.withColumn("value", F.col("value") * 3)}, {"near": pairs}, {"linked": pairs}, uns, labels)
    store_io.write_store(root, full)
    back = store_io.open_store(spark, root)
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect()))
    assert same(back.obsp["near"], pairs) and same(back.varp["linked"], pairs) and same(back.uns, uns) and same(back.categories, labels) and same(back.layers["counts"], full.layers["counts"])
    assert dict(back.obsm.dtypes)["coords"] == "array<float>" and back.embedding("flat").count() == 7
    assert same(back.from_layer("counts").x, full.layers["counts"])
    with pytest.raises(KeyError):
        back.from_layer("none")
    # declared labels, empty ones too, are the groups of a panel, and their order breaks ties
    panel = {(r["group"], r["gene_id"]): (r["mean"], r["n_cells"]) for r in stats.gene_panel(back, "kind", [0, 1]).collect()}
    assert panel[("eye", 0)] == (0.0, 0) and panel[("gut", 1)] == (pytest.approx(sum(_of("gut", 1)) / 3), 3) and len(panel) == 8
    obs = spark.createDataFrame([(i, "s", k) for i, k in enumerate(["gut", "skin", "lung"])], "cell_id long, site string, kind string")
    first = annotations.bar_composition(obs, "site", ["s"], "kind", most=1, declared=back.labels("kind"))
    assert {r["label"] for r in first.collect()} == {"skin", "All other"}
    files = {r["part"]: r for r in store_io.layout(spark, root).collect()}
    assert files["x"]["files"] >= 1 and files["x"]["ratio"] == pytest.approx(7 * 4 * 4 / files["x"]["bytes"]) and files["obs"]["ratio"] is None
    parts = {(r["part"], r["key"]): (json.loads(r["columns"]), r["rows"]) for r in store_io.actual_layout(spark, root).collect()}
    assert parts[("obsp", "near")] == ({"row_id": "bigint", "col_id": "bigint", "value": "double"}, 2) and parts[("obs", "")][1] == 7
    with pytest.raises(ValueError):
        store_io.add_part(root, "raw", tiny.x)
    with pytest.raises(ValueError):
        store_io.add_part(root, "uns", uns.where("false"), overwrite=True)
    # one gene is read by row groups that hold it
    plan = back.x.where("gene_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(gene_id,2)" in plan


def test_unfinished_part_is_invisible(spark, tiny, tmp_path):
    root = str(tmp_path)
    tiny.obs.write.parquet(f"{root}/obs")
    with pytest.raises(KeyError):
        store_io.read_part(spark, root, "obs")
    with pytest.raises(ValueError):
        store_io.open_store(spark, root)


def test_missing_to_text(spark):
    d = spark.createDataFrame([(x,) for x in ("None", "blue", None, "", "none", "nan")], "c string")
    assert [r[0] for r in d.select(as_label(F.col("c"))).collect()] == ["unknown", "blue", "unknown", "", "none", "unknown"]
    n = spark.createDataFrame([(2.25,), (None,), (float("nan"),)], "c double")
    assert [r[0] for r in n.select(as_label(F.col("c"), True)).collect()] == ["2.25", "unknown", "unknown"]


def test_normalisation_of_empty_cells(spark, tiny):
    empty = Store(tiny.obs, tiny.var, tiny.x.where("false"))
    with pytest.raises(ValueError):
        matrix.normalize_log1p(empty)
    one = Store(tiny.obs, tiny.var, tiny.x.where("cell_id <> 3"))
    assert matrix.cell_totals(one).where("cell_id = 3").first()["total"] == 0
    n = matrix.normalized(tiny)
    totals = sorted(sum(r) for r in GRID if sum(r))
    scaled = n.x.groupBy("cell_id").agg(F.sum(F.expm1("value")).alias("t")).collect()
    assert [r["t"] for r in scaled] == pytest.approx([statistics.median(totals)] * len(totals)) and n.uns.first()["path"] == "log1p"


def test_errors(spark, tiny):
    with pytest.raises(ValueError):
        annotations.filter_by_expression(tiny, 0)
    with pytest.raises(ValueError):
        annotations.filter_by_expression(tiny, 0, 2, 1)
    with pytest.raises(ValueError):
        annotations.describe_numeric(tiny.obs, "subject")
    with pytest.raises(ValueError):
        stats.compare_groups(*stats.group_sums(tiny, "kind"), tiny.var, "gut", "skin")
    with pytest.raises(ValueError):
        annotations.color_by_category(Store(tiny.obs, tiny.var, tiny.x, spark.createDataFrame([("k", 0, [0.0, 1.0])], "key string, cell_id long, coords array<float>")), "subject", "k", ["nobody"])
    with pytest.raises(ValueError, match="no cell"):
        annotations.select_by_expression(tiny, 0, 99)
    assert annotations.select_by_expression(tiny, 3, 1, 1)[1] == 1 and annotations.select_by_expression(tiny, 3, 0, 0)[1] == 6
    with pytest.raises(ValueError, match="f, a, c, b, e$"):
        annotations.genes_named(tiny.var, ["f", "name1", "a", "c", "b", "e", "d"])
    assert annotations.genes_named(tiny.var, ["name2", "name0"]) == [2, 0]
    with pytest.raises(ValueError):
        st.need_int32(spark.createDataFrame([(2**31, 0, 1.0)], "cell_id long, gene_id int, value double"))
    assert st.need_int32(tiny.x) is tiny.x


def test_composition(spark):
    shelf, kind = ["low"] * 5 + ["high"] * 3, ["cup", "jar", "cup", None, "pan", "jar", "pan", "pan"]
    obs = spark.createDataFrame(list(zip(range(8), shelf, kind, ["x", "y"] * 4, strict=True)), "cell_id long, shelf string, kind string, room string")
    for where in ({}, {"room": "x"}):
        rows = [(s, k) for i, (s, k) in enumerate(zip(shelf, kind, strict=True)) if not where or i % 2 == 0]
        n = Counter(s for s, _ in rows)
        want = {p: c / n[p[0]] for p, c in Counter(r for r in rows if r[1]).items()}
        got = annotations.bar_composition(obs, "shelf", ["low", "high"], "kind", where=where).collect()
        assert {(r["group"], r["label"]): pytest.approx(r["share"]) for r in got} == want


def test_composition_ranks_labels_in_many_tasks(spark):
    obs = spark.range(300).select(F.lit("s").alias("site"), F.concat(F.lit("t"), F.floor(F.sqrt("id")).cast("string")).alias("cell_type"))
    rows = annotations.bar_composition(obs, "site", ["s"], "cell_type")
    got = {r["label"]: r["share"] for r in rows.collect()}
    assert set(got) == {"All other", *[f"t{k}" for k in range(7, 17)]} and got["t16"] == pytest.approx(33 / 300) and sum(got.values()) == pytest.approx(1)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_coupled_admission(spark):
    rows = [(1, 1, "2024-01-01 00:01:00"), (2, 1, "2024-01-01 00:02:00"), (3, 2, "2024-01-01 00:03:00"), (4, 3, "2024-01-01 00:04:00"), (5, 1, "2024-01-02 00:00:00")]
    q = spark.createDataFrame(rows, "question_id long, visitor long, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r["question_id"]: r["verdict"] for r in usage.admit_coupled(q, 1, 2).collect()}
    assert got == {1: "admitted", 2: "visitor", 3: "admitted", 4: "day", 5: "admitted"}


def _admit_one_by_one(rows, per_visitor, per_day, per_ip):
    days, visitors, ips, out = {}, {}, {}, {}
    for q, visitor, ip, at in sorted(rows, key=lambda r: (r[3], r[0])):
        day, v, i = at.date(), (visitor, at.replace(minute=0, second=0)), (ip, at.replace(minute=0, second=0))
        if days.get(day, 0) >= per_day:
            out[q] = "day"
        elif visitors.get(v, 0) >= per_visitor:
            out[q] = "visitor"
        elif ip is not None and ips.get(i, 0) >= per_ip:
            out[q] = "ip"
        else:
            out[q] = "admitted"
            for counts, k in ((days, day), (visitors, v), (ips, i)):
                counts[k] = counts.get(k, 0) + 1
    return out


@pytest.mark.parametrize("limits", [(1, 9, 2), (2, 60, 3), (3, 0, 1), (1, 10_000, 1)])
def test_admission_with_addresses(spark, limits):
    r = random.Random(str(limits))
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, r.randrange(12), r.choice([None, *"abcde"]), start + datetime.timedelta(minutes=r.randrange(2880))) for k in range(600)]
    q = spark.createDataFrame(rows, "question_id long, visitor long, ip string, at timestamp")
    per_visitor, per_day, per_ip = limits
    got = {x["question_id"]: x["verdict"] for x in usage.admit_coupled(q, per_visitor, per_day, per_ip).collect()}
    local = [(k, v, ip, at) for k, v, ip, at in ((x["question_id"], x["visitor"], x["ip"], x["at"]) for x in q.collect())]
    assert got == _admit_one_by_one(local, *limits)


def test_usage_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    times = ["00:10:00", "00:50:00", "01:05:00", "02:30:00"]
    for k, t in enumerate([f"2024-01-01 {t}" for t in times] + ["2024-01-03 00:00:00", "2024-01-03 00:00:01"]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"visitor": k % 2, "ip": "a" if k else None, "at": t}))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k,) * 2)  # files are read in this order
    schema = "visitor long, ip string, at timestamp"
    q = usage.usage_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    s = q.writeStream.outputMode("append").format("memory").queryName("counters").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    s.awaitTermination(240)
    batch = usage.usage_windows(spark.read.schema(schema).json(str(tmp_path / "in"))).where("window_start < '2024-01-03'")
    rows = lambda d: sorted(map(tuple, d.select("kind", "key", "window_start", "n").collect()))
    assert rows(spark.table("counters")) == rows(batch) and batch.where("kind = 'day'").first()["n"] == 4


def test_harvest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, (status, value) in enumerate([("ok", "a"), ("failed", None), ("ok", "b"), ("failed", "x")]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"dataset_id": 1, "at": k, "status": status, "value": value, "error": None if status == "ok" else "e"}))
    stream = spark.readStream.schema("dataset_id long, at long, status string, value string, error string").option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    catalog.log_harvests(stream, str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination(120)
    got = catalog.merge_harvests(spark.read.parquet(str(tmp_path / "log"))).first()
    assert (got["value"], got["fetched_at"], got["attempted_at"], got["status"], got["error"]) == ("b", 2, 3, "failed", "e")


def test_panels_show_empty_groups(spark, tiny):
    only = Store(tiny.obs, tiny.var, tiny.x.where("cell_id <> 3"))
    got = {(r["group"], r["gene_id"]): (r["mean"], r["fraction"]) for r in annotations.bar_gene_mean(only, "kind", ["gut", "skin", "eye"], [0, 1]).collect()}
    mean = lambda k, j: (pytest.approx(sum(_of(k, j)) / len(_of(k, j))), pytest.approx(sum(v > 0 for v in _of(k, j)) / len(_of(k, j))))
    assert got == {("gut", 0): mean("gut", 0), ("gut", 1): mean("gut", 1), **{(k, j): (0.0, 0.0) for k in ("skin", "eye") for j in (0, 1)}}
    axes = ["kind", "subject"]
    dots = strata.dotplot(strata.build_atomic(only, axes), strata.strata_cells(only, axes), "kind", [1, 2], ["gut", "skin"])
    got = {(r["group"], r["gene_id"]): (r["mean"], r["fraction"]) for r in dots.collect()}
    assert got == {("gut", 1): mean("gut", 1), ("gut", 2): mean("gut", 2), ("skin", 1): (0.0, 0.0), ("skin", 2): (0.0, 0.0)}
    some = annotations.bar_gene_mean(tiny, "kind", ["gut"], [0], {"subject": "q"}).first()
    assert (some["mean"], some["n_cells"]) == (GRID[2][0], 1)


def test_missing_categories_are_a_group(tiny):
    some = Store(tiny.obs.withColumn("kind", F.when(F.col("kind") != "lung", F.col("kind"))), tiny.var, tiny.x)
    axes = ["kind", "subject"]
    atomic, cells = strata.build_atomic(some, axes), strata.strata_cells(some, axes)
    got = {(r["kind"], r["subject"]): (r["n_cells"], r["mean"]) for r in strata.statistics(atomic, cells, axes).where("gene_id = 2").collect()}
    assert got[(None, "q")] == (2, (GRID[4][2] + GRID[6][2]) / 2)
    for rows in (strata.dotplot(atomic, cells, "kind", [0, 2]), stats.gene_panel(some, "kind", [0, 2])):
        got = {(r["group"], r["gene_id"]): (r["mean"], r["fraction"], r["n_cells"]) for r in rows.collect()}
        x = _of("lung", 0)
        assert got[(None, 0)] == (pytest.approx(sum(x) / 3), pytest.approx(sum(v > 0 for v in x) / 3), 3) and len(got) == 6


def test_floor_with_negative_values(spark):
    obs = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "cell_id long, t string")
    var = spark.createDataFrame([(0, "g")], "gene_id int, var_name string")
    x = spark.createDataFrame([(0, 0, -1.0), (1, 0, 2.0)], "cell_id long, gene_id int, value double")
    got = {r["group"]: r["fraction"] for r in stats.gene_panel(Store(obs, var, x), "t", [0], "above_min").collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_triples(spark):
    entries = spark.createDataFrame([(0, 2, 5.0), (1, 0, 6.0), (2, 1, 7.0)], "pos long, index int, value double")
    pointers = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 3)], "row long, start long")
    assert sorted(map(tuple, st.coo_from_triple(entries, pointers).collect())) == [(0, 2, 5.0), (2, 0, 6.0), (2, 1, 7.0)]
    assert sorted(map(tuple, st.coo_from_triple(entries, pointers, by_cell=False).collect())) == [(0, 2, 6.0), (1, 2, 7.0), (2, 0, 5.0)]


def test_reduction_in_blocks(spark, tiny):
    part = lambda rows: rows.groupby("gene_id", as_index=False)["value"].max()
    got = matrix.reduce_genes(tiny.x, part, part, "gene_id int, value double", block=2)
    assert sorted(map(tuple, got.collect())) == [(j, max(r[j] for r in GRID)) for j in range(4)]


def test_categories_round_trip(spark, tiny):
    obs = tiny.obs.withColumn("subject", F.when(F.col("cell_id") > 0, F.col("subject")))
    labels = matrix.categories(obs, ["kind", "subject"])
    back = matrix.decode_categorical(matrix.encode_categorical(obs, ["kind", "subject"]), labels)
    want = [(r["cell_id"], c, r[c]) for r in obs.collect() for c in ("kind", "subject")]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(want, key=str)


def test_hooks(spark, tiny, tmp_path):
    heard = []
    store_io.write_store(str(tmp_path / "s"), tiny, hook=lambda *e: heard.append(e))
    assert heard == [("done", "obs"), ("done", "var"), ("done", "x"), ("done", "categories"), ("complete", "")]
    with pytest.raises(store_io.PartExists):
        store_io.write_store(str(tmp_path / "s"), tiny, hook=lambda *e: heard.append(e))
    assert heard[-1] == ("error", "obs")


def test_gene_columns(spark, tiny):
    assert [r["gene_symbol"] for r in matrix.prepare_var(tiny.var).orderBy("gene_id").collect()] == ["0", "1", "2", "3"]
    named = matrix.prepare_var(tiny.var.withColumnRenamed("var_name", "GeneSymbol").withColumn("Chromosome", F.lit(None).cast("string")).withColumn("extra", F.lit(1)))
    assert named.columns == ["gene_id", "GeneSymbol", "Chromosome", "gene_symbol"] and tuple(named.where("gene_id = 1").first())[1:] == ("name1", "unknown", "name1")
    order = [*annotations.LABEL_COLUMNS, "other"]
    for k in range(len(order) - 1):
        var = tiny.var.select("gene_id", *[F.lit(c).alias(c) for c in reversed(order[k:])])
        assert annotations.label_column(var) == order[k]
    assert annotations.label_column(tiny.var.select("gene_id")) == "gene_id"
    named = annotations.relabel(tiny.x.select("gene_id").distinct(), tiny.var.where("gene_id < 2"), "var_name")
    assert sorted(r["label"] for r in named.collect()) == ["2", "3", "name0", "name1"]


def test_prepared_cells(spark, tiny):
    obs = tiny.obs.select("cell_id", *[F.lit(c).alias(c) for c in ("sample_id", "donor_id", "platform", "tissue", "cell_type_study", "dataset", "cell_type")], F.lit("mine").alias("site"), F.lit(None).cast("string").alias("disease"), F.lit("TPM").alias("expression_unit"))
    got = matrix.prepare_obs(obs, "d7").where("cell_id = 5").first()
    assert tuple(got) == (5, "d7_5", "sample_id", "cell_type", "cell_type_study", "platform", "UMI", "mine", "unknown", "donor_id", "dataset", "5")
    with pytest.raises(ValueError, match="disease"):
        matrix.prepare_obs(obs.drop("disease"), "d7")
    dense = {r["cell_id"]: r["values"] for r in st.densify(tiny.x.where("cell_id <> 2"), 4, tiny.obs).collect()}
    assert dense == {i: r if i != 2 else [0.0] * 4 for i, r in enumerate(GRID)}


def test_selected_genes(spark, tiny):
    var = spark.createDataFrame([(0, 2.0, 0.5, True), (1, None, 3.0, False), (2, 1.0, None, True), (3, 3.0, 3.0, None)], "gene_id int, highly_variable_rank double, `vst.variance.standardized` double, highly_variable boolean")
    chosen = lambda v, n: [r["gene_id"] for r in matrix.select_ranked(v, n).collect()]
    assert chosen(var, 2) == [0, 2] and chosen(var, 9) == [0, 2, 3]
    assert chosen(var.drop("highly_variable_rank"), 2) == [1, 3] and chosen(var.select("gene_id", "highly_variable"), 1) == [0] and chosen(var.select("gene_id"), 1) == [0, 1, 2, 3]
    assert {r["gene_id"] for r in matrix.restrict(tiny.x, var.where("gene_id > 1")).select("gene_id").distinct().collect()} == {2, 3}
    edges = matrix.knn_within(spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.1]), (2, [9.0, 9.0])], "cell_id long, coords array<double>"), 1, 1.0)
    with_graph = Store(tiny.obs, tiny.var, tiny.x, obsp={"distances": edges})
    assert {(r["row_id"], r["col_id"]) for r in with_graph.obsp["distances"].collect()} == {(0, 1), (1, 0)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=30_000), np.r_[np.zeros(9000), np.arange(20_000.0)], np.array([4.0]), np.array([1.0, 2.0])):
        d = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for most in (10**6, 0):
            assert exact_quantiles(d, [0.0, 0.25, 0.5, 0.9, 1.0], most) == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist())
    assert exact_quantiles(d.where("v is null"), [0.5]) is None


def test_states_of_a_matrix(spark):
    for values, state in (([0.0], 0), ([-1.2, 0.4, 1.1, -0.6], 1), ([-9.0, 30.0], 2), ([3.0, 21.0, 1.0], 3), ([20.0, 1.0], 4), ([0.5, 14.9], 5), ([0.5, 15.0], 6)):
        x = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "cell_id long, gene_id int, value double")
        assert stats.scan_state(x).first()["state"] == stats.STATES[state]


def test_singular_values(spark, tiny):
    scores, values = matrix.svd_scores(tiny, 3)
    u, s, _ = np.linalg.svd(np.array(GRID), full_matrices=False)
    assert values == pytest.approx(s[:3].tolist())
    got = np.zeros((7, 3))
    for r in scores.collect():
        got[r["cell_id"], r["component"]] = r["score"]
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-9)


@pytest.mark.parametrize("shape", ["gaps", "wide", "rank", "alike"])
def test_singular_values_of_selections(spark, shape):
    """Genes with gaps in their numbers, more genes than one block has directions, fewer directions than asked for, values that repeat."""
    rng = np.random.default_rng(8)
    n, m = (40, 90) if shape != "wide" else (60, 700)
    a = rng.normal(size=(n, m)) * (rng.random((n, m)) < 0.3)
    if shape == "rank":
        a = rng.normal(size=(n, 3)) @ rng.normal(size=(3, m))
    if shape == "alike":
        a = np.kron(np.eye(20), np.ones((2, 4)))
        n, m = a.shape
    ids = np.sort(rng.choice(10**9, m, replace=False))
    i, j = np.nonzero(a)
    x = spark.createDataFrame([(int(r), int(ids[c]), float(a[r, c])) for r, c in zip(i, j, strict=True)], "cell_id long, gene_id long, value double").repartition(3)
    scores, values = matrix.svd_scores(Store(None, None, x), 6)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert values == pytest.approx(s[:6].tolist(), rel=1e-6, abs=1e-5)
    got = np.zeros((n, 6))
    for r in scores.collect():
        got[r["cell_id"], r["component"]] = r["score"]
    assert np.linalg.norm(got, axis=0) == pytest.approx(s[:6], rel=1e-6, abs=1e-5)
    if shape in ("gaps", "wide"):
        assert np.abs(got) == pytest.approx(np.abs(u[:, :6] * s[:6]), abs=1e-4)
    with pytest.raises(ValueError):
        matrix.singular(None, np.arange(10**6), 50)


@pytest.mark.parametrize("kind", ["clusters", "random", "ties", "few"])
def test_exact_neighbours(spark, kind, monkeypatch):
    rng = np.random.default_rng(5)
    points = {"clusters": rng.normal(size=(500, 6)) + 9 * rng.integers(0, 4, (500, 1)), "random": rng.normal(size=(300, 20)), "ties": rng.integers(0, 3, (200, 3)).astype(float), "few": rng.normal(size=(4, 3))}[kind]
    ids = rng.permutation(len(points))
    v = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points, strict=True)] + [(10**6, None), (10**6 + 1, [float("nan")] * points.shape[1]), (10**6 + 2, [])], "cell_id long, coords array<double>")
    got = {}
    for r in neighbours.knn_all(v, 5, pivots=8, block=20).collect():
        got.setdefault(r["row_id"], []).append((r["value"], r["col_id"]))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for k, i in enumerate(ids):
        want = sorted((d[k, m], int(ids[m])) for m in range(len(ids)) if m != k)[:5]
        assert sorted(got[i])[: len(want)] == [(pytest.approx(x), j) for x, j in want] and len(got[i]) == len(want)
    assert len(got) == len(ids) and neighbours.knn_all(v.where("false"), 5).count() == 0


def test_neighbours_out_of_reach_are_not_compared(spark):
    """Comparisons beside the number of all pairs: clusters far apart."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(4000, 4)) + 50 * rng.normal(size=(40, 4))[rng.integers(0, 40, 4000)]
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell_id long, coords array<double>")
    blocks, _ = neighbours._blocks(neighbours._dealt(v, neighbours.draw_pivots(v, 64, 4096)), 64, 64)
    assert blocks.agg(F.max(F.size("m"))).first()[0] < 200
    assert neighbours.compared(v, 5, block=64) < 0.15 * 4000**2


def test_neighbours_of_all_cells(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 6)) + 9 * rng.integers(0, 4, (600, 1))
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell_id long, coords array<double>")
    edges = matrix.knn_within(v, 5, radius=3.0, tables=12)
    assert matrix.knn_recall(edges, v, v.where("cell_id % 20 = 0"), 5) > 0.9
    assert edges.groupBy("row_id").count().agg(F.max("count")).first()[0] == 5 and edges.columns == ["row_id", "col_id", "value"]


def test_turns(spark):
    rows = [(1, "user"), (2, "assistant user"), (3, "user assistant user"), (4, "user user"), (5, "assistant user assistant user"), (6, "user assistant"), (7, "system user assistant user")]
    m = spark.createDataFrame([(t, k, r, "x" * 10) for t, roles in rows for k, r in enumerate(roles.split())], "thread_id long, turn int, role string, text string")
    assert {r["thread_id"] for r in chat.alternating(m).where("ok").collect()} == {1, 3, 7}
    views = spark.createDataFrame([(1, "y" * 4097), (2, "y" * 4096), (3, None)], "thread_id long, view_state string")
    assert {r["thread_id"] for r in chat.oversized(m, views=views).where("oversized").collect()} == {1}
    for text, over in (("z" * 4001, True), ("z" * 4000, False)):
        assert chat.oversized(m.withColumn("text", F.lit(text))).where("thread_id = 1").first()["oversized"] == over
    assert chat.oversized(spark.range(31).select(F.lit(1).alias("thread_id"), F.lit("").alias("text"))).first()["oversized"]


def test_redaction(spark):
    d = spark.createDataFrame([(True, "a" * 4096), (True, "a" * 4097), (False, "a")], "public boolean, t string")
    p, t = F.col("public"), F.col("t")
    got = d.select(scalars.redacted(t, p), scalars.redacted_result(t, p), scalars.redacted_args(F.lit("find"), t, p), scalars.redacted_view(F.lit(None).cast("string"), p)).collect()
    assert tuple(got[0]) == ("a" * 4096,) * 3 + (None,) and tuple(got[1])[:2] == ("a" * 4097, '{"_truncated":true,"_size_bytes":4097}')
    assert tuple(got[2]) == ("[redacted]", '{"_redacted":"tool_result"}', '{"_redacted":"tool_args","tool":"find"}', None)


def test_stream_equals_batch(spark, tmp_path):
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"ts": 1.0, "bytes": 10 * k + i if i else None, "elapsed_ms": 1.5, "error": "x" if i == 2 else None}) for i in range(4)))
    q = usage.trace_summary(usage.read_trace(spark, str(tmp_path / "in"), stream=True)).writeStream.outputMode("complete").format("memory").queryName("trace").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = usage.trace_summary(usage.read_trace(spark, str(tmp_path / "in"))).collect()
    assert spark.sql("select * from trace").collect() == batch and batch[0]["requests"] == 8


def test_run_log(spark, tmp_path):
    (tmp_path / "runs.json").write_text(json.dumps([{"run": 1, "status": "running", "dataset": {"n_obs": 5}}, {"run": 2, "status": "completed"}]))
    runs = chat.read_runs(spark, str(tmp_path / "runs.json"))
    assert chat.next_run(runs) == 3
    u = spark.createDataFrame([(1, "completed", (None, 7))], "run int, status string, dataset struct<n_obs:long,n_vars:long>")
    got = chat.merge_runs(runs, u).where("run = 1").first()
    assert got["status"] == "completed" and got["dataset"]["n_obs"] == 5 and got["dataset"]["n_vars"] == 7


def test_verified_copies(spark, tiny, tmp_path):
    assert catalog.copy_table(tiny.obs, str(tmp_path / "copy")).count() == 7
    tables = {"cells": tiny.obs, "entries": tiny.x}
    links = {"entries.cell": ("entries", "cell_id", "cells", "cell_id")}
    with pytest.raises(ValueError, match="not r2"):
        catalog.copy_tables(tables, links, str(tmp_path / "a"), "r1", "r2")
    with pytest.raises(ValueError, match="parent"):
        catalog.copy_tables(tables | {"cells": tiny.obs.limit(2)}, links, str(tmp_path / "a"), "r1", "r1")
    assert not (tmp_path / "a").exists()
    rows = {r["table"]: r["rows"] for r in catalog.copy_tables(tables, links, str(tmp_path / "a"), "r1", "r1").collect()}
    assert rows == {"cells": 7, "entries": tiny.x.count()}
    with pytest.raises(Exception, match="exists"):
        catalog.copy_tables(tables, links, str(tmp_path / "a"), "r1", "r1")


def test_registry(spark, tiny):
    with pytest.raises(ValueError):
        router.register("compare_groups")(print)
    assert len(router.OPERATORS) > 90
    schema = router.arguments("search_genes")
    assert schema["required"] == ["var", "query"] and schema["properties"]["limit"] == {"type": "integer", "default": 20}
    assert [r["gene_id"] for r in router.call("search_genes", var=tiny.var, query="ME2").collect()] == [2]
    for wrong in ({"var": tiny.var}, {"var": tiny.var, "query": "a", "more": 1}, {"var": tiny.var, "query": 3}):
        with pytest.raises(ValueError):
            router.call("search_genes", **wrong)
    with pytest.raises(KeyError):
        router.call("nothing")


def test_rows_by_more_ids_than_a_hundred_thousand(spark):
    ids = spark.range(150_001).select((F.col("id") * 2).alias("k")).union(spark.createDataFrame([(None,), (4,)], "k long"))
    got = annotations.filter_by_ids(spark.range(1_000).select(F.col("id").alias("cell_id"), F.lit("a").alias("kind")), "cell_id", ids)
    assert sorted(r["cell_id"] for r in got.collect()) == list(range(0, 1_000, 2)) and got.columns == ["cell_id", "kind"]


def test_reduction_makes_few_calls_for_many_genes(spark):
    """A call for every gene and block of cells would be 20,000 of them."""
    calls = spark.sparkContext.accumulator(0)
    x = spark.range(40_000).select((F.col("id") % 7).alias("cell_id"), (F.col("id") % 10_000).alias("gene_id"), F.lit(2.0).alias("value"))

    def total(rows):
        calls.add(1)
        assert "slot" not in rows.columns and "block" not in rows.columns
        return rows.groupby("gene_id", as_index=False)["value"].sum()

    got = matrix.reduce_genes(x, total, total, "gene_id long, value double", block=4).collect()
    assert sorted(map(tuple, got)) == [(g, 8.0) for g in range(10_000)] and 0 < calls.value < 50
    assert matrix.reduce_genes(x.where("false"), total, total, "gene_id long, value double").count() == 0


def test_neighbours_are_sent_by_section(spark):
    """Among random points all blocks meet; a cell goes to the tasks of all sections, and not to each block that looks at it."""
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(size=(3000, 24)))], "cell_id long, coords array<double>")
    blocks, reach, _ = neighbours._meetings(v, 5, pivots=8, block=20)
    assert blocks.count() > 150 and blocks.select("section").distinct().count() <= 2 * neighbours.SECTIONS
    assert reach.agg(F.max(F.size("sections"))).first()[0] <= 2 * neighbours.SECTIONS


@pytest.mark.parametrize("kind", ["far", "copies", "huge"])
def test_nearest_beyond_the_precision_of_products(spark, kind):
    rng = np.random.default_rng(9)
    x = {"far": rng.normal(size=(400, 5)) + 1e9, "copies": np.repeat(rng.normal(size=(4, 5)), 100, axis=0), "huge": rng.normal(size=(400, 5)) * 1e-3 + 1e160 * rng.integers(0, 2, (400, 1))}[kind]
    ids = rng.permutation(400)
    near = neighbours.Nearest(ids, x, 7, np.full(400, np.inf))
    for i in range(0, 400, 150):
        near.meet(np.arange(400), ids[i : i + 150], x[i : i + 150])
    got = near.edges().to_pandas().groupby("row_id")["col_id"].apply(list).to_dict()
    with np.errstate(over="ignore"):
        d = neighbours.distances(x, x)
    for r in range(400):
        want = sorted((d[r, c], ids[c]) for c in range(400) if c != r and np.isfinite(d[r, c]))[:7]
        assert got[ids[r]] == [c for _, c in want]


def test_neighbours_of_queries(spark):
    rng = np.random.default_rng(10)
    x = rng.integers(0, 4, (300, 3)).astype(float)
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)] + [(900, None)], "cell_id long, coords array<double>")
    got = sorted((r["cell_id"], r["rank"], r["neighbour"], r["distance"]) for r in matrix.knn(v.where("cell_id % 50 = 0"), v, 4).collect())
    d = np.square(x[:, None] - x[None]).sum(axis=2)
    assert got == [(q, k + 1, c, far) for q in range(0, 300, 50) for k, (far, c) in enumerate(sorted((d[q, c], c) for c in range(300) if c != q)[:4])]


def test_graph_of_all_cells(spark, tmp_path):
    """Every cell has its neighbours, whatever its id; squared distances, ties to the smaller id."""
    rng = np.random.default_rng(11)
    x, ids = rng.integers(0, 5, (150, 3)).astype(float), rng.permutation(150)
    rows = [(int(i), p.tolist()) for i, p in zip(ids, x, strict=True)]
    spark.createDataFrame([*rows, (900, None)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r["cell_id"], r["rank"], r["neighbour"], r["distance"]) for r in queries.QUERIES["knn_graph"](spark, str(tmp_path)).collect())
    want = [(i, k + 1, c, d) for i, p in sorted(rows) for k, (d, c) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), c) for c, q in rows if c != i)[:10])]
    assert got == want and len(got) == 1500


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """What a task sorts or groups is bounded, whatever spark.sql.shuffle.partitions is; strata are the same for any number of tasks."""
    obs = spark.range(60).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("kind"), F.concat(F.lit("s"), F.col("id") % 2).alias("sex"))
    var = spark.range(40).select(F.col("id").alias("gene_id"), F.concat(F.lit("g"), "id").alias("var_name"))
    x = obs.select("cell_id").crossJoin(var.select("gene_id")).where("(cell_id * 7 + gene_id) % 3 > 0").select("cell_id", "gene_id", F.col("gene_id").cast("double").alias("value"))
    monkeypatch.setattr("stratacell.operators.strata.MOST_NULL", 1.0)
    monkeypatch.setattr("stratacell.sources.store.TASK_ROWS", 100)
    s, root = Store(obs, var, x), store_io.new_root(spark)
    assert st.by_gene(x, [10, 20], st.task_count(x.count())).rdd.getNumPartitions() == st.task_count(x.count()) == 16
    store_io.write_store(root, s)
    router.build_strata(spark, root, store_io.open_store(spark, root), ["kind", "sex"], [["kind"]], file_bytes=1_000)
    for key, axes in (("atomic", ["kind", "sex"]), ("kind", ["kind"])):
        want = strata.build_atomic(s, axes)
        assert sorted(map(str, store_io.read_part(spark, root, "strata", key).collect())) == sorted(map(str, want.collect()))
        folders = store_io._read(spark, root, next(r for r in store_io.log(spark, root) if (r["part"], r["key"]) == ("strata", key)), ranges=True)
        assert folders.select("strata_range", "genes").distinct().count() > 1


def _sorts_of_last_write(spark):
    """Sorts in the plan of the last write to folders, as Spark ran it."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [found.apply(k).physicalPlanDescription() for k in range(found.size())]
    last = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and "genes" in p][-1]
    return len(re.findall(r"Sort \(\d+\)", last.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0].split("\n\n\n")[0]))


def test_a_write_to_folders_sorts_once(spark, tiny, tmp_path):
    """Rows are observed before they are sorted, so Spark knows their order; those of a file are in order, and the log has their content."""
    root = str(tmp_path / "store")
    store_io.write_store(root, replace(tiny, layers={}))
    with store_io.Build(spark, root) as b:
        b.put("x", tiny.x, overwrite=True)
    assert _sorts_of_last_write(spark) == 1
    x = next(r for r in store_io.log(spark, root) if r["part"] == "x")
    assert x["content"] == store_io.content(tiny.x)
    obs = tiny.obs.select("cell_id", F.concat(F.lit("k"), F.col("cell_id") % 2).alias("k"))
    router.build_strata(spark, root, Store(obs, tiny.var, tiny.x), ["k"])
    assert _sorts_of_last_write(spark) == 1
    files = store_io._read(spark, root, x).withColumn("file", F.input_file_name()).withColumn("place", F.monotonically_increasing_id()).orderBy("place").collect()
    for a, b in zip(files, files[1:]):
        assert a["file"] != b["file"] or (a["gene_id"], a["cell_id"]) <= (b["gene_id"], b["cell_id"])


def test_stored_parts_are_written_when_they_are_asked_for(spark, tmp_path):
    """A query that reads pairs has no strata built; all parts of a root are of one store, and strata asked for later are fresh."""
    d = str(tmp_path / "sf")
    os.symlink("/root/testdata/sf0.001", d)
    parts = lambda: {r["part"] for r in store_io.log(spark, root)}
    root, s = queries._stored(spark, d, "obsp")
    assert parts() == {"obs", "var", "x", "categories", "obsp"} and set(s.obsp) == {"same_gene"}
    again, s = queries._stored(spark, d, "strata", "layers")
    assert again == root and parts() == {"obs", "var", "x", "categories", "obsp", "layers", "strata", "strata_cells"}
    assert {r["key"] for r in store_io.fresh_strata(spark, root, s)} == {"atomic", "priority", "status-segment"}
    assert len(store_io.log(spark, queries._stored(spark, d, "obsp", "layers", "strata")[0])) == 12
