"""Links across rows without ids, and how many comparisons groups of copies take."""

import pytest
from pyspark.sql import functions as F

from stratacell.llm import near_dedup

SCHEMA = "doc_id long, text string"


def _text(n, changed=(), tag="w"):
    w = [f"{tag}{i}" for i in range(n)]
    for k, by in changed:
        w[k] = by
    return " ".join(w)


def test_a_hub_without_an_id_links(spark):
    a, b, c = _text(200, [(20, "x")]), _text(200), _text(200, [(150, "y")])
    for rows in ([(1, a), (None, b), (3, c)], [(1, a), (None, b), (None, b), (3, c)], [(7, a), (None, b), (3, c), (None, "alone in here with its own words")]):
        d = spark.createDataFrame(rows, SCHEMA)
        got = near_dedup.near_duplicates(d, 93).collect()
        low = min(r[0] for r in rows if r[0])
        assert {r["component_id"] for r in got if r["doc_id"]} == {low} and sum(r["kept"] for r in got if r["doc_id"]) == 1
    assert near_dedup.deduplicate(spark.createDataFrame([(None, a), (None, b)], SCHEMA)).count() == 1
    assert near_dedup.deduplicate(spark.createDataFrame([(None, a), (None, b), (4, c), (None, "")], SCHEMA)).count() == 2


@pytest.mark.parametrize("similar", [80])
def test_comparisons_grow_with_the_rows(spark, monkeypatch, similar):
    """Two templates of 300 words, seven apart, with a changed word in each copy."""
    made = {}
    for n in (200, 800):
        rows = [(2 * i + k, _text(300, [*((j * 40, f"t{j}") for j in range(7) if k), (5 + i % 290, f"c{i}")])) for i in range(n // 2) for k in (0, 1)]
        seen = []
        plain = near_dedup.prefixes

        def counting(*a, **b):
            out = plain(*a, **b)  # noqa: B023
            seen.append(out.groupBy("hub", "x").count().agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0])  # noqa: B023
            return out

        monkeypatch.setattr(near_dedup, "prefixes", counting)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), similar).collect()
        monkeypatch.undo()
        made[n] = sum(seen)
        assert len({r["component_id"] for r in got if r["doc_id"] % 2 == 0}) == 1 and len({r["component_id"] for r in got if r["doc_id"] % 2}) == 1
    assert made[800] <= 6 * max(made[200], 800)
