"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import base64
import hashlib
import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratacell.llm import decontam, lm, near_dedup, packing, quality_model, quality_rules, sharding, textnum, toxicity, url_filter, warc

WORDS = [f"w{i % 977}x{i % 13}" for i in range(60_000)]
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a text without an id " * 5), (5, " ".join(WORDS)), (6, " ".join(WORDS[:200])), (7, " ".join(WORDS[:200])), (8, "naïve é ü 日本 " * 30)]
EXTRA = "bin long, row string, kept string, seed string, h string, md5 string, n long"


def _docs(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return d.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", ")])


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (None, 1, None), (7, None, None), (9, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(WORDS[40:70])), (2, None), (3, "short"), (None, "x"), (4, " ".join(WORDS[40:70]))], "item_id long, text string")


def test_rules(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs).collect()}
    assert quality_rules.judge(docs).count() == len(ROWS) and got[(1, 0)]["base_failed"] and got[(3, 0)]["word_chars"] == 0 and got[(5, 60_000)]["n_words"] == 60_000
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(docs).columns == docs.columns and quality_rules.keep(empty).count() == 0
    assert sorted(r["doc_id"] for r in quality_rules.keep(docs).collect()) == sorted(r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect())


def test_repeats_in_long_texts(spark, monkeypatch):
    """Beside a plain count: texts too long for shared places, and windows that agree in the bits that share them."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n)) for n in (3, 4, 60, 300, 1500)] + ["x y z " * 40, "a b c d a b c e a b c"]

    def plain(t):
        w = t.split()
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)})

    d = spark.createDataFrame([(t,) for t in texts], "text string")
    for places in (1 << 20, 1 << 10, 4):
        monkeypatch.setattr(quality_rules, "PLACES", places)
        assert [r[0] for r in d.select(quality_rules.n_repeat_words(quality_rules.words(F.col("text")))).collect()] == list(map(plain, texts))
    # all windows agree in the bits left beside places of 60 bits, so that neighbours differ
    monkeypatch.setattr(quality_rules, "PLACES", 1 << 60)
    assert [r[0] for r in d.select(quality_rules.n_repeat_words(quality_rules.words(F.col("text")))).collect()] == list(map(plain, texts))


def test_order_of_rules(spark):
    """The rule that rejects more for its cost comes first, a dear one last, and the verdict is that of all rules."""
    d = _docs(spark, [(i, " ".join(f"w{i}.{k}" for k in range(60)) + "!" * (i % 3)) for i in range(90)])
    dear = lambda c: F.md5(F.array_join(F.array_repeat(c.text, 2000), "")) == "x"
    rules = {"dear": dear, "marks": lambda c: c.text.endswith("!"), "never": lambda c: c.n_words > 1000}
    rows = quality_rules.stored(quality_rules.base(quality_rules.sample(d)), "sample")
    found = quality_rules.rule_order(rows, rules, quality_rules.of_columns())
    assert [r["rule"] for r in found][0] == "marks" and [r["rule"] for r in found][-1] == "dear" and found[0]["rejected"] == 60
    for order in itertools.permutations(rules):
        assert d.where(quality_rules.cascade(rules, list(order), quality_rules.of_words(F.col("text"), quality_rules.words(F.col("text"))))).count() == 30
    assert quality_rules.keep(d, rules).count() == 30 == quality_rules.judge(d, rules).where("kept").count()


def test_classifier(docs, empty, labels):
    for d in (docs, empty):
        x = quality_model.stored(quality_model.features(d), "x")
        model = quality_model.fit(x, quality_model.training_labels(labels))
        got = quality_model.scores(x, model).collect()
        assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality_model.fit(x, quality_model.training_labels(labels.where("false")))
    assert none.beta is None and quality_model.keep(docs, labels.where("false")).count() == len(ROWS)
    assert quality_model.keep(docs, labels).columns == docs.columns


def test_packing(docs, empty):
    got = packing.packed(docs).collect()
    assert len({r["doc_id"] for r in got}) == 9 and sum(r["length"] for r in got if r["doc_id"] == 1) == 1 and max(r["offset"] + r["length"] for r in got) <= 2048
    assert packing.packed(empty).count() == 0


def test_decontamination(docs, empty, benchmark):
    bad = decontam.flagged(docs, benchmark)
    assert [tuple(r)[1:] for r in bad.orderBy("item_id").collect()] == [(1, 1, 30)] * 2
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 8]
    assert decontam.decontaminate(docs, benchmark.where("false")).count() == len(ROWS) and decontam.decontaminate(empty, benchmark).count() == 0


def test_many_seeds(spark, monkeypatch):
    """Beyond the broadcast bound the join shuffles, with the same result."""
    sf = "/root/testdata/sf0.001"
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda: sorted(map(tuple, decontam.flagged(d, b).select(F.hex("md5"), "n_items", "item_id", "matched").collect()))
    near = found()
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert found() == near and near


def test_many_labels(docs, labels, monkeypatch):
    few = sorted(map(str, quality_model.keep(docs, labels).collect()))
    monkeypatch.setattr(quality_model, "BROADCAST_LABELS", 0)
    assert sorted(map(str, quality_model.keep(docs, labels).collect())) == few


def test_substitutions_are_tolerated(spark, benchmark):
    words = WORDS[20:90]
    words[30] = words[41] = "other"
    d = _docs(spark, [(1, " ".join(words)), (2, " ".join(WORDS[300:400]))])
    assert [r["doc_id"] for r in decontam.decontaminate(d, benchmark).collect()] == [2]


def _accepted(doc: list[str], item: list[str]) -> bool:
    """The acceptance rule at every shift, without seeds."""
    n = len(item)
    w = min(decontam.WINDOW, n)
    for shift in range(1 - n, len(doc)):
        m = [0 <= j + shift < len(doc) and doc[j + shift] == item[j] for j in range(n)]
        if any(100 * sum(m[s : s + w]) >= decontam.AGREE * w for s in range(n - w + 1)):
            return True
    return False


def test_no_overlap_is_without_a_seed(spark):
    """Every placing of the substitutions that the rule allows, for items of each length, and one too many."""
    items = {n: [f"i{n}.{k}" for k in range(n)] for n in (*range(1, 14), 15, 20)}
    docs = []
    for n, item in items.items():
        most = min(n, 13) - -(-min(n, 13) * decontam.AGREE // 100)
        for count in range(most + 2):
            for bad in list(itertools.combinations(range(min(n, 13)), count))[:400]:
                docs.append(["before", *[f"other{k}" if k in bad else x for k, x in enumerate(item)][: max(n, 13)], "after"])
    d = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(None if n == 7 else n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    kept = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    want = {k for k, x in enumerate(docs) if not any(_accepted(x, i) for i in items.values())}
    assert kept == want and 0 < len(want) < len(docs)


def test_items_without_id(spark, tmp_path):
    text = " ".join(WORDS[:30])
    spark.createDataFrame([(1, text), (2, "x y")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, text), (None, " ".join(WORDS[5:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.query(spark, str(tmp_path)).collect()}
    assert got == {1: (True, 2, -1, 30), 2: (False, 0, -1, 0)}


def test_near_duplicates(docs, empty):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got[(7, 196)] == (6, False) and got[(6, 196)] == (6, True) and got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(4, 1)] == (4, True)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2 and near_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_each_row_by_its_own_text(spark, monkeypatch, most):
    """Repeated ids with different texts, repeated rows, and texts without an id; with keys broadcast and shuffled."""
    monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", most)
    a, b, c = ("a b c d e f g", "x y z w v u t", "p q r s t u")
    d = _docs(spark, [(4, a), (4, b), (2, b), (2, b), (None, c), (None, c), (7, None), (7, None), (8, ""), (None, a)])
    kept = near_dedup.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, c), (2, b), (4, a), (7, ""), (7, ""), (8, "")]
    report = near_dedup.near_duplicates(d).collect()
    assert len(report) == d.count() and sorted(r["component_id"] for r in report if r["doc_id"] == 4) == [2, 4]


def test_prefixes_are_not_cut_by_rounding(spark):
    n = spark.range(1, 2001)
    for similar in (80, 85, 90):
        got = n.select("id", near_dedup.prefix_length(F.col("id"), similar).alias("m")).collect()
        assert all(r["m"] == r["id"] * (100 - similar) // similar + 1 for r in got)


def test_sharding(docs, empty):
    got = sharding.place(docs, "doc_id").collect()
    assert len(got) == len(ROWS) and len({r["shard"] for r in got if r["doc_id"] == 4}) == 1 and sharding.place(empty, "doc_id").count() == 0
    table = sharding.fill()
    sizes = [table.count(k) for k in range(len(sharding.SHARDS))]
    assert min(table) == 0 and max(sizes) - min(sizes) <= 1
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != len(sharding.SHARDS) - 1)
    assert moved < len(table) // 4
    with pytest.raises(ValueError):
        sharding.fill(())


def test_warc(spark, tmp_path):
    rows = [(1, "http://b.org/x?q=1", "<p>ü</p>\r\n\r\nWARC/1.0"), (2, "https://a.org/", "<p>ü</p>\r\n\r\nWARC/1.0"), (3, None, None), (4, "x", ""), (None, "http://c.org", "p"), (2, "https://a.org/", "<p>ü</p>\r\n\r\nWARC/1.0"), (9, "http://b.org/x?q=1", "long " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("range", F.lit(1))
    warc.write(pages, str(tmp_path / "w"))
    got = warc.index(spark, str(tmp_path / "w")).orderBy("range", "place").collect()
    assert len(got) == len(rows) and all(r["checked"] for r in got)
    assert [r["url_key"] for r in got] == sorted(r["url_key"] for r in got)
    kind = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert kind[1] == ("response", None, 21) and kind[2] == ("revisit", 1, 21) and kind[4] == ("revisit", 3, 0) and kind[9][2] == 1_000_000
    assert {r["page_id"]: r["digest"] for r in got}[9] == base64.b32encode(hashlib.sha1(("long " * 200_000).encode()).digest()).decode()
    warc.write(pages.where("false"), str(tmp_path / "e"))
    assert warc.index(spark, str(tmp_path / "e")).count() == 0


def test_warc_files_are_bounded(spark, tmp_path):
    """In bytes, whatever the mix of sizes; and the index is whole and in order over many files and ranges."""
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 7}.org/{rng.randrange(99)}", "x" * rng.choice([10, 3000, 70_000, 400_000]) + str(i % 50)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), file_bytes=1 << 20)
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert len(sizes) > 20 and max(sizes) <= 1 << 20
    few = warc.RANGE_ROWS
    warc.RANGE_ROWS = 40
    try:
        got = warc.index(spark, str(tmp_path / "w")).orderBy("range", "place").collect()
    finally:
        warc.RANGE_ROWS = few
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in got]
    assert len({r["range"] for r in got}) > 3 and keys == sorted(keys) and sorted(r["page_id"] for r in got) == list(range(300)) and all(r["checked"] for r in got)


def test_lm(docs, empty):
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.scored(docs).collect()}
    assert len(lm.scored(docs).collect()) == len(ROWS) and got[(1, 1)]["n_tokens"] == 1 and all(r["score"] <= 0 for r in got.values())
    assert lm.scored(empty).count() == 0


def test_toxicity(spark, docs, empty, labels):
    for d in (docs, empty):
        model = toxicity.fit(d, labels)
        assert toxicity.scores(d, model).count() == d.count()
    clean, bad = "the quiet river runs past old houses and green fields", "you are an idiot and a moron with no sense at all"
    d = spark.createDataFrame([(i, f"{bad if i % 2 else clean} number {'abcdefghij'[i % 10]}") for i in range(200)], "doc_id long, text string")
    model = toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    test = spark.createDataFrame([(1, "such an 1d10t here"), (2, "green fields"), (3, "an i d i o t"), (4, "what a m0r0n, an iddddiot")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(test, model).collect()}
    assert min(got[1], got[3], got[4]) > got[2] and got[2] < 0.5


def test_toxicity_learns_from_all_labelled_rows(spark):
    d = spark.range(26_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of number "), "id").alias("text"))
    labels = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.train_rows(d, labels).count() == labels.where("crc32(cast(doc_id as string)) % 5 <> 0").count() > 20_000
    texts = ["", "Abc abc", " 1, 2", "é", "x y"]
    apart = [toxicity._trigrams(t) for t in texts]
    assert toxicity._trigrams(*texts) == {g: sum(c.get(g, 0) for c in apart) for c in apart for g in c}
    rows = [(["0"], 1), (["0", "1"], 1), (["1"], 0), (["1"], 0), (["1"], 0), ([], 1), (["0"], 0)]
    w, shift = toxicity._logistic(spark.createDataFrame(rows, "words array<string>, y int"), 2, ridge=0.5)
    z = [1 / (1 + math.exp(-(shift + sum(w[int(k)] for k in ks)))) for ks, _ in rows]
    miss = [y - p for (_, y), p in zip(rows, z, strict=True)]
    # no slope at the optimum; the second weight is at its bound
    assert abs(sum(miss)) < 1e-2 and abs(sum(m for (ks, _), m in zip(rows, miss, strict=True) if "0" in ks) - 0.5 * w[0]) < 1e-2 and w[1] == 0


def test_no_disguise_is_passed_over():
    """Every text that restore() would change is a suspect, wherever it stands in a batch."""
    rng = random.Random(4)
    parts = [*"aabiéèж日²𝒜01@$!|(*+. -_\t\n", "\u00a0", "\u2003", "\u3000", "  ", "ж", "word ", "1d", "e\u0301"]
    texts = ["$tupid", "i d i o t", "i. d. i. o. t", "i--d--i--o--t", "trèèèès", "", "plain words", "日日日", "𝒜𝒜𝒜", "é è", "x\u00a0a b\u00a0y", "a b", "aaa", "$t"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(60_000)]
    changed = lambda t: toxicity.restore(t, lambda s: s + "?") != t
    assert all(map(changed, texts[:5]))
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        found = set(toxicity._suspects(*textnum.utf8(pa.array(some))).tolist())
        assert not [t for k, t in enumerate(some) if k not in found and changed(t)]
    for t in texts[:3000]:
        alone = len(toxicity._suspects(*textnum.utf8(pa.array([t])))) == 1
        assert alone or not changed(t)
    assert len(toxicity._suspects(*textnum.utf8(pa.array(["plain words, été à la mer", "", None, "a boat. It is so", "x"])))) == 0


def test_url_filters(spark):
    rows = [(1, "http://A.Example.org/es/x", None), (2, "https://example.org/other", ""), (3, None, "x"), (4, "no scheme", None), (5, "http://x.com/de/1", '<link rel="canonical" href="http://alias.net/p">'), (6, "http://alias.net/p#f", None), (7, "http://x.com/fr/1", '<meta http-equiv="refresh" content="0; url=http://both.net/q">'), (8, "http://y.com/de/1", '<link rel=canonical href=http://both.net/q>'), (9, "http://both.net/q", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("u", F.lit(2))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.verdicts(pages).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("org/", "allow") and got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][3] == "block" and got[6][2:] == (None, "block") and got[9][2:] == (None, "allow") and got[7][3] == "allow" and got[8][3] == "block"
    assert url_filter.verdicts(pages.where("false")).count() == 0


def test_relative_targets(spark):
    """As the standard's own examples resolve them, and long urls."""
    base = "http://a/b/c/d;p?q"
    want = {"g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../g": "/g", "../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", "..g": "/b/c/..g", "./../g": "/b/g", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h"}
    d = spark.createDataFrame([(t,) for t in want], "to string")
    got = {r["to"]: r["p"] for r in d.select("to", url_filter.place(url_filter.resolved(F.col("to"), F.lit(base))).alias("p")).collect()}
    assert got == {t: "a" + p for t, p in want.items()}
    long = "http://x.com/de/" + "y/" * 200_000
    pages = spark.createDataFrame([(1, "http://q.net/x/", '<link rel="canonical" href="p">'), (2, "http://q.net/x/p", f'<link rel="canonical" href="{long}">'), (3, long, "t " * 300_000)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.verdicts(pages).collect()} == {1: "block", 2: "block", 3: "block"}


def test_pipeline(spark, docs, labels, benchmark, tmp_path):
    for name, t in (("documents", docs.select("doc_id", "text", "lang", "source", "n_chars")), ("labels", labels), ("benchmark", benchmark)):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["sequence_id", "doc_ids", "n_tokens", "ids"]
