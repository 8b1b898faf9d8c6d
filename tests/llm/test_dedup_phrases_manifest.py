"""Near-duplicate vectors, collocations and the manifest: beside plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacell.llm import collocations, embedding_dedup, merkle
from tests.llm.test_edge_cases import ROWS, _docs

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_links(rows, similar=0.93):
    """{vec_id: (links, smallest id)} over all pairs."""
    ids, n = [r[0] for r in rows], len(rows)
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label, root, links = np.array([r[2] for r in rows]), list(range(n)), [0] * n

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        hit = np.flatnonzero((u @ u[i] >= similar) & (label == label[i]))
        links[i] = len(hit) - 1
        for j in hit:
            a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
            root[b] = a
    return {ids[i]: (links[i], ids[find(i)]) for i in range(n)}


def near(rng, b, cosine):
    """A vector at a given cosine with ``b``, of any length."""
    b = b / np.linalg.norm(b)
    z = rng.normal(size=len(b))
    z -= z @ b * b
    return (cosine * b + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)) * rng.uniform(0.1, 10)


@pytest.fixture(scope="module")
def planted():
    """Pairs just above and below the threshold, copies, a large group of near copies, and a group as wide as the threshold."""
    rng, rows = np.random.default_rng(5), []
    for label in (1, 2):
        bases = rng.normal(size=(500, 64))
        rows += [(b, label) for b in bases]
        rows += [(near(rng, b, c), label) for b in bases[:80] for c in (0.925, 0.931, 0.94, 0.95)]
        rows += [(b * 3, label) for b in bases[80:90]] + [(bases[90], label)] * 5
        rows += [(near(rng, bases[91], c), label) for c in rng.uniform(0.975, 0.99, 300)] + [(near(rng, bases[92], c), label) for c in rng.uniform(0.85, 0.999, 200)]
    ids = rng.permutation(len(rows))
    return [(int(i), list(map(float, v)), label) for i, (v, label) in zip(ids, rows, strict=True)]


def test_near_vectors(spark, planted):
    d = spark.createDataFrame(planted, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(d).collect()}
    want = plain_links(planted)
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    found, all_links = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.995 * all_links and sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.98 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.recall(d, every=20) >= 0.98


def test_few_pivots(spark, planted):
    """Whatever the pivots, what links is found and nothing else is, only fewer or more candidates meet."""
    rows = planted[:400]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_links(rows)
    for pivots in (1, 2, 6):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(d, pivots=pivots).collect()}
        assert got == want or pivots > 2 and sum(got[i] != w for i, w in want.items()) <= 4


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, -0.0], 1), (3, [5.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1),
        (11, [1.0, None], 1), (12, [1.0, 0.0, 0.0], 1), (13, [1e-200, 0.0], 1), (14, [1e300, 1e300], 1), (14, [1e300, 1e300], 1), (None, [-1.0, 0.0], 1), (15, [-2.0, 0.0], 1), (None, None, None), (3, [0.0, 1.0], 3),
    ]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("unit", F.lit("x"))
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(d).collect())
    same = [(i, 3, 1, i == 1) for i in (1, 2, 3, 13)] + [(14, 1, 14, True)] * 2 + [(15, 1, 15, True), (None, 1, None, True), (None, 0, None, True), (3, 0, 3, True)]
    assert got == Counter(same + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)])
    assert embedding_dedup.near_duplicates(d.where("false")).count() == 0
    assert embedding_dedup.near_duplicates(d.withColumn("embedding", F.col("embedding").cast("array<float>")).where("vec_id < 4 and label = 1")).where("n_links = 2").count() == 3


def plain_phrases(rows, least, best):
    count, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for n in range(1, 5):
                count[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in cand.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, words[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:best])]
    return out


@pytest.mark.parametrize("sample", [1, 8, 1000])
def test_phrases(spark, sample):
    """Whatever the sample proposes: all texts, some, or hardly any."""
    rng = random.Random(2)
    vocabulary = ["a", "B", "b", "c", "ü", "日本", "x-y", "d"]
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("one", "fr")]
    for i in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!?"]) for _ in range(rng.randrange(120)))
        rows.append((text, rng.choice(["en", "en", "fr", None])))
    rows += [("Same words here. " * 500, "fr")] * 3 + [("clumped in one text only now " * 40, "en")]
    d = _docs(spark, [(i, t) for i, (t, _) in enumerate(rows)]).drop("lang").join(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, lang string"), "doc_id").repartition(3)
    got = collocations.collocations(d, best=60, sample=sample).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, 30, 60)) and len(got) > 80


def test_failing_border(spark):
    """A sample of nothing: every frequent word is a failure of the border, and the second pass finds all phrases."""
    d = _docs(spark, [(i, "p q r s t") for i in range(40)])
    assert collocations.frequent(d.select("doc_id", "text", "lang"), sample=10**9).count() == 5 + 4 + 3 + 2 + 1


def test_full_table_of_bits(spark, monkeypatch):
    """A table in which all bits are set lets more be counted, and changes nothing else."""
    d = _docs(spark, [(i, f"p q r s w{i} p q") for i in range(40)])
    want = sorted(map(tuple, collocations.collocations(d).collect()))
    monkeypatch.setattr(collocations, "has", lambda bits, h: np.ones(len(h), bool))
    assert sorted(map(tuple, collocations.collocations(d).collect())) == want and want


def test_odd_texts_have_phrases(spark):
    d = _docs(spark, ROWS)
    assert collocations.collocations(d).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(d.where("false")).count() == 0 and collocations.collocations(d.where("text is null")).count() == 0
    assert {r["lang"] for r in collocations.collocations(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_manifest(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h("".join(map(enc, r)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)

    def climb(hashes):
        """The root, and for each leaf its siblings (left, right) level by level."""
        ways, place = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for way, p in zip(ways, place, strict=True):
                run = p // 8 * 8
                way.append((hashes[run:p], hashes[p + 1 : run + 8]))
            place = [p // 8 for p in place]
            hashes = [h("".join(hashes[i : i + 8])) for i in range(0, len(hashes), 8)]
        return hashes[0], ways

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *climb([leaf(r) for r in own]))
    root, above = climb([trees[x][1] for x in langs]) if langs else (None, [])
    out = []
    for lang, up in zip(langs, above, strict=True):
        own, subroot, ways = trees[lang]
        for r, way in zip(own, ways, strict=True):
            way = way + up
            spoilt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((*r[:4], r[4].translate(FOLD) if r[4] is not None else None)) if spoilt else leaf(r)
            for left, right in way:
                now = h("".join([*left, now, *right]))
            out.append((r[0], leaf(r), subroot, root, h("".join(x for left, right in way for x in left + right)), now, now == root))
    return Counter(out)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [0, 1, 9, 65, 600])
def test_manifest(spark, n):
    """Trees of all heights, lone leaves, a language without a name, rows that repeat, ids that are missing or repeat."""
    rng = random.Random(n)
    rows = [(i, rng.choice(["web", None, "böö"]), "en", rng.choice([3, None]), rng.choice([None, "", "Ab", "ab", "Größe"])) for i in range(n)]
    if n > 2:
        rows += [(3 * i, "web", None, 1, "X") for i in range(n // 3)] + [(1, None, "only", None, "X")] + [(7, "s", "", 1, "T")] * 11 + [(None, "s", "en", 1, "T")] * 3 + [(5, "s", "en", 1, f"T{k}") for k in range(4)]
        rows += [(k, "s", f"l{k}", 1, "Q") for k in range(n // 5)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, SCHEMA).withColumn("hash", F.lit("x")).withColumn("rank", F.lit(1)).repartition(4)
    assert Counter(map(tuple, merkle.verified(merkle.manifest(d)).collect())) == plain_manifest(rows)
