"""Operators beside plain Python on the small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stratacell.llm import lm, near_dedup, packing, quality_model, queries, toxicity, url_filter, warc
from tests.conftest import same_as_duckdb

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same_as_duckdb(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_redirects_same_as_sql(spark, tmp_path):
    """Chains, rings and stars of canonical links and redirects, which the given pages do not have."""
    rng = random.Random(9)
    hosts = ["a.com", "B.com", "x.example.org", "c.net", "d.net:80", "e.info"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/de/', '/fr/', '/es/', '/p/'])}{rng.randrange(9)}{rng.choice(['', '?q=1&r=2', '#top'])}"
    rows = []
    for i in range(240):
        k = rng.randrange(9)
        kinds = [None, None, url(), url().split(":", 1)[1], f"/p/{k}", f"{k}", f"../p/{k}", f"./{k}", f"/de/./x/../../p/{k}", "?q=1&r=2", "#top", "mailto:x", "../../..", "."]
        html = None
        for to in rng.choices(kinds, k=rng.choice([1, 1, 2])):
            if to:
                to = to.replace("&", "&amp;")
                html = (html or "") + rng.choice([f'<head><link href="{to}" rel="canonical"></head>', f"<LINK rel=canonical href='{to}'>", f'<meta http-equiv="refresh" content="0; url={to}">'])
        rows.append((i, rng.choice([None, "no scheme", *[url()] * 8]), html))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    got = queries.QUERIES["op10_url_filters"]
    df = got(spark, _as_files(tmp_path))
    same_as_duckdb(df, queries.ORACLE_SQL["op10_url_filters"], str(tmp_path))
    said = Counter((r["rule"] is None, r["verdict"]) for r in df.collect())
    assert said[True, "block"] and said[True, "allow"]


def test_overlaps_same_as_sql(spark, tmp_path):
    """Substitutions anywhere in windows of 13, items shorter than a window, items and documents without ids, at either end of a text."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(400)}"
    items = [[word() for _ in range(n)] for n in (13, 13, 20, 40, 2, 5, 9, 12, 1, 13)]
    bench = [(None if k in (1, 5) else k, " ".join(w)) for k, w in enumerate(items)] + [(3, " ".join(items[0][::-1])), (77, " ".join(items[2]).upper()), (8, None), (9, "")]
    docs = [(0, None), (1, ""), (2, "  ")]
    for k in range(220):
        w = list(items[rng.randrange(len(items))])
        for at in rng.sample(range(len(w)), min(len(w), rng.choice([0, 1, 2, 2, 3]))):
            w[at] = f"x{rng.randrange(9)}"
        docs.append((k + 3 if k % 10 else None, " ".join([word() for _ in range(rng.choice([0, 3, 30]))] + w + [word() for _ in range(rng.choice([0, 3, 30]))])))
    w = list(items[0])
    w[3] = w[9] = "other"
    docs.append((990, " ".join(["a", "b", *w, "c"])))
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "b"))
    import pyarrow.parquet as pq

    for short, name in (("d", "documents"), ("b", "benchmark")):
        pq.write_table(pq.read_table(tmp_path / short), tmp_path / f"{name}.parquet")
    df = queries.QUERIES["op4_benchmark_decontamination"](spark, str(tmp_path))
    same_as_duckdb(df, queries.ORACLE_SQL["op4_benchmark_decontamination"], str(tmp_path))
    assert df.where("doc_id = 990 and contaminated").count() == 1 and 100 < df.where("contaminated").count() < 223


def test_links_as_html_has_them(spark, tmp_path):
    """How attributes, comments, scripts, character references and refreshes are spelt; each page alone aims at a blocked place."""
    to = "http://x.com/de/{}"
    shapes = {  # by whether there is a link
        True: [
            'rel = "canonical" href = "{}"', "rel='alternate  Canonical' href='{}'", "data-href='http://y.net/' rel=canonical href={}", 'title="a > b" rel=canonical href="{}"', 'href="{}" href="http://y.net/" rel=canonical', 'rel=canonical href=" {} "',
            'rel=canonical href="http&#x3A;&#47;/x.com&#x2F;de&#x2f;{n}"', 'rel="can&#111;nical" href="{}"', "\nrel=canonical\n/ href='{}'\n",
        ],
        False: ['rel=canonicalish href="{}"', 'rel="canonical-x y" href="{}"', 'rel=canonical data-href="{}"', 'rel=next href="{}"', "title='rel=canonical' href='{}'", 'rel=canonical href="http&colon;//x.com/de/{n}"', 'rel=canonical href=""'],
    }
    pages, want = [], {}

    def add(html, linked):
        pages.append((len(pages), f"http://p{len(pages)}.net/a/b", html))
        want[pages[-1][0]] = "block" if linked else "allow"

    for linked, forms in shapes.items():
        for form in forms:
            n = len(pages)
            add(f"<head><link {form.replace('{n}', str(n)).replace('{}', to.format(n))}></head>", linked)
    for content, linked in (("0;{}", True), ("0; url = '{}'", True), ("3 , URL={}", True), ("1.5 {}", True), ("0", False), ("url={}", False), (";{}", False)):
        add(f'<META content="{content.format(to.format(len(pages)))}" HTTP-EQUIV=" Refresh ">', linked)
    for around, linked in (("<!-- {} -->", False), ("<!-- {}", False), ("<!-- > --> {}", True), ("<script>'{}'</script>", False), ("<style a=b>{}</style >", False), ("<script></script>{}", True), ("<scripted>{}</scripted>", True), ("<LINK/REL=x><b>{}</b>", True)):
        add(around.format(f"<link rel=canonical href={to.format(len(pages))}>"), linked)
    add("<base target=x><base href='//X.com/de/sub/'><base href='http://y.net/'><link rel=canonical href=z>", True)
    add("<base href='http://y.net/de/'><link rel=canonical href=z>", False)
    add('<link rel=canonical href="http://x.com/d&#101;/&#0;&#xD800;&#99999999;&amp;lt;">', True)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.verdicts(df).collect()} == want
    found = {r["v"] for r in url_filter.links(df).where(f"u = 'p{len(pages) - 1}.net/a/b'").collect()}
    assert found == {"x.com/de/���&lt;"}
    df.where(f"page_id < {len(pages) - 1}").write.parquet(str(tmp_path / "pages"))
    same_as_duckdb(queries.QUERIES["op10_url_filters"](spark, _as_files(tmp_path)), queries.ORACLE_SQL["op10_url_filters"], str(tmp_path))


def _as_files(path):
    """One Parquet file named like the table, as the given ones are."""
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(path / "pages"), path / "pages.parquet")
    return str(path)


def components(docs, similar=85):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    both = Counter(p for ids in where.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in both.items():
        if 100 * n >= similar * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op5_minhash_near_dedup"](spark, SF).collect()}
    assert got == components(docs)


def test_copies_of_copies(spark):
    """Many copies of one text, changed more and more: chains join, and texts that drifted apart do not."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = {}
    for i in range(160):
        w = list(base)
        for p in rng.sample(range(150), rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            w[p] = f"n{i}.{p}"
        rows[i] = " ".join(w)
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for similar in (85, 80):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(d, similar).collect()}
        assert got == components(rows, similar)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    for i, g in rows.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        ids = np.array([*t.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        assert list(g["piece"]) == list(range(len(g))) and g["length"].sum() == len(ids) and (g["length"].iloc[1:] == 2048).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)] == list(g["ids_crc32"])
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= math.ceil(rows["length"].sum() / 2048) + 2


def test_packing_in_levels(spark):
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 300), rng.randint(300, 2047), 0]) for _ in range(4000)]
    d = spark.createDataFrame([(i, " a" * n) for i, n in enumerate(lengths)], "doc_id long, text string").repartition(13)
    rows = packing.packed(d, per_lot=150).toPandas()
    assert len(rows) == 4000 and sorted(rows["length"]) == sorted(n + 1 for n in lengths) and rows["sequence_id"].nunique() <= 1.02 * (sum(lengths) + 4000) / 2048
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048


def test_token_ids():
    """Equal to those of tokenizers: for its special token, any mix of characters, and white space longer than the fast encoder takes."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = ["a<|endoftext|> b  \n\n x's 日本", "", " " * 2_000_000, "x" + " \n\t" * 500_000 + "y", "\n" * 1_100_000 + "'ll"]
    kinds = [[chr(c) for c in range(32, 127)], [" ", "\n", "\t", "\r", "\u00a0", "\u2003", "\u3000", "\u0085"], [*"'sdtmé日本ж٣Ⅷ½_-\u0301\U0001d49c\U0001f600"], [chr(rng.randrange(0x110000)) for _ in range(300)]]
    for _ in range(3000):
        texts.append("".join(c for _ in range(rng.randrange(12)) for c in rng.choices(rng.choice(kinds), k=rng.randrange(6)) if not 0xD800 <= ord(c) < 0xE000))
    for t in texts:
        assert packing.token_ids(t, path).tolist() == slow.encode(t, add_special_tokens=False).ids


def language_model(docs, shards):
    """(n_tokens, n_known, train tokens, base score, score) of each text, by plain counting."""
    end = "\0"
    words = {i: [*WORD.findall(t.translate(FOLD)), end] for i, t in docs.items()}
    c, pairs, triples, kinds, kinds3 = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
            pairs.update(zip([end, *w], w, strict=False))
            triples.update(zip([end, *w], w, w[1:], strict=False))
    for a, _ in pairs:
        kinds[a] += 1
    for *ab, _ in triples:
        kinds3[tuple(ab)] += 1
    n, v = sum(c.values()), len(c)
    hot = {w for w in c if c[w] * shards > n}

    def second(a, w):
        q = (c[w] + 0.1) / (n + 0.1 * (v + 1))
        if a in hot:
            return (pairs[a, w] + lm.PRIOR * q) / (c[a] + lm.PRIOR)
        return q if not c[a] else max(pairs[a, w] - lm.DISCOUNT, 0) / c[a] + lm.DISCOUNT * kinds[a] / c[a] * q

    def third(a, b, w):
        q, seen = second(b, w), pairs[a, b]
        if a in hot and b in hot:
            return (triples[a, b, w] + lm.PRIOR * q) / (seen + lm.PRIOR)
        return q if not seen else max(triples[a, b, w] - lm.DISCOUNT, 0) / seen + lm.DISCOUNT * kinds3[a, b] / seen * q

    out = {}
    for i, w in words.items():
        s = [second(end, w[0]), *(third(a, b, x) for a, b, x in zip([end, *w], w, w[1:], strict=False))]
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(map(math.log10, s)))
    return out, len(hot)


@pytest.mark.parametrize("shards", [None, 3000])
def test_language_model(spark, docs, shards):
    """With many shards, many words are too frequent for one and are spread."""
    want, hot = language_model(docs, shards or 12)
    assert not shards or hot > 50
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op8_lm_scoring"](spark, SF) if not shards else lm.scored(d, shards)
    for r in rows.collect():
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3], abs=1e-6) and r["score"] == pytest.approx(w[4], abs=4e-4 * w[0])
        assert shards or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 77, 3000, 70_000):
        for most in (1, 40, 1 << 17, 1 << 40, (1 << 64) - 1):
            v = np.sort(rng.integers(0, most, n, dtype=np.uint64, endpoint=True))
            level = lm.Level(v)
            q = np.r_[v, v + np.uint64(1), rng.integers(0, most, 50, dtype=np.uint64, endpoint=True), np.uint64(0), np.uint64((1 << 64) - 1)]
            at = np.searchsorted(v, q)
            assert (level.successor(q) == at).all() and (level[np.arange(len(v))] == v).all()
            there = np.isin(q, v)
            assert (level.find(q) == np.where(there, at, -1)).all()
            assert n < 3000 or level.bytes < n * ((most // n).bit_length() + 4) / 8 + 200


def test_loser_tree():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted((rng.randrange(30),) for _ in range(rng.randrange(7))) for _ in range(k)]
        assert list(warc.merge([iter(r) for r in runs])) == sorted(itertools.chain(*runs))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, column, least in (("op1_quality_classifier", "quality", 0.98), ("op9_toxicity", "toxic", 0.95)):
        rows = [(r["predicted"], labels[r["doc_id"]][column]) for r in queries.QUERIES[name](spark, sf).where("held_out").collect() if r["doc_id"] in labels]
        assert sum(a == b for a, b in rows) / len(rows) > least


def test_isotonic_and_viterbi():
    assert quality_model.isotonic(np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 1.0]
    assert [len(x) for x in toxicity.lattice("1d1ot")] == [3, 1, 3, 1, 1]


def test_pipeline_rows(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048 for r in rows)


def _chars(text: str) -> toxicity.Chars:
    letters = toxicity._letters(text)
    return toxicity.Chars(toxicity._trigrams(text), "".join(sorted(set(letters) | {" ", toxicity.OTHER})))


def test_long_stretches_are_read():
    reader = toxicity.Reader(_chars("they hate the very idea of it"))
    assert toxicity.restore("so " + "h 4 t e ".replace("4", "a") * 30 + "end", reader.read) == "so " + "hate" * 30 + " end"
    for odd in ("ab" * 50_000, "@$" * 50_000 + "x", "s p a m " * 10_000 + "x", "a" * 200_000):
        assert toxicity.restore(odd, reader.read)


def test_character_model_adds_up():
    chars = _chars("the quick brown fox, the lazy dog. Été!")
    for context in ("th", "he", "  ", "zz", " \ufffd", "qu"):
        assert sum(math.exp(chars.after(context, c)) for c in chars.alphabet) == pytest.approx(1)


def test_viterbi_is_the_best_of_all_readings():
    rng = random.Random(3)
    chars = _chars("you are an idiot and a total loser who is stupid and silly, all of you, good books too")

    def likelihood(parts) -> float:
        q, end = 0.0, "  "
        for text, cost in parts:
            q += cost
            for c in text:
                if c.isalpha() or c == " ":
                    k = chars.known(c)
                    q, end = q + chars.after(end, k), (end + k)[1:]
                else:
                    end = "  "
        return q

    for _ in range(300):
        stretch = rng.choice("abdeilost") + "".join(rng.choice("abdeilostu0134@$!|*sseell") for _ in range(rng.randrange(1, 6))) + rng.choice("abdeilost")
        every = [(likelihood([*parts, (" ", 0.0)]), "".join(t for t, _ in parts)) for parts in itertools.product(*toxicity.lattice(stretch))]
        best = max(q for q, _ in every)
        assert toxicity.decode(stretch, chars) in {t for q, t in every if q > best - 1e-9}, stretch


def _plain_statistics(text: str) -> list[float]:
    """The classifier's statistics of one text, counted one by one."""
    data = text.encode()
    w = WORD.findall(text)
    raw = [x.encode() for x in w]
    low = [x.translate(FOLD) for x in w]
    lines = [x for x in text.split("\n") if x]
    three = [tuple(low[i : i + 3]) for i in range(len(low) - 2)]
    n, b = max(len(w), 1), max(len(data), 1)
    kinds = [sum(c in k for c in data) for k in (range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!", b".,;:", b"\n", range(192, 256), b"?\"'()-")]
    sizes = [len(x) for x in raw]
    mean = sum(sizes) / n
    share = lambda k, of=None: k / max(n if of is None else of, 1)
    return [
        math.log1p(len(w)), math.log1p(len(lines)), mean, math.sqrt(max(sum(x * x for x in sizes) / n - mean**2, 0)), share(sum(x <= 3 for x in sizes)), share(sum(x > 12 for x in sizes)),
        share(sum(x == 1 for x in sizes)), share(len(set(low))), share(sum(x == y for x, y in itertools.pairwise(low))), share(len(three) - len(set(three)), len(three)),
        share(len(lines) - len(set(lines)), len(lines)), share(sum(65 <= x[0] < 91 for x in raw)), share(sum(x[-1] in b".,;:" for x in raw)), kinds[3] / n, kinds[4] / n, *[k / b for k in kinds],
    ]


def test_statistics(docs):
    texts = ["", "a", " \n", "A b a b a b.\n\nA b a b a b.\nÉté! (no) #1", *list(docs.values())[:120]]
    got = quality_model.statistics(pa.array([*texts, None]))
    want = np.array([*map(_plain_statistics, texts), _plain_statistics("")])
    assert np.abs(got - want).max() < 2e-3 and np.abs(got - want).mean() < 1e-5
