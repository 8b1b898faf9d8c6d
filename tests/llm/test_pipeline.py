"""Each stage of the pipeline beside a plain computation of what it should keep, on the very rows that it is given."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from stratacell.llm import decontam, quality_model, quality_rules
from tests.llm.test_against_brute_force import components

SF = "/root/testdata/sf0.001"


def _sql(sql: str, documents: str) -> list[dict]:
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{documents}/*.parquet'")
    c.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    return c.execute(sql).df().to_dict("records")


def _isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The max-min formula."""
    s, w = np.r_[0, np.cumsum(y * n)], np.r_[0, np.cumsum(n)]
    mean = lambda a, b: (s[b + 1] - s[a]) / (w[b + 1] - w[a])
    return np.array([max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))])


def _good(docs: dict[int, str], labels: dict[int, int]) -> set[int]:
    """Documents that a ridge regression on all rows at once, calibrated, accepts."""
    ids = sorted(docs)
    x = quality_model.statistics(pa.array([docs[i] for i in ids])).astype(float)
    train = np.array([i in labels and zlib.crc32(str(i).encode()) % 4 != 2 for i in ids])
    y = np.array([float(labels[i]) for i, t in zip(ids, train, strict=True) if t])
    scale = x[train].std(axis=0)
    rng, k = np.random.default_rng(7), quality_model.COSINES
    z = np.clip((x - x[train].mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -4, 4) @ rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], k))
    z = np.column_stack([np.cos(z + rng.uniform(0, 2 * np.pi, k)) * np.sqrt(2 / k), np.ones(len(x))])
    # ridge as least squares on rows added for the penalty
    penalty = np.sqrt(quality_model.RIDGE * len(y) / k) * np.eye(k + 1)
    beta = np.linalg.lstsq(np.vstack([z[train], penalty]), np.r_[y, np.zeros(k + 1)], rcond=None)[0]
    raw = np.clip(z @ beta, -0.5, 1.5)
    step = np.round((raw + 0.5) / 2 * quality_model.GRID)
    steps = np.unique(step[train])
    at = [step[train] == s for s in steps]
    fitted = np.interp(raw, steps / quality_model.GRID * 2 - 0.5, _isotonic(np.array([y[a].mean() for a in at]), np.array([a.sum() for a in at])))
    score = np.clip(0.999 * fitted + 0.001 * (raw + 0.5) / 2, 0, 1)
    return {i for i, s in zip(ids, score, strict=True) if s >= quality_model.ACCEPT}


def test_each_stage(spark, tmp_path):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    path = str(tmp_path / "documents")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(path)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        given = spark.read.parquet(path)
        docs = {r["doc_id"]: r["text"] or "" for r in given.collect()}
        sizes.append(len(docs))
        if name == "quality_rules":
            want = {r["doc_id"] for r in _sql(quality_rules.SQL, path) if r["kept"]}
        elif name == "quality_classifier":
            want = _good(docs, labels)
        elif name == "near_dedup":
            want = {i for i, (_, root) in components(docs, 80).items() if i == root}
        elif name == "decontamination":
            want = {r["doc_id"] for r in _sql(decontam.SQL, path) if not r["contaminated"]}
        else:
            want = set(docs)
        path = str(tmp_path / name)
        stage(spark, given, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == want, name
            assert out.columns == given.columns
            assert {r["doc_id"]: r["text"] or "" for r in out.collect()} == {i: docs[i] for i in want}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    _packed_whole(docs, out.collect())
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(d for r in run for d in r["doc_ids"]) == sorted(d for r in out.collect() for d in r["doc_ids"])
    _packed_whole(docs, run)


def _packed_whole(docs: dict[int, str], sequences: list) -> None:
    """Every token of every document stands in one sequence, in pieces cut as the contract says; and the sequences decode to the texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = {}
    for i, text in docs.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        left[i] = [ids[max(0, to - 2048) : to].tobytes() for to in range(first, len(ids) + 1, 2048)]
        assert t.decode(ids[:-1].tolist()) == text
    for r in sequences:
        at = 0
        for i in r["doc_ids"]:
            piece = next(p for p in left[i] if r["ids"][at : at + len(p)] == p)
            left[i].remove(piece)
            at += len(piece)
        assert at == len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048
    assert not any(left.values())
