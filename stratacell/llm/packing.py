"""Best-fit packing of tokenised documents by hierarchical residual packing.

Documents become token pieces of at most ``limit`` tokens. Each task packs what
it tokenises best-fit, in lots of bounded size (longest piece first, each into
the fullest bin that takes it). Bins within ``slack`` tokens of full are
finished where they are; the others rise as items to the next level, where lots
meet and are packed again. A level's map from bin to bin is small, and the maps
are composed from the top. Only bins that rose take part in the last join, so
the pieces of finished ones are never shuffled.

Defined results: a null or empty text is one piece that holds the end token
alone. Repeated rows are separate documents: each gives its own pieces. Texts of
any length and content are taken whole. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textnum import slices

LIMIT = 2048
END = 0
#: Pieces, and tokens, that are packed at once on the first level; bins at once on later ones.
PER_LOT, LOT_TOKENS = 20_000, 16 << 20
#: Tokens of the pieces that leave a task in one batch, at least.
BATCH_TOKENS = 1 << 18
SLACK = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, place long, fill long"
TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


@lru_cache(2)
def encoder(tokenizer: str):
    """An encoder of the byte-level BPE file ``tokenizer``: its vocabulary in id order gives the merge ranks."""
    import public_tokenizers
    import tiktoken

    spec = json.load(open(tokenizer, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(2)
def slow_encoder(tokenizer: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def token_ids(text: str, tokenizer: str) -> np.ndarray:
    """The ids that tokenizers gives."""
    try:
        return encoder(tokenizer).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its pattern gives up on a million white-space characters in a row
        return np.array(slow_encoder(tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)


def lot_batches(rows: list[tuple], base: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a lot, packed together; they leave in batches of bounded size."""
    length = np.array([r[3] for r in rows], np.int64)
    bins, place, fill = best_fit(length, limit)
    ends = np.cumsum(length)
    at = 0
    while at < len(rows):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_TOKENS)) + 1
        cols = [*zip(*rows[at:to], strict=True), base + bins[at:to], place[at:to], fill[bins[at:to]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
        at = to


def local_bins(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, per_lot: int = PER_LOT, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs``, each with its bin of the first level, its place there and the bin's fill. ``ids`` holds
    little-endian unsigned 32-bit numbers, null unless ``with_ids``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, rows, tokens = TaskContext.get().partitionId() << 36, [], 0
        for batch in slices(batches, "text", 1 << 20):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", tokenizer).astype("<u4"), np.uint32(end))
                first = len(ids) % limit or limit
                for piece, to in enumerate(range(first, len(ids) + 1, limit)):
                    start = max(0, to - limit)
                    part = ids[start:to].tobytes()
                    rows.append((doc, piece, start, to - start, zlib.crc32(part), part if with_ids else None))
                    tokens += to - start
                    if len(rows) >= per_lot or tokens >= LOT_TOKENS:
                        yield from lot_batches(rows, base, limit)
                        base, rows, tokens = base + len(rows), [], 0
        if rows:
            yield from lot_batches(rows, base, limit)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: best-fit, longest first."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    free: dict[int, list[int]] = {}  # by room left
    rooms = 0  # bit r is set where some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), limit
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room - n:
            free.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def risen(open_bins: DataFrame, limit: int = LIMIT, slack: int = SLACK, per_lot: int = PER_LOT) -> DataFrame | None:
    """(child, top, shift): the bin in which each open bin ends and its place there. ``open_bins``: (child, length), stored."""
    maps, lots, count = [], 0, open_bins.count()

    def pack(level: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            b, place, fill = best_fit(part["length"].to_numpy(np.int64), limit)
            return part[["child", "length"]].assign(bin=(level << 58) + (int(part["lot"].iloc[0]) << 24) + b, place=place, fill=fill[b])

        return run

    while count:
        before, lots = lots, -(-count // per_lot)
        if before and lots >= before:
            break  # what is left does not fit together any better
        # dealt by content, so that a retried task finds the same lots
        dealt = open_bins.withColumn("lot", F.pmod(F.xxhash64("child"), F.lit(lots)))
        level = dealt.groupBy("lot").applyInPandas(pack(len(maps) + 1), "child long, length long, bin long, place long, fill long")
        level = stored(level, "level")
        maps.append(level.select("child", F.col("bin").alias("top"), F.col("place").alias("shift")))
        if lots == 1:
            break
        open_bins = level.where((F.col("place") == 0) & (F.col("fill") < limit - slack)).select(F.col("bin").alias("child"), F.col("fill").alias("length"))
        count = open_bins.count()
    whole = None
    for m in reversed(maps):
        if whole is not None:
            up = whole.select(F.col("child").alias("top"), F.col("top").alias("top2"), F.col("shift").alias("shift2"))
            m = m.join(up, "top", "left").select(
                "child", F.coalesce("top2", "top").alias("top"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift")
            )
        whole = m
    return stored(whole, "bins") if whole is not None else None


def packed(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END, slack: int = SLACK, per_lot: int = PER_LOT, with_ids: bool = False) -> DataFrame:
    """Where each piece of ``docs`` lies, with the CRC-32 of its ids, and the ids themselves if asked for."""
    import public_tokenizers

    local = stored(local_bins(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), limit, end, per_lot, with_ids), "pieces")
    is_open = F.col("fill") < limit - slack
    whole = risen(local.where(is_open & (F.col("place") == 0)).select(F.col("bin").alias("child"), F.col("fill").alias("length")), limit, slack, per_lot)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    out = local.select(*kept, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"), is_open.alias("is_open"))
    if whole is None:
        return out.drop("is_open")
    moved = out.where("is_open").join(whole, F.col("sequence_id") == F.col("child")).select(*kept, F.col("top").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return out.where("not is_open").drop("is_open").unionByName(moved)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed training sequences: (sequence_id, doc_ids, n_tokens, ids). ``doc_ids`` names the document of each piece in
    order; ``ids`` are at most ``limit`` little-endian unsigned 32-bit numbers, so a row is bounded."""
    rows = packed(docs, with_ids=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence has at most ``limit`` pieces
    return rows.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", F.col("p.doc_id").alias("doc_ids"), "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
