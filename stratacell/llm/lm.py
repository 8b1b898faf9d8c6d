"""Language-model scores from an Elias-Fano n-gram trie spread over shards.

Texts become batches of token numbers with the batch's own sorted vocabulary of
64-bit word hashes. Each batch asks the shards for what it needs: its words, and
its word pairs and triples, each with its count in the batch's training texts. A
shard adds up the counts of all batches, so a batch's question is also its
contribution, and answers in the order of the question.

A shard's trie has three levels: words as contexts, their successors relative to
the word's place, and the successors of each pair relative to the pair's place.
Places, pointers and successors are Elias-Fano sequences in mapped memory (their
high parts as bits with a count for each 64, their low parts packed to the bit),
beside 16-bit probabilities on a logarithmic scale. An n-gram is found by
successor search in its context's range, which reads only the words of the
sequence that it needs. The mapping is anonymous, as the shared folder may be a
store that cannot be mapped.

The probability is interpolated absolute discounting over words, pairs and
triples, ``max(c(u, v, w) - D, 0) / c(u, v) + D * kinds(u, v) / c(u, v) * p(w | v)``
and likewise for pairs, down to the contract's smoothed unigram. The first word
of a text follows the end token alone. A word with more than a shard's share of
all tokens is spread over all shards by its successors, and so is a pair of two
such words; these contexts have ``(c(u, v, w) + S * p(w | v)) / (c(u, v) + S)``,
for which no shard needs to know all successors.

Nothing is pruned, and the shards' number follows the corpus, so no task or
broadcast grows with it. The driver holds totals, and the words that have more
than a shard's share: fewer than one for each shard, found by a filter on the
counts. A row goes from a batch to each shard that it has n-grams for, so there
are never more rows than distinct n-grams of all batches.

Defined results: a null or empty text is the end token alone. A null id scores
but is not learnt from (``held_out`` null). Without training tokens all
probabilities are those of the smoothed unigram. Repeated rows count and score
one by one. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text_crc, stored
from .textnum import GOLD, U, hashes, mix, slices, spans, utf8

#: Discount of counts, and tokens of prior in contexts that are spread.
DISCOUNT, PRIOR = 0.9, 4.0
#: Bytes of text of a batch, about; words and tokens of a shard, about.
BATCH_BYTES, SHARD_WORDS, SHARD_TOKENS = 8 << 20, 1 << 21, 3 << 19
END = U(0x1234567890ABCDE1)
#: Bits of a successor's hash within its context, and steps of a probability's logarithm.
CHILD_BITS = 32
STEPS = 65535 / 16
ONE = U(1)


class Level:
    """A non-decreasing sequence of 64-bit numbers in Elias-Fano form."""

    def __init__(self, values: np.ndarray) -> None:
        n = self.n = len(values)
        top = int(values[-1]) if n else 0
        self.width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        w = U(self.width)
        self.most = top >> self.width  # the largest high part
        bits = np.zeros(-(-(n + self.most + 1) // 64) * 64, np.uint8)
        bits[(values >> w).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        low = np.zeros(-(-n * self.width // 8) + 8, np.uint8)
        for at in range(0, n, 1 << 16):  # a multiple of 8 elements ends on a byte
            part = (values[at : at + (1 << 16)] & ((ONE << w) - ONE)).astype("<u8").view(np.uint8).reshape(-1, 8)
            packed = np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, : self.width].ravel(), bitorder="little")
            low[at * self.width // 8 :][: len(packed)] = packed
        ones = np.bitwise_count(high.view("<u8"))
        before = np.r_[0, np.cumsum(64 - ones.astype(np.int64))[:-1]].astype("<u4")  # zeros before each 64 bits
        parts = [high, before.view(np.uint8), low]
        self.bytes = sum(len(p) for p in parts)
        self.buffer = mmap.mmap(-1, self.bytes)
        self.buffer.write(b"".join(p.tobytes() for p in parts))
        mapped = np.frombuffer(self.buffer, np.uint8)
        self.high = mapped[: len(high)].view("<u8")
        self.zeros = mapped[len(high) :][: 4 * len(self.high)].view("<u4")
        # 64 bits from any byte on
        self.low = np.ndarray((len(low) - 7,), "<u8", self.buffer, len(high) + 4 * len(self.high), (1,))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(U)) & ((ONE << U(self.width)) - ONE)

    @staticmethod
    def _in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the bit number ``k`` that is set, in each 64 bits."""
        k, place = k.astype(np.uint8), np.zeros(len(x), np.uint8)
        for step in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(x & ((ONE << U(step)) - ONE))
            right = k >= n
            k = np.where(right, k - n, k)
            x = np.where(right, x >> U(step), x)
            place += right * np.uint8(step)
        return place

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of zero number ``k`` of the high bits."""
        at = np.searchsorted(self.zeros, k.astype("<u4"), "right") - 1
        return at * 64 + self._in_word(~self.high[at], k - self.zeros[at])

    def _start(self, h: np.ndarray) -> np.ndarray:
        """The first element whose high part is ``h`` or more."""
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        out[some] = self._zero(h[some] - 1) - (h[some] - 1)
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        at = np.searchsorted(ones, i, "right") - 1
        place = at * 64 + self._in_word(self.high[at], i - ones[at])
        return ((place - i).astype(U) << U(self.width)) | self._low(i)

    def successor(self, q: np.ndarray) -> np.ndarray:
        """For each value, the place of the first element that is not less (``n`` if there is none)."""
        high = q >> U(self.width)
        beyond = high > U(self.most)
        h = np.where(beyond, U(self.most), high).astype(np.int64)
        at, end = self._start(h), np.full(len(q), self.n)
        inner = np.flatnonzero(h < self.most)
        end[inner] = self._start(h[inner] + 1)
        at[beyond] = self.n
        end[beyond] = self.n
        low = q & ((ONE << U(self.width)) - ONE)
        todo = np.flatnonzero(at < end)
        while len(todo):  # by halves, where several elements share a high part
            mid = (at[todo] + end[todo]) >> 1
            less = self._low(mid) < low[todo]
            at[todo[less]] = mid[less] + 1
            end[todo[~less]] = mid[~less]
            todo = todo[at[todo] < end[todo]]
        return at

    def find(self, q: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is absent."""
        at = self.successor(q)
        there = np.flatnonzero(at < self.n)
        there = there[self._low(at[there]) == q[there] & ((ONE << U(self.width)) - ONE)]
        # an equal low part is an equal value if the high part is the same, and so if the element is not of a later one
        first = self._start((q[there] >> U(self.width)).astype(np.int64) + 1) if len(there) else there
        out = np.full(len(q), -1)
        ok = there[at[there] < first]
        out[ok] = at[ok]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes from 1; 0 is kept for what is absent."""
    return np.clip(np.round((np.log10(np.maximum(p, 1e-16)) + 16) * STEPS), 1, 65535).astype("<u2")


def value(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10 ** (code / STEPS - 16), 0.0)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts."""
    order = np.argsort(key, kind="stable")  # a merge of sorted runs
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


class Trie:
    """``asked``: for each question its contexts, how many successors each has, those, their counts, how many successors
    each of them has, those, their counts. ``tokens``: of all training texts."""

    def __init__(self, asked: list[tuple[np.ndarray, ...]], tokens: int) -> None:
        cat = lambda rows, dtype: np.concatenate([*rows, np.zeros(0, dtype)])
        learnt = []
        for context, n, _, count, *_ in asked:
            seen = np.r_[0, np.cumsum(count > 0)]
            ends = np.cumsum(n, dtype=np.int64)
            learnt.append(context[seen[ends] > seen[ends - n]])
        own = np.unique(cat(learnt, U))
        self.contexts = Level(own)
        keys, counts = [], []
        for context, n, child, count, *_ in asked:
            seen = count > 0
            keys.append((np.repeat(np.searchsorted(own, context).astype(U), n)[seen] << U(CHILD_BITS)) | child[seen].astype(U))
            counts.append(count[seen].astype(np.int64))
        key, count = _summed(cat(keys, U), cat(counts, np.int64))
        rank = (key >> U(CHILD_BITS)).astype(np.int64)
        kinds, total = np.bincount(rank, minlength=len(own)), np.bincount(rank, count, len(own))
        self.children, self.pointers = Level(key), Level(np.r_[0, np.cumsum(kinds)].astype(U))
        spread = (own & ONE).astype(bool)
        self.alpha = quantise(np.where(spread[rank], count / max(tokens, 1), (count - DISCOUNT) / total[rank]))
        self.gamma = np.where(spread, 0, quantise(DISCOUNT * kinds / np.maximum(total, 1))).astype("<u2")

        self.places = [self.find(*q[:3]) for q in asked]
        keys, counts = [], []
        for (*_, m, child, count), (_, place) in zip(asked, self.places, strict=True):
            seen = count > 0
            keys.append((np.repeat(place, m)[seen].astype(U) << U(CHILD_BITS)) | child[seen].astype(U))
            counts.append(count[seen].astype(np.int64))
        key, count = _summed(cat(keys, U), cat(counts, np.int64))
        rank = (key >> U(CHILD_BITS)).astype(np.int64)
        kinds, total = np.bincount(rank, minlength=self.children.n), np.bincount(rank, count, self.children.n)
        self.thirds, self.third_pointers = Level(key), Level(np.r_[0, np.cumsum(kinds)].astype(U))
        self.third_alpha = quantise((count - DISCOUNT) / total[rank])
        self.third_gamma = np.where(kinds > 0, quantise(DISCOUNT * kinds / np.maximum(total, 1)), 0).astype("<u2")

    @staticmethod
    def _inside(level: Level, pointers: Level, parent: np.ndarray, n: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The place of each ``child`` in the range of its ``parent`` (a place, -1 if absent; each has ``n`` of them), else -1."""
        out = np.full(len(child), -1)
        known = parent >= 0
        some = np.flatnonzero(np.repeat(known, n))
        if len(some):
            rank, n = parent[known], n[known]
            out[some] = level.find((np.repeat(rank.astype(U), n) << U(CHILD_BITS)) | child[some].astype(U))
            ends = np.repeat(pointers[rank + 1].astype(np.int64), n)
            out[some[out[some] >= ends]] = -1
        return out

    def find(self, context: np.ndarray, n: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the contexts, and of their successors."""
        at = self.contexts.find(context)
        return at, self._inside(self.children, self.pointers, at, n, child)

    def answer(self, k: int, m: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes for question ``k``: pairs' shares, contexts' weights, triples' shares, pairs' weights as contexts."""
        at, place = self.places[k]
        third = self._inside(self.thirds, self.third_pointers, place, m, child)
        code = lambda codes, i: np.where(i >= 0, codes[np.maximum(i, 0)], 0).astype("<u2") if len(codes) else np.zeros(len(i), "<u2")
        return code(self.alpha, place), code(self.gamma, at), code(self.third_alpha, third), code(self.third_gamma, place)


def _blob(a: np.ndarray) -> bytes:
    """Compressed by byte position, as the upper bytes of counts, codes and token numbers are mostly alike."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _array(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def encode(docs: DataFrame) -> DataFrame:
    """A row for each batch: ids and training flags of its documents, their token counts, tokens and vocabulary."""

    def batch_row(number: int, parts: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([p[2] for p in parts])
        vocab, tokens = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([[d for p in parts for d in p[0].to_pylist()]], pa.list_(pa.int64())), pa.array([[t for p in parts for t in p[1].to_pylist()]], pa.list_(pa.bool_())),
             pa.array([np.concatenate([p[3] for p in parts])], pa.list_(pa.int64())), pa.array([_blob(tokens.astype("<u4"))]), pa.array([_blob(vocab)]), pa.array([len(vocab)])],
            ["batch", "doc_id", "train", "n", "tokens", "vocab", "kinds"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for b in slices(batches, "text"):
            data, offsets = utf8(b["text"])
            start, end, doc = spans(data, offsets)
            n = np.bincount(doc, minlength=b.num_rows) + 1
            h = np.full(n.sum(), END)
            h[np.arange(len(doc)) + doc] = hashes(data, start, end)
            parts.append((b["doc_id"], b["train"], h, n))
            size += len(data)
            if size >= BATCH_BYTES:
                yield batch_row(number, parts)
                number, parts, size = number + 1, [], 0
        if parts:
            yield batch_row(number, parts)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(id_text_crc("doc_id") % 10 != 0, F.lit(False)).alias("train"))
    return own.mapInArrow(run, "batch long, doc_id array<long>, train array<boolean>, n array<long>, tokens binary, vocab binary, kinds long")


class Batch:
    """One row of :func:`encode`, and the questions it asks."""

    def __init__(self, row: dict) -> None:
        self.number, self.doc_id = row["batch"], row["doc_id"]
        self.n = np.array(row["n"], np.int64)
        self.tokens, self.vocab = _array(row["tokens"], "<u4"), _array(row["vocab"], U)
        self.learn = np.repeat(np.array(row["train"], bool), self.n)

    def words(self, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
        counts = np.bincount(self.tokens[self.learn], minlength=len(self.vocab)).astype("<u4")
        cut = np.searchsorted(self.vocab, [U((k << 64) // shards) for k in range(1, shards)])
        for k, (a, b) in enumerate(zip(np.r_[0, cut], np.r_[cut, len(self.vocab)], strict=True)):
            if b > a:
                yield k, _blob(self.vocab[a:b]), _blob(counts[a:b])

    def ngrams(self, shards: int, hot: np.ndarray) -> None:
        """Distinct pairs and triples, and the order in which they are asked: by shard, context and successor."""
        vocab, tokens = self.vocab, self.tokens
        begins = np.zeros(len(tokens), bool)
        begins[np.r_[0, np.cumsum(self.n)[:-1]]] = True
        before = np.r_[np.uint32(np.searchsorted(vocab, END)), tokens[:-1]]  # each text follows an end
        pair, which = np.unique((before.astype(U) << U(32)) | tokens, return_inverse=True)
        self.which = which.astype(np.int32)
        del which, before
        self.count = np.bincount(self.which[self.learn], minlength=len(pair))
        self.inner = np.flatnonzero(~begins)
        triple, third = np.unique((self.which[self.inner - 1].astype(U) << U(32)) | tokens[self.inner], return_inverse=True)
        self.third = third.astype(np.int32)
        del third, tokens
        third_count = np.bincount(self.third[self.learn[self.inner]], minlength=len(triple))

        a, self.last, is_hot = (pair >> U(32)).astype(np.int32), (pair & U(0xFFFFFFFF)).astype(np.int32), np.isin(vocab, hot)
        self.first, self.spread = a, is_hot[a]
        context, child = np.where(self.spread, vocab[a] | ONE, vocab[a] & ~ONE), (vocab >> U(64 - CHILD_BITS)).astype("<u4")
        small = np.uint16 if shards < 1 << 16 else np.int64
        place = lambda c, k: (mix(c ^ mix(k.astype(U))) % U(shards)).astype(small)
        shard = np.where(self.spread, place(context, child[self.last]), (mix(context) % U(shards)).astype(small))
        self.order = np.argsort(shard, kind="stable").astype(np.int32)

        self.parent, word = (triple >> U(32)).astype(np.int32), (triple & U(0xFFFFFFFF)).astype(np.int32)
        apart = self.spread[self.parent] & is_hot[self.last[self.parent]]
        near = np.flatnonzero(~apart)
        at = shard[self.parent[near]]
        by = np.argsort(at, kind="stable")
        self.near, near_shard = near[by], at[by]
        self.m = np.bincount(self.parent[self.near], minlength=len(pair))
        self.far = np.flatnonzero(apart)
        p = self.parent[self.far]
        far = mix(vocab[a[p]] * GOLD ^ vocab[self.last[p]]) | ONE
        by = np.argsort(far, kind="stable")
        self.far, far = self.far[by], far[by]
        at = place(far, child[word[self.far]])
        by = np.argsort(at, kind="stable")
        self.far, far, at = self.far[by], far[by], at[by]
        self.asked = [
            (shard[self.order], context[self.order], child[self.last[self.order]], self.count[self.order], self.m[self.order], near_shard, child[word[self.near]], third_count[self.near]),
            (at, far, child[word[self.far]], third_count[self.far], np.zeros(len(far), np.int64), at[:0], child[:0], third_count[:0]),
        ]

    def firsts(self, part: int) -> np.ndarray:
        """Where each context begins among the questions."""
        shard, context = self.asked[part][:2]
        return np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (shard[1:] != shard[:-1])]) if len(context) else np.zeros(0, np.int64)

    def questions(self, shards: int) -> Iterator[tuple]:
        for part, (shard, context, child, count, m, near_shard, near, near_count) in enumerate(self.asked):
            first = self.firsts(part)
            n = np.diff(np.r_[first, len(context)])
            cut, of, third = (np.searchsorted(x, np.arange(shards + 1)) for x in (shard, shard[first], near_shard))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                (a, b), (c, d), (e, f) = cut[k : k + 2], of[k : k + 2], third[k : k + 2]
                yield k, part, _blob(context[first[c:d]]), *(_blob(x.astype("<u4")) for x in (n[c:d], child[a:b], count[a:b], m[a:b], near[e:f], near_count[e:f]))


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _each(batches) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


L, I, B = pa.int64(), pa.int32(), pa.binary()


def count_words(encoded: DataFrame, shards: int, share: int) -> DataFrame:
    """(batch, shard, counts, word, n, kinds): the answers; with a null batch each shard's tokens and distinct words, and the
    words that have more than one in ``share`` of the shard's tokens, and so all that have it of all tokens."""
    names, types = ["batch", "shard", "counts", "word", "n", "kinds"], [L, I, B, L, L, L]

    def ask(batches):
        for row in _each(batches):
            b = Batch(row)
            yield _rows(["batch", "shard", "words", "counts"], [L, I, B, B], [(b.number, *w) for w in b.words(shards)])

    def answer(t: pa.Table) -> pa.Table:
        words = [_array(w.as_py(), U) for w in t["words"]]
        counts = np.concatenate([_array(c.as_py(), "<u4") for c in t["counts"]])
        vocab, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, counts, len(vocab)).astype("<i8")
        cut, shard = np.cumsum([0, *map(len, words)]), t["shard"][0].as_py()
        rows = [(b, shard, _blob(total[at[x:y]]), None, None, None) for b, x, y in zip(t["batch"].to_pylist(), cut[:-1], cut[1:], strict=True)]
        rows.append((None, shard, None, None, int(total.sum()), int((total > 0).sum())))
        often = np.flatnonzero(total * share > total.sum())
        rows += [(None, shard, None, w, n, None) for w, n in zip(vocab[often].view(np.int64).tolist(), total[often].tolist(), strict=True)]
        return pa.Table.from_batches([_rows(names, types, rows)])

    asked = encoded.mapInArrow(ask, "batch long, shard int, words binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "batch long, shard int, counts binary, word long, n long, kinds long")


def count_ngrams(encoded: DataFrame, shards: int, hot: np.ndarray, tokens: int) -> DataFrame:
    """Answers (batch, shard, part, alpha, gamma, third_alpha, third_gamma)."""
    names = ["batch", "shard", "part", "contexts", "n", "children", "counts", "m", "thirds", "third_counts"]
    types = [L, I, I, *[B] * 7]

    def ask(batches):
        for row in _each(batches):
            b = Batch(row)
            b.ngrams(shards, hot)
            yield _rows(names, types, [(b.number, *q) for q in b.questions(shards)])

    def answer(t: pa.Table) -> pa.Table:
        asked = []
        for r in _each(t.to_batches()):
            asked.append((_array(r["contexts"], U), *(_array(r[c], "<u4") for c in ("n", "children", "counts", "m", "thirds", "third_counts"))))
        trie = Trie(asked, tokens)
        rows = [(b, s, p, *map(_blob, trie.answer(k, *asked[k][4:6]))) for k, (b, s, p) in enumerate(zip(t["batch"].to_pylist(), t["shard"].to_pylist(), t["part"].to_pylist(), strict=True))]
        return pa.Table.from_batches([_rows(["batch", "shard", "part", "alpha", "gamma", "third_alpha", "third_gamma"], [L, I, I, *[B] * 4], rows)])

    asked = encoded.mapInArrow(ask, "batch long, shard int, part int, contexts binary, n binary, children binary, counts binary, m binary, thirds binary, third_counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "batch long, shard int, part int, alpha binary, gamma binary, third_alpha binary, third_gamma binary")


RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _placed(order: np.ndarray, asked: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    out[order] = asked
    return out


def scored(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each document. ``shards`` of pairs and triples: as
    many as the tokens need, if not given."""
    encoded = stored(encode(docs), "encoded")
    size = encoded.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    word_shards, shards = max(8, int(size[0] // SHARD_WORDS) + 1), shards or max(12, int(size[1] // SHARD_TOKENS) + 1)

    words = stored(count_words(encoded, word_shards, shards), "words")
    seen = words.where("batch is null")
    total, distinct = seen.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    often = {r["word"]: r["n"] for r in seen.where(F.col("n") * shards > total).where("word is not null").select("word", "n").collect()}  # fewer than shards
    hot = np.sort(np.array(list(often), np.int64).view(U))
    hot_count = np.array([often[w] for w in hot.view(np.int64).tolist()], float)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        order = right.sort_by([("part", "ascending"), ("shard", "ascending")])
        for one in _each(left.to_batches()):
            b = Batch(one)
            b.ngrams(shards, hot)
            got = lambda name, part, dtype: np.concatenate([*(_array(x.as_py(), dtype) for x, p in zip(order[name], order["part"], strict=True) if p.as_py() == part), np.zeros(0, dtype)])  # noqa: B023, E731
            c = got("counts", -1, "<i8")
            p = (c + 0.1) / (total + 0.1 * (distinct + 1))
            n = len(b.last)
            share = _placed(b.order, value(got("alpha", 0, "<u2")), n)
            weight = value(got("gamma", 0, "<u2"))
            weight[weight == 0] = 1.0  # an unseen context leaves all to the shorter one
            weight = _placed(b.order, np.repeat(weight, np.diff(np.r_[b.firsts(0), n])), n)
            third = np.zeros(len(b.parent))
            third[b.near] = value(got("third_alpha", 0, "<u2"))
            third_weight = _placed(b.order, value(got("third_gamma", 0, "<u2")), n)
            third_weight[third_weight == 0] = 1.0
            if len(hot):
                s = np.flatnonzero(b.spread)
                often = hot_count[np.searchsorted(hot, b.vocab[b.first[s]])]
                pairs = share[s] * total  # here shares are of all tokens
                share[s], weight[s] = pairs / (often + PRIOR), PRIOR / (often + PRIOR)
                both = np.isin(b.vocab, hot)[b.last[s]]
                s, pairs = s[both], pairs[both]
                held = np.zeros(n)
                held[s] = pairs
                third_weight[s] = PRIOR / (pairs + PRIOR)
                third[b.far] = value(got("alpha", 1, "<u2")) * total / (held[b.parent[b.far]] + PRIOR)
            pair = share + weight * p[b.last]
            each = pair[b.which]
            each[b.inner] = third[b.third] + third_weight[b.which[b.inner - 1]] * each[b.inner]
            doc = np.repeat(np.arange(len(b.n)), b.n)
            sums = lambda x: np.bincount(doc, x, len(b.n))  # noqa: B023, E731
            out.append(pa.table({
                "doc_id": pa.array(b.doc_id, pa.int64()), "n_tokens": b.n, "n_known": sums((c > 0)[b.tokens].astype(float)).astype(np.int64), "train_tokens": np.full(len(b.n), total),
                "base_score": sums(np.log10(p)[b.tokens]), "score": sums(np.log10(np.minimum(each, 1.0))),
            }))
        return pa.concat_tables(out)

    none = F.lit(None).cast("binary")
    ngrams = stored(count_ngrams(encoded, shards, hot, total), "ngrams").withColumn("counts", none)
    answers = words.where("batch is not null").select("batch", "shard", F.lit(-1).alias("part"), "counts", *[none.alias(c) for c in ("alpha", "gamma", "third_alpha", "third_gamma")]).unionByName(ngrams)
    return encoded.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("held_out", id_text_crc("doc_id") % 10 == 0)
