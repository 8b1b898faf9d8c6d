"""Toxicity after noisy-channel restoration of disguised words.

A disguised stretch (characters for letters, spaced or repeated letters) is a
lattice of what its writer may have meant; a Viterbi search under a character
trigram model picks the likeliest reading, and the restored text is scored by
words whose presence speaks for the label. The character model, the words'
weights (a ridge logistic regression) are learnt from labelled documents.

Fitting uses all labelled rows that may be learnt from; every text is scored
whole. The character model is over their ``ALPHABET`` most frequent letters and
one sign for all others, so its table is bounded without leaving trigrams out, and
the probabilities of what may follow a context add up to one. The words' weights
are fitted by Spark's logistic regression, of which the driver has the weights
alone. A text with disguised stretches is scored as restored: what was not
restored stays as it is.

Defined results: a null or empty text has no words and gets the score of a text
without evidence; without labelled rows, or without toxic ones, every score is
the smoothed share of toxic labels; of several labels of one document the largest
counts. Repeated rows are scored one by one. Only ``doc_id`` and ``text`` (and
``toxic`` of the labels) are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Matrices
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text_crc, stored
from .textnum import NOT_LETTER, U, _flags, hashes, mix, slices, spans, utf8

#: Labels up to which they are broadcast to the documents; beyond, both sides are shuffled.
BROADCAST_LABELS = 1_000_000
#: Characters that trigrams are counted over at a time, about.
AT_ONCE = 1 << 20
#: Letters that the character model tells apart, and what is added to each count.
ALPHABET, SMOOTH = 96, 0.01
OTHER = "\ufffd"
#: Toxic documents that must have a word before it counts, and its least log-odds.
LEAST_DOCS, LEAST_ODDS = 4, 2.5
ACCEPT = 0.5
#: Readings of a character, the usual ones of leetspeak.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
#: Log-probabilities of the channel: a character left as it is though it has readings, and a letter doubled on purpose.
LITERAL, DOUBLED = -9.0, -2.0
SIGNS = "".join(map(re.escape, READINGS))
LONE = r"[^\W\d_](?:[ .\-_*]{1,2}[^\W\d_])+"
#: Single letters set apart, else a word; a word is a stretch if it has DISGUISE. Each pattern reads a text of any length once.
STRETCH = re.compile(rf"((?<!\S){LONE}(?!\S))|\S+")
DISGUISE = re.compile(rf"[^\W\d_][{SIGNS}]{{1,3}}[^\W_]|[^\W_][{SIGNS}]{{1,3}}[^\W\d_]|(?<!\S)[{SIGNS}][^\W\d_]|([^\W\d_])\1\1")
#: Readings of stretches up to this length are remembered within a task; longer ones are decoded each time.
REMEMBERED = 60
LETTER, SIGN = ~NOT_LETTER, _flags("".join(READINGS).encode())
#: Bytes of a character by its first byte, 0 for the others.
WIDTH = np.repeat([1, 0, 2, 3, 4], [128, 64, 32, 16, 16])
#: By byte: gaps between single letters, and the last byte of what may stand before the first and the first byte of what may follow a letter.
BLANKS = [chr(c).encode() for c in range(0x3001) if chr(c).isspace()]
GAP = _flags(b" .-_*")
GAP_BEFORE, GAP_BEHIND = _flags(bytes(c[-1] for c in BLANKS)), GAP | _flags(bytes(c[0] for c in BLANKS))


class Chars:
    """Log-probabilities of a character after two others. ``counts``: of trigrams over ``alphabet``, which has ``OTHER`` and the blank."""

    def __init__(self, counts: dict[str, int], alphabet: str) -> None:
        self.alphabet, size = frozenset(alphabet), len(alphabet)
        before: dict[str, int] = {}
        for g, v in counts.items():
            before[g[:2]] = before.get(g[:2], 0) + v
        self.seen = {g: math.log((v + SMOOTH) / (before[g[:2]] + SMOOTH * size)) for g, v in counts.items()}
        self.unseen = {c: math.log(SMOOTH / (n + SMOOTH * size)) for c, n in before.items()}
        self.nothing = -math.log(size)

    def after(self, context: str, c: str) -> float:
        """Of ``c`` after the two characters ``context``; all of the alphabet."""
        found = self.seen.get(context + c)
        return found if found is not None else self.unseen.get(context, self.nothing)

    def known(self, c: str) -> str:
        return c if c in self.alphabet else OTHER


@dataclass
class Model:
    prior: float
    chars: Chars | None = None
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shift: float = 0.0


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each place of a stretch, what may have been meant and its log-probability. Letters spaced out singly lose
    the gaps; a letter three or more times stands for one or two."""
    s = stretch.lower()
    if re.fullmatch(LONE, s):
        s = re.sub(r"[ .\-_*]", "", s)
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        c, n = s[i], j - i
        if c in READINGS:
            spread = math.log(len(READINGS[c]))
            one = [(r, -spread) for r in READINGS[c]] + [(c, LITERAL)]
            out += [one] if n > 2 else [one] * n
        elif n > 2:
            out.append([(c, 0.0), (c + c, DOUBLED)])
        else:
            out += [[(c, 0.0)]] * n
        i = j
    return out


def decode(stretch: str, chars: Chars) -> str:
    """The likeliest reading: a Viterbi search whose state is the last two characters. What a state has read is a
    chain of back pointers, so time and memory grow linearly with the stretch."""
    start, stop = 0, len(stretch)
    while start < stop and not (_word(stretch[start]) or stretch[start] in "@$!|+(*"):
        start += 1
    while stop > start and not _word(stretch[stop - 1]):
        stop -= 1
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for options in [*lattice(stretch[start:stop]), [(" ", 0.0)]]:
        new: dict[str, tuple[float, tuple | None]] = {}
        for last, (p, said) in states.items():
            for text, cost in options:
                q, end = p + cost, last
                for c in text:
                    if c.isalpha() or c == " ":
                        k = chars.known(c)
                        q += chars.after(end, k)
                        end = end[1:] + k
                    else:
                        end = "  "
                if end not in new or q > new[end][0]:
                    new[end] = (q, (said, text))
        states = new
    said, back = max((p, end, s) for end, (p, s) in states.items())[2], []
    while said:
        said, text = said
        back.append(text)
    return stretch[:start] + "".join(reversed(back)).rstrip(" ") + stretch[stop:]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def restore(text: str, read) -> str:
    return STRETCH.sub(lambda m: read(m[0]) if m[1] or DISGUISE.search(m[0]) else m[0], text)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts that may hold a disguised stretch: all that :func:`restore` would change, and few others.
    No text is passed over for what stands before or behind it in the batch."""
    n = len(data)
    b = np.concatenate([np.full(1, 32, np.uint8), data, np.full(16, 32, np.uint8)])  # a text's byte i is b[i + 1]
    letter, sign = LETTER[b], SIGN[b]
    found = sign[1 : n + 1] & (letter[2 : n + 2] | (sign[2 : n + 2] & letter[:n]))
    for width in (1, 2, 3, 4) if n and data.max() >= 128 else (1,):  # bytes of the letter that is there three times
        same = b[1 : n + 13 - width] == b[1 + width : n + 13]
        run = letter[1 : n + 1] & (WIDTH[b[1 : n + 1]] == width)
        for k in range(2 * width):
            run &= same[k : n + k]
        found |= run
    # single letters set apart: the first two
    starts, ends = GAP_BEFORE[b[:n]], np.zeros(len(b), bool)
    starts[offsets[:-1][offsets[:-1] < n]] = True
    ends[offsets[1:] + 1] = True
    first = np.flatnonzero(starts & (WIDTH[b[1 : n + 1]] > 0) & letter[1 : n + 1])
    gap = first + 1 + WIDTH[b[first + 1]]
    first, gap = first[GAP[b[gap]]], gap[GAP[b[gap]]]
    for second in (gap + 1, gap + 2):
        ok = letter[second] & GAP[b[second - 1]]
        behind = second + WIDTH[b[second]]
        found[first[ok & (ends[behind] | GAP_BEHIND[b[behind]])]] = True
    return np.unique(np.searchsorted(offsets, np.flatnonzero(found), "right") - 1)


class Reader:
    """Restores stretches under a character model; what short ones meant is remembered for as long as the reader is."""

    def __init__(self, chars: Chars | None) -> None:
        self.chars, self.short = chars, lru_cache(100_000)(lambda s: decode(s, chars))

    def read(self, stretch: str) -> str:
        return self.short(stretch) if len(stretch) <= REMEMBERED else decode(stretch, self.chars)

    def restored(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the batch's texts after restoration."""
        data, offsets = utf8(batch["text"])
        texts: dict[int, str] = {}
        for k in _suspects(data, offsets) if self.chars else ():
            old = bytes(data[offsets[k] : offsets[k + 1]]).decode()
            if (new := restore(old, self.read)) != old:
                texts[k] = new
        if not texts:
            return data, offsets
        return utf8(pa.array([texts[k] if k in texts else bytes(data[offsets[k] : offsets[k + 1]]).decode() for k in range(batch.num_rows)], pa.large_string()))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, word's hash), distinct."""
    start, end, doc = spans(data, offsets, NOT_LETTER)
    h = hashes(data, start, end)
    _, first = np.unique(mix(h + doc.astype(U) * U(0xD6E8FEB86659FD93)), return_index=True)
    return doc[first], h[first]


def _letters(text: str) -> str:
    return "  " + re.sub(r"[\W\d_]+", "  ", text.lower()) + "  "


def _trigrams(*texts: str) -> dict[str, int]:
    c = np.frombuffer("".join(map(_letters, texts)).encode("utf-32-le"), np.uint32).astype(np.int64)
    code, n = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
    m = (1 << 21) - 1
    out = {chr(k >> 42) + chr((k >> 21) & m) + chr(k & m): int(v) for k, v in zip(code.tolist(), n.tolist(), strict=True)}
    if len(texts) > 1:  # two windows of three blanks lie across where two texts meet
        out["   "] -= 2 * (len(texts) - 1)
    return {g: v for g, v in out.items() if v}


def train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of all labelled documents that may be learnt from."""
    own = labels.where("toxic is not null and doc_id is not null").where(id_text_crc("doc_id") % 5 != 0)
    own = stored(own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "learnt")
    few = own.count() <= BROADCAST_LABELS
    return docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(own) if few else own, "doc_id").select("text", "toxic")


def _tally(train: DataFrame, of) -> DataFrame:
    """(g, n): the sums of the counts that ``of`` gives for texts."""

    def run(batches):
        total: dict[str, int] = {}
        for b in slices(batches, "text"):
            texts, size = [], 0
            for k, t in enumerate(b["text"].to_pylist(), 1):
                texts.append(t or "")
                size += len(texts[-1])
                if size >= AT_ONCE or k == b.num_rows:
                    for g, v in of(*texts).items():
                        total[g] = total.get(g, 0) + v
                    texts, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["g", "n"])

    return train.mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def char_model(train: DataFrame) -> Chars:
    """The character model of ``train``'s texts."""
    letters = _tally(train, lambda *texts: Counter("".join(map(_letters, texts)))).where("g <> ' '").orderBy(F.desc("n"), "g").limit(ALPHABET)
    alphabet = "".join(r["g"] for r in letters.collect()) + " " + OTHER
    known = frozenset(alphabet)

    def folded(*texts: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for g, n in _trigrams(*texts).items():
            g = "".join(c if c in known else OTHER for c in g)
            out[g] = out.get(g, 0) + n
        return out

    # at most the alphabet's size to the power of three, whatever the texts
    return Chars({r["g"]: r["n"] for r in _tally(train, folded).collect()}, alphabet)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    train = stored(train_rows(docs, labels), "train")
    n = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = Model((n[1] + 1) / (n[0] + 2) if n[0] else 0.05)
    if not n[1] or n[1] == n[0]:
        return model

    model.chars = char_model(train)
    chars = model.chars

    def words(batches):
        reader = Reader(chars)
        for b in slices(batches, "text"):
            doc, h = _words(*reader.restored(b))
            toxic = np.asarray(b["toxic"])[doc]
            key, at, every = np.unique(h, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, toxic, len(key)).astype(np.int64)), pa.array(every)], ["h", "bad", "every"])

    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("every") - F.col("bad") + 0.5) / (n[0] - n[1] + 1))
    table = train.mapInArrow(words, "h long, bad long, every long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("every").alias("every"))
    found = table.select("h", "bad", odds.alias("w")).where((F.col("bad") >= LEAST_DOCS) & (F.col("w") >= LEAST_ODDS)).orderBy("h").collect()  # the lexicon, which every task has
    if not found:
        return model
    key = np.array([r["h"] for r in found], np.int64).view(U)
    order = np.argsort(key)
    model.words, model.weights = key[order], np.ones(len(key))

    def present(batches):
        reader = Reader(model.chars)
        for b in slices(batches, "text"):
            doc, word = _hits(b, model, reader)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            names = pa.array(word.astype(np.int64)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cut), names), pa.array(b["toxic"])], ["words", "y"])

    rows = stored(train.mapInArrow(present, "words array<string>, y int").distinct(), "present")  # copies count once
    model.weights, model.shift = _logistic(rows, len(key))
    return model


def _logistic(rows: DataFrame, n: int, ridge: float = 0.02, steps: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of ``y`` on the ``words`` present, numbers from 0 to ``n`` - 1 as text; weights are not negative."""
    known = CountVectorizerModel.from_vocabulary([str(k) for k in range(n)], "words", "features", binary=True)
    found = LogisticRegression(
        labelCol="y", maxIter=steps, tol=1e-7, regParam=ridge / max(1, rows.count()), standardization=False, family="binomial",
        lowerBoundsOnCoefficients=Matrices.dense(1, n, [0.0] * n),
    ).fit(known.transform(rows))
    # sums of floats differ with their order; what is kept does not
    return np.round(found.coefficients.toArray(), 4), round(found.intercept, 4)


def _hits(batch: pa.RecordBatch, model: Model, reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, number of a lexicon word that it has), distinct and in order."""
    data, offsets = reader.restored(batch)
    start, end, doc = spans(data, offsets, NOT_LETTER)
    h = hashes(data, start, end)
    at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
    hit = model.words[at] == h
    pairs = np.unique(np.column_stack([doc[hit], at[hit]]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _evidence(batch: pa.RecordBatch, model: Model, reader: Reader) -> np.ndarray:
    doc, word = _hits(batch, model, reader)
    return np.bincount(doc, model.weights[word], batch.num_rows)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.chars)
        for b in slices(batches, "text"):
            s = np.full(b.num_rows, model.prior)
            if len(model.words):
                s = 1 / (1 + np.exp(-np.clip(_evidence(b, model, reader) + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select(
        "doc_id", (id_text_crc("doc_id") % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted")
    )
