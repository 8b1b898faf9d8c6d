"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count exactly.

Texts become words, and phrases of up to four words are known by 64-bit hashes
that take in the language, so everything is per language from the start. A sample
of the texts proposes the phrases that are frequent in it, at a lowered threshold.
A full pass then counts, in all texts, the proposed phrases and their negative
border: every phrase whose two longest parts are proposed, itself proposed or not;
all words are. Whatever turns out to be frequent without having been proposed is a
failure of the border: then a further pass counts the phrases that stand on what
failed. It takes a phrase that nobody has counted yet for possible as long as its
parts are, so it reaches phrases of all lengths and leaves nothing open.

Proposals reach the tasks as a bit table of fixed size (two bits for each phrase,
``1 << BITS`` bits), so what is broadcast does not grow with the corpus: where the
table fills up, more phrases are counted than need be, and none is missed. A task
adds up the counts of a few megabytes of text and sends them, sorted and packed,
to shards by hash; the number of shards follows the corpus, and a hot phrase is one
entry of each packet. Only what is frequent leaves a shard. The frequent phrases'
words and parts are read from the sample, and those that it lacks from all texts; a
task sends each phrase once, up to a memory of fixed size. The rest is joins over the frequent phrases. The counts of two phrases
would be mixed up if their hashes were equal: with a million frequent phrases among
1e9 different ones that happens with probability 5e-5.

Defined results: a null or empty text has no words; a null language is ``und``;
repeated rows count one by one; ties are those of the contract. Words are compared
byte by byte after A-Z are lower-cased. A table without frequent phrases gives no
rows. Only ``text`` and ``lang`` (and ``doc_id``, to draw the sample) are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .textnum import GOLD, LOWER, SPACE, U, _flags, hashes, mix, slices, spans, utf8, windows

#: Words of a phrase at most, and occurrences of a frequent one at least.
LONGEST, LEAST = 4, 30
#: A longer phrase with so many percent of a phrase's occurrences stands for it; phrases reported for each language.
COVERS, BEST = 80, 2000
#: One text in so many is in the sample, whose phrases are proposed from so many occurrences on.
SAMPLE, PROPOSED = 8, 2
#: Two to this power are the bits of the table of phrases.
BITS = 27
#: Bytes of text of a slice and of a shard, about; entries that a task gathers before it sends them, about.
SLICE, SHARD, GATHERED = 1 << 20, 8 << 20, 1 << 20
#: Phrases that a task remembers having sent.
MEMORY = 1 << 20

PIECE = _flags(b".,;:!?\n\x0b\f\r")
SEPARATOR = SPACE | PIECE
PARTS = ("l1", "r1", "l2", "r2", "l3", "r3", "middle")


class Words:
    """The words of a batch (text, lang): hashes, bytes, and a number for each piece of a text."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        data, offsets = utf8(batch["text"])
        self.data = LOWER[data]
        self.start, self.end, self.doc = spans(data, offsets, SEPARATOR)
        langs = batch["lang"].dictionary_encode()
        self.langs, self.code = langs.dictionary.to_pylist(), np.asarray(langs.indices)[self.doc]
        self.keys = mix(np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], U))
        self.h = mix(hashes(data, self.start, self.end) + self.keys[self.code] * GOLD) if len(self.start) else np.zeros(0, U)
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(PIECE[data], out=ends[1:])
        new = np.ones(len(self.h), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (ends[self.start[1:]] != ends[self.end[:-1]])
        self.piece = np.cumsum(new)

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the ``n`` words from each word on, and whether they are in one piece."""
        m = max(0, len(self.h) - n + 1)
        return (self.h if n == 1 else windows(self.h, n)), self.piece[n - 1 :][:m] == self.piece[:m]

    def text(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n)).decode()


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the packed table may hold."""
    out = np.ones(len(h), bool)
    for place in (h >> U(64 - BITS), (h >> U(64 - 2 * BITS)) & U((1 << BITS) - 1)):
        out &= (bits[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8) & 1).astype(bool)
    return out


def bit_table(found: DataFrame) -> np.ndarray:
    """The table of the hashes ``h``, a bounded number of 64-bit words."""
    places = F.array(F.expr(f"shiftrightunsigned(h, {64 - BITS})"), F.expr(f"shiftrightunsigned(h, {64 - 2 * BITS}) & {(1 << BITS) - 1}L"))
    rows = found.select(F.explode(places).alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    words = np.zeros(1 << (BITS - 6), np.int64)
    t = rows.toArrow()  # as many rows as the table has words, at most
    words[np.asarray(t["word"])] = np.asarray(t["bits"])
    return words.view(np.uint8)


def both(x: np.ndarray) -> np.ndarray:
    """For each two neighbours whether both are so."""
    return x[:-1] & x[1:]


def everything(w: Words) -> list[np.ndarray]:
    """The phrases of a text of the sample that may be parts of others."""
    return [h[ok] for h, ok in map(w.phrases, range(1, LONGEST))]


def proposed(bits: np.ndarray) -> Callable[[Words], list[np.ndarray]]:
    """All words, and the phrases whose parts are proposed."""

    def of(w: Words) -> list[np.ndarray]:
        h, ok = w.phrases(1)
        out, may = [h], has(bits, h)
        for n in range(2, LONGEST + 1):
            h, ok = w.phrases(n)
            if not len(h):
                break
            out.append(h[ok & both(may)])
            may = has(bits, h)
        return out

    return of


def beyond(old: np.ndarray, frequent: np.ndarray) -> Callable[[Words], list[np.ndarray]]:
    """The phrases that the pass with ``old`` has not counted and whose parts are frequent, or not counted and possible."""

    def of(w: Words) -> list[np.ndarray]:
        h, ok = w.phrases(1)
        out, may, was = [], has(frequent, h), has(old, h)
        for n in range(2, LONGEST + 1):
            h, ok = w.phrases(n)
            if not len(h):
                break
            possible, counted = ok & both(may), both(was)
            out.append(h[possible & ~counted])
            may, was = np.where(counted, has(frequent, h), possible), has(old, h)
        return out

    return of


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, by byte planes."""
    planes = [np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T, counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T]
    return zstandard.ZstdCompressor(1).compress(np.concatenate(planes).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(16, -1)
    keys, counts = (np.ascontiguousarray(p.T).reshape(-1).view(t) for p, t in ((planes[:8], U), (planes[8:], np.int64)))
    return np.cumsum(keys, dtype=U), counts


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(k) else c)


def counted(texts: DataFrame, of: Callable[[Words], list[np.ndarray]], shards: int, least: int, name: str, totals: bool = False) -> DataFrame:
    """(h, c) of the phrases that ``of`` picks and that occur ``least`` times, and with ``totals`` the words of each language."""

    def send(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        k, c = _summed(keys, counts)
        ends = np.searchsorted(((k >> U(32)) * U(shards)) >> U(32), np.arange(shards + 1, dtype=U))
        some = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([_packed(k[ends[s] : ends[s + 1]], c[ends[s] : ends[s + 1]]) for s in some], pa.binary())], ["shard", "packet"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in slices(batches, "text", SLICE):
            w = Words(batch)
            picked = [np.unique(h, return_counts=True) for h in of(w)]
            if totals:
                n = np.bincount(w.code, minlength=len(w.langs))
                order = np.argsort(w.keys)
                picked.append((w.keys[order], n[order]))
            keys += [k for k, _ in picked]
            counts += [c for _, c in picked]
            if sum(map(len, keys)) > 2 * GATHERED:
                k, c = _summed(keys, counts)
                keys, counts = [k], [c]
                if len(k) > GATHERED:
                    yield send(keys, counts)
                    keys, counts = [], []
        if keys:
            yield send(keys, counts)

    def add(table: pa.Table) -> pa.Table:
        pairs = [_unpacked(x.as_py()) for x in table["packet"]]
        k, c = _summed([k for k, _ in pairs], [c for _, c in pairs])
        often = c >= least
        return pa.table({"h": pa.array(k[often].view(np.int64)), "c": pa.array(c[often])})

    return stored(texts.select("text", "lang").mapInArrow(run, "shard int, packet binary").groupBy("shard").applyInArrow(add, "h long, c long"), name)


def spelt(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(h, lang, lang_key, n, phrase, parts) of the phrases of two words and more that ``bits`` may hold, seldom twice from one task.
    Cut after k words, a phrase's parts are ``lk`` and ``rk``; ``middle`` are the two words inside four."""
    table = texts.sparkSession.sparkContext.broadcast(bits)
    long = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(MEMORY, U)
        for batch in slices(batches, "text", SLICE):
            w = Words(batch)
            hashed = {n: w.phrases(n) for n in range(1, LONGEST + 1)}
            for n in range(2, LONGEST + 1):
                h, ok = hashed[n]
                found = np.flatnonzero(ok & has(table.value, h)) if len(h) else np.zeros(0, np.int64)
                keys, first = np.unique(h[found], return_index=True)
                at = found[first]
                slot = (keys & U(MEMORY - 1)).astype(np.int64)
                new = sent[slot] != keys
                sent[slot], at, keys = keys, at[new], keys[new]
                part = lambda k, shift=0: pa.array(hashed[k][0][at + shift].view(np.int64), long)  # noqa: B023, E731
                none = pa.nulls(len(at), long)
                cuts = [x for k in range(1, LONGEST) for x in ((part(k), part(n - k, k)) if k < n else (none, none))]
                code = w.code[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64), long), pa.array([w.langs[c] for c in code], pa.string()), pa.array(w.keys[code].view(np.int64), long),
                        pa.array(np.full(len(at), n, np.int32)), pa.array([w.text(i, n) for i in at.tolist()], pa.string()), *cuts, part(2, 1) if n == 4 else none,
                    ],
                    ["h", "lang", "lang_key", "n", "phrase", *PARTS],
                )

    return texts.select("text", "lang").mapInArrow(run, "h long, lang string, lang_key long, n int, phrase string, " + ", ".join(f"{p} long" for p in PARTS))


def drawn(texts: DataFrame, sample: int) -> DataFrame:
    """The sample: one row in ``sample``, by a hash."""
    return texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0)


def frequent(texts: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(h, c) of all phrases that occur ``least`` times or more, and of the languages with as many words (their key, the words)."""
    sc = texts.sparkSession.sparkContext
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    old = bit_table(counted(drawn(texts, sample), everything, max(1, -(-shards // sample)), PROPOSED, "proposed"))
    old_bits = sc.broadcast(old)
    found = counted(texts, lambda w: proposed(old_bits.value)(w), shards, least, "counted", totals=True)
    now = bit_table(found)
    if not (now & ~old).any():  # all that is frequent was proposed: the border holds
        return found
    now_bits = sc.broadcast(now)
    more = counted(texts, lambda w: beyond(old_bits.value, now_bits.value)(w), shards, least, "expanded")
    return found.unionByName(more)


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, covers: int = COVERS, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text <> ''")
    found = frequent(texts, least, sample)
    # most are in the sample, so the whole table is only asked for the rest
    own = stored(spelt(drawn(texts, sample), bit_table(found)).dropDuplicates(["h"]).join(found, "h"), "spelt")
    rest = stored(found.join(own, "h", "left_anti"), "unspelt")
    own = own.unionByName(stored(spelt(texts, bit_table(rest)).dropDuplicates(["h"]).join(rest, "h"), "spelt")).withColumnRenamed("c", "a")
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("lh"), F.col(f"r{k}").alias("rh")) for k in range(1, LONGEST)])
    cut = own.select("h", "a", F.inline(cuts)).where("lh is not null")
    cut = cut.join(found.select(F.col("h").alias("lh"), F.col("c").alias("l")), "lh").join(found.select(F.col("h").alias("rh"), F.col("c").alias("r")), "rh")
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    lowest = cut.groupBy("h").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inside = F.when(F.col("n") == 3, F.array("l2", "r1")).when(F.col("n") == 4, F.array("l3", "r1", "l2", "r2", "middle"))
    longer = own.where("n > 2").select(F.explode(inside).alias("h"), "a").groupBy("h").agg(F.max("a").alias("longer"))
    kept = own.join(longer, "h", "left").where(F.expr(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {covers} * cast(a as decimal(20, 0))"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.join(lowest, "h").select("lang", "lang_key", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    n = found.select(F.col("h").alias("lang_key"), F.col("c").alias("n"))
    return kept.join(n, "lang_key").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS MATERIALIZED (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
t AS MATERIALIZED (SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM p),
q AS MATERIALIZED (SELECT lang, w1, {", ".join(f"lead(w1, {k}) OVER (PARTITION BY p ORDER BY i) AS w{k + 1}" for k in range(1, LONGEST))} FROM t),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, {' || chr(32) || '.join(f'w{i}' for i in range(1, k + 1))} AS phrase FROM q WHERE w{k} IS NOT NULL" for k in range(1, LONGEST + 1))}),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
halves AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT h.lang, h.phrase, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.first JOIN f y ON y.lang = h.lang AND y.phrase = h.rest),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT DISTINCT lang, a AS longer, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM (SELECT lang, k, a, w, j, unnest(range(1, k - j + 2)) AS i FROM c, range(2, {LONGEST}) t(j) WHERE j < k)),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN sub USING (lang, phrase) WHERE 100::HUGEINT * longer >= {COVERS}::HUGEINT * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM low ANTI JOIN gone USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= {BEST}
"""
