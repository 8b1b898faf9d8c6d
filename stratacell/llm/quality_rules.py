"""Quality rules as a short-circuit cascade, with DataFrame functions only.

The cost and the rejections of each rule are measured on a sample of bounded
size, a rule's cost as the time for each evaluation beyond that of an empty
rule. Rules then run in the order of rejections per cost, and a text that one
rule rejects is not looked at by the next. ``keep`` puts the base rules into the
cascade too, and computes each count only where a rule asks for it; ``judge``
returns the base counts and so computes them for all. The verdict is the
conjunction of all rules and does not depend on the order, nor on the sample.

Defined results: a null, empty or blank text has no words and zero counts; it
fails the base rule. Texts of any length are counted whole; windows are compared
by 64-bit hashes. Repeated rows are judged one by one. Only ``doc_id`` and
``text`` are read, so further columns may have any names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

#: Rows of the sample on which costs and rejections are estimated, of texts up to this length: the first that a scan
#: finds, which stops there. A rule is evaluated so many times for each row, if once is too short to time.
SAMPLE_ROWS, SAMPLE_CHARS, AGAIN = 200, 100_000, 40
#: Windows of a text up to which a window's hash and its place share one long.
PLACES = 1 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _repeated(h: Column) -> Column:
    """Words covered by windows of three of ``h`` that occur twice or more. Each window and its place share one long for a
    primitive sort, and neighbours are compared in full; where a text is too long for that, or different windows meet
    there, windows are sorted beside their places."""
    mask = PLACES - 1

    def count(w: Column) -> Column:
        at = lambda x: F.get(w, x.bitwiseAND(F.lit(mask)).cast("int"))
        head = lambda x: x.bitwiseOR(F.lit(mask))
        again = lambda s, f: F.filter(s, lambda v, i: (f(v) == f(F.get(s, i - 1))) | (f(v) == f(F.get(s, i + 1))))
        short = F.sort_array(F.transform(w, lambda v, i: v.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
        full = F.sort_array(F.transform(w, lambda v, i: F.struct(v.alias("h"), i.cast("long").alias("i"))))
        mixed = lambda s: F.size(F.filter(s, lambda v, i: (head(v) == head(F.get(s, i - 1))) & (at(v) != at(F.get(s, i - 1))))) > 0
        slow = let(full, lambda s: F.transform(again(s, lambda v: v["h"]), lambda v: v["i"]))
        fast = lambda s: F.transform(again(s, at), lambda v: v.bitwiseAND(F.lit(mask)))
        places = F.when(F.size(w) > PLACES, slow).otherwise(let(short, lambda s: F.when(mixed(s), slow).otherwise(fast(s))))
        return let(
            F.sort_array(places),
            lambda p: F.aggregate(
                F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), v + 3) - v)),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ),
        )

    three = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    return let(three, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(count(w)))


def n_repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, the first included."""
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), _repeated))


@dataclass(frozen=True)
class Counts:
    """What the rules may ask for: columns, or expressions that are computed where they are used."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


def of_columns() -> Counts:
    return Counts(*map(F.col, ("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))


def of_words(text: Column, w: Column) -> Counts:
    text = F.coalesce(text, F.lit(""))
    return Counts(text, F.size(w).cast("long"), F.length(F.array_join(w, "")).cast("long"), n_symbols(text), n_dup_lines(text), n_repeat_words(w))


Rules = dict[str, Callable[[Counts], Column]]

#: Predicates that are true for a text to reject: those of the base, and those beyond it.
BASE: Rules = {
    "few_words": lambda c: c.n_words < 50,
    "repeated_words": lambda c: 100 * c.n_repeat_words > 50 * c.n_words,
}
RULES: Rules = {
    "mean_word_length": lambda c: (c.word_chars < 2 * c.n_words) | (c.word_chars > 15 * c.n_words),
    "symbols": lambda c: 100 * c.n_symbols > 15 * c.n_words,
    "dup_lines": lambda c: 100 * c.n_dup_lines > 30 * (F.regexp_count(c.text, F.lit("\n")) + 1),
    "shouting": lambda c: 100 * F.regexp_count(c.text, F.lit("[!]")) > 30 * c.n_words,
}


def base(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``also``, doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""

    def counts(w: Column) -> Column:
        c = of_words(F.col("text"), w)
        return F.struct(c.n_words.alias("n_words"), c.word_chars.alias("word_chars"), c.n_repeat_words.alias("n_repeat_words"))

    d = docs.select(*also, "doc_id", "text", let(words(F.col("text")), counts).alias("c"), n_symbols(F.col("text")).alias("n_symbols"), n_dup_lines(F.col("text")).alias("n_dup_lines"))
    d = d.select(*also, "doc_id", "text", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    failed = BASE["few_words"](of_columns()) | BASE["repeated_words"](of_columns())
    return d.withColumn("base_failed", failed)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text) of ``rows`` rows at most."""
    found = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS).take(rows)
    return docs.sparkSession.createDataFrame(found, "doc_id long, text string")


def rule_order(rows: DataFrame, rules: Rules, counts: Counts) -> list[dict]:
    """Rules by rejections per second of evaluation, on ``rows``, a stored sample that ``counts`` refers to."""

    def timed(rule: Column, times: int) -> tuple[float, int]:
        again = F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(0), lambda a, _: a + F.coalesce(rule, F.lit(False)).cast("int"))
        began = time.perf_counter()
        rejected = rows.agg(F.coalesce(F.sum((again > 0).cast("int")), F.lit(0))).first()[0]
        return time.perf_counter() - began, rejected

    n = rows.count()
    timed(F.lit(False), 1)  # compiles what all share
    none = {times: min(timed(counts.text.isNull(), times)[0] for _ in range(2)) for times in (1, AGAIN)}
    found = []
    for name, rule in rules.items():
        seconds, rejected = timed(rule(counts), 1)
        times = 1 if seconds > 10 * none[1] else AGAIN
        seconds = min(seconds, timed(rule(counts), 1)[0]) if times == 1 else timed(rule(counts), times)[0]
        found.append({"rule": name, "seconds": max(seconds - none[times], 1e-4) / times / max(n, 1), "rejected": rejected, "of": n})
    return sorted(found, key=lambda r: (-r["rejected"] / r["seconds"], r["seconds"], r["rule"]))


def cascade(rules: Rules, order: list[str], counts: Counts) -> Column:
    """False if a rule rejects: the branches of CASE run in turn, and stop at the first that holds."""
    verdict = F.when(F.lit(False), F.lit(False))
    for name in order:
        verdict = verdict.when(F.coalesce(rules[name](counts), F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: Rules = RULES, sample_rows: int = SAMPLE_ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """Base counts of each document, and ``kept``: false if the base rule or any of ``rules`` rejects it.

    Returns the columns named in ``also``, doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    """
    rows = stored(base(sample(docs, sample_rows)).where("not base_failed"), "sample")
    order = [r["rule"] for r in rule_order(rows, rules, of_columns())]
    return base(docs, also).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules, order, of_columns())))


def keep(docs: DataFrame, rules: Rules = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the base and ``rules`` keep, with all their columns unchanged."""
    rules = BASE | rules
    rows = stored(sample(docs, sample_rows).select("text", words(F.col("text")).alias("w")), "sample")
    order = [r["rule"] for r in rule_order(rows, rules, of_words(F.col("text"), F.col("w")))]
    return docs.where(let(words(docs["text"]), lambda w: cascade(rules, order, of_words(docs["text"], w))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).drop("text")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
v AS (SELECT doc_id, text, w,
  [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] AS g,
  [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM w),
e AS (SELECT rowid AS r, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT row_number() OVER () AS rowid, * FROM v)),
x AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM e),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM x WHERE n > 1),
c AS (SELECT r, sum(least(3, coalesce(nxt, i + 3) - i)) AS n FROM p GROUP BY r),
b AS (SELECT v.doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT row_number() OVER () AS r, * FROM v) v LEFT JOIN c USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 15 * n_words
    OR 100 * n_dup_lines > 30 * (length(text) - length(replace(text, chr(10), '')) + 1)
    OR 100 * (length(text) - length(replace(text, '!', ''))) > 30 * n_words) AS kept
FROM f
"""
