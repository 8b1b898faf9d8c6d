"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("nan", "None")


def sample_variance(sum_x: Column, sum_xx: Column, n: Column) -> Column:
    """Variance with n - 1, from sums; never below 0, and 0 for fewer than two cells."""
    centred = sum_xx - F.try_divide(sum_x * sum_x, n)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.greatest(F.try_divide(centred, n - 1), F.lit(0.0)))


def cohens_d(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Difference of means in pooled standard deviations; null where that is 0."""
    pooled = F.sqrt(F.try_divide((n_a - 1) * var_a + (n_b - 1) * var_b, n_a + n_b - 2))
    return F.try_divide(mean_a - mean_b, pooled)


def welch_t(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    return F.try_divide(mean_a - mean_b, F.sqrt(F.try_divide(var_a, n_a) + F.try_divide(var_b, n_b)))


def as_label(c: Column, numeric: bool = False) -> Column:
    """Text of a value; missing values become ``unknown``."""
    text = c.cast("string")
    gone = c.isNull() | text.isin(*MISSING)
    if numeric:
        gone = gone | F.isnan(c)
    return F.when(gone, F.lit("unknown")).otherwise(text)


def thread_title(text: Column, most: int = 50) -> Column:
    """White space collapsed and trimmed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def visible(is_public: Column, required: Column, roles: Column) -> Column:
    """A private row is seen by those who share a role with it; without roles by nobody."""
    return is_public | F.coalesce(F.arrays_overlap(required, roles), F.lit(False))


#: Fixed values of traces: what stands for private content, and the longest result that is kept, in characters of its JSON.
REDACTED, MOST_RESULT = "[redacted]", 4096


def redacted(c: Column, public: Column) -> Column:
    """A text that a user or an assistant wrote: unchanged where the dataset is public, a placeholder otherwise."""
    return F.when(public, c).otherwise(F.lit(REDACTED))


def redacted_result(c: Column, public: Column, most: int = MOST_RESULT) -> Column:
    """A tool's result, as JSON: replaced where the dataset is private, and by a marker with its size where it is too long."""
    marker = F.to_json(F.struct(F.lit(True).alias("_truncated"), F.length(c).alias("_size_bytes")))
    return F.when(~public, F.lit('{"_redacted":"tool_result"}')).when(F.length(c) > most, marker).otherwise(c)


def redacted_args(tool: Column, c: Column, public: Column) -> Column:
    """A tool's arguments, as JSON; of private ones the tool's name is left."""
    return F.when(public, c).otherwise(F.to_json(F.struct(F.lit("tool_args").alias("_redacted"), tool.alias("tool"))))


def redacted_view(c: Column, public: Column) -> Column:
    """A view state, as JSON; none stays none."""
    return F.when(c.isNull() | public, c).otherwise(F.lit('{"_redacted":"view_state"}'))
