"""Numbers and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(seconds: Column) -> Column:
    """Seconds as whole milliseconds, half to even."""
    return F.rint(seconds * 1000).cast("long")


def seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def ntz_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    whole = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    clock = ((F.hour(ts) * 60 + F.minute(ts)) * 60).cast("long") * 1000
    return whole + clock + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def samples(sec: Column, rate: int) -> Column:
    """Seconds as a number of samples, half to even, not below 0."""
    return F.greatest(F.lit(0), F.rint(sec * rate)).cast("long")


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common length of two half-open intervals, 0 at least."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def logprob_to_confidence(logprob: Column) -> Column:
    """exp, clamped to 0..1, 3 places; null is 0."""
    return F.coalesce(F.round(F.least(F.greatest(F.exp(logprob), F.lit(0.0)), F.lit(1.0)), 3), F.lit(0.0))


def confidence_to_logprob(confidence: Column) -> Column:
    """ln of the confidence clamped to 1e-6..1; null and values up to 0 give -0.5."""
    return F.when(confidence > 0, F.ln(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(1e-6)))).otherwise(F.lit(-0.5))


def dot(a: Column, b: Column) -> Column:
    """In double, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def unit(vector: Column, length: int | None = 512, places: int = 6) -> Column:
    """L2-normalised, rounded; null for zero vectors and those not of ``length`` (None: any)."""
    size = norm(vector)
    ok = size > 0 if length is None else (size > 0) & (F.size(vector) == length)
    return F.when(ok, F.transform(vector, lambda x: F.round(x.cast("double") / size, places)))
