"""Scalar expressions over paired labels. All are JVM-side columns; null stands for undefined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(c: Column) -> Column:
    """Number of a text; blank or malformed gives null."""
    return c.try_cast("double")


def flag_of_text(c: Column) -> Column:
    """True exactly for the text ``true`` in any case; null is false."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def stable(distance: Column, at: float = 0.0) -> Column:
    """Distance at or under the threshold; null stays null."""
    return distance <= F.lit(float(at))


def discordant(a: Column, b: Column) -> Column:
    return a != b


def direction(a: Column, b: Column) -> Column:
    return F.when(a & ~b, "a_only").when(b & ~a, "b_only").otherwise("concordant")


def quadrant(a: Column, b: Column) -> Column:
    return F.when(a & b, "both").when(a & ~b, "a_only").when(~a & b, "b_only").when(~a & ~b, "neither")


def gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def least_distance(a: Column, b: Column) -> Column:
    return F.least(F.abs(a), F.abs(b))


def within(c: Column, at: float | Column) -> Column:
    """|c| at or under a bound; null counts as false, so that its negation is true."""
    return F.coalesce(F.abs(c) <= (at if isinstance(at, Column) else F.lit(float(at))), F.lit(False))


def near_either(a: Column, b: Column, at: float | Column) -> Column:
    return within(a, at) | within(b, at)


def near_both(a: Column, b: Column, at: float | Column) -> Column:
    return within(a, at) & within(b, at)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double; null where the divisor is 0 or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def right_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (lower, upper] that holds the value; labels number edges + 1, the ends open."""
    if len(labels) != len(edges) + 1:
        raise ValueError("there must be one label more than edges")
    out = F.when(c <= F.lit(float(edges[0])), labels[0])
    for edge, label in zip(edges[1:], labels[1:-1], strict=True):
        out = out.when(c <= F.lit(float(edge)), label)
    return out.when(c.isNotNull(), labels[-1])


def element_tokens(formula: Column) -> Column:
    """Sorted distinct element symbols of a formula."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)"), F.lit(1))))


def word_tokens(text: Column) -> Column:
    """Sorted distinct words of a text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")))


def system_key(tokens: Column) -> Column:
    return F.concat_ws("-", tokens)


def family_pair(tokens: Column) -> Column:
    """Count of tokens and the first two of them, as a block key."""
    return F.concat_ws("|", F.size(tokens).cast("string"), F.when(F.size(tokens) > 0, F.concat_ws("-", F.slice(tokens, 1, 2))).otherwise("unknown"))


def tags(tokens: Column, groups: dict[str, Sequence[str]], other: str = "other") -> Column:
    """Names of all groups that share a token, ``other`` for none."""
    found = F.filter(F.array(*[F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, members))), name) for name, members in groups.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(other)))


def score_status(c: Column, most: float = 1e6) -> Column:
    """``scored``, or why a score can't be used."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(float(most))), "failed_nonfinite_or_nonphysical").otherwise("scored")


def hashed(*parts: Column | str | int) -> Column:
    """A reproducible integer below 2^32 from the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A reproducible number in [0, 1)."""
    return hashed(*parts) / F.lit(4294967296.0)


def conformal_gamma(p: Column) -> Column:
    """-1 / ln p where that lies in (0, 1), else null."""
    g = F.when((p > 0) & (p < 1), F.lit(-1.0) / F.log(p))
    return F.when((g > 0) & (g < 1), g)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def truthy(c: Column, numeric: bool = False) -> Column:
    """Flag by truthiness: null is true; of texts all but the empty one, of numbers all but 0."""
    return F.coalesce(c != (F.lit(0) if numeric else F.lit("")), F.lit(True))


def masked(c: Column, where: Column, value: Column | str) -> Column:
    """The column with ``value`` where a condition holds; a null condition doesn't."""
    return F.when(F.coalesce(where, F.lit(False)), value).otherwise(c)
