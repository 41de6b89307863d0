"""Decoders, bins and lookups as ``when`` chains / literal maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import config


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, mapping: Mapping, default=None) -> Column:
    """``Series.map(dict)`` for a small constant dict: a literal map, unmapped -> default."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    out = F.try_element_at(m, _c(c))
    return out if default is None else F.coalesce(out, F.lit(default))


def tier_bin(c: Column | str, bins=config.TIER_BINS) -> Column:
    """Right-closed bins ``(lo, hi]`` (pandas ``cut``): the lowest edge itself is null."""
    x = _c(c)
    expr = None
    for lo, hi, label in bins:
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def level_band(c: Column | str, bands=config.LEVEL_BANDS, top: str = "High") -> Column:
    """Left-closed bands: ``< 50`` Low, ``< 70`` Medium, else High; null stays null."""
    x = _c(c)
    expr = None
    for hi, label in bands:
        expr = F.when(x < hi, F.lit(label)) if expr is None else expr.when(x < hi, F.lit(label))
    return expr.when(x.isNotNull(), F.lit(top))


def yes_no_decode(c: Column | str, yes_tokens: Sequence[str] = config.YES_TOKENS) -> Column:
    """Lower-cased string in the yes set -> 1, anything else (including null) -> 0."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return F.coalesce(s.isin(*yes_tokens), F.lit(False)).cast("int")


def parental_decode(c: Column | str, cuts=config.PARENTAL_CUTS) -> Column:
    """Low / Medium / High at the cut points; unparsable or null -> Unknown."""
    v = _c(c).cast("string").try_cast("double")
    return (
        F.when(v.isNull(), F.lit("Unknown"))
        .when(v < cuts[0], F.lit("Low"))
        .when(v < cuts[1], F.lit("Medium"))
        .otherwise(F.lit("High"))
    )


def subject_category(
    c: Column | str,
    categories=config.SUBJECT_CATEGORIES,
    default: str = config.SUBJECT_CATEGORY_DEFAULT,
) -> Column:
    """First category whose substring list matches the subject, in the given order."""
    s = _c(c)
    expr = None
    for label, subs in categories:
        cond = None
        for sub in subs:
            m = s.contains(sub)
            cond = m if cond is None else (cond | m)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def title_case(c: Column | str) -> Column:
    """Trimmed ``initcap``.  Equal to Python ``str.title`` for space-separated words;
    it differs after other separators (``ngo-operated``)."""
    return F.initcap(F.lower(F.trim(_c(c).cast("string"))))
