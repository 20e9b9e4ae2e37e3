"""Partial dates (YYYY, YYYY-MM, YYYY-MM-DD or an instant) as strings; bounds compare as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()


# no text is two of these; whole days are tried first, as most dates are
_DAY, _YEAR, _MONTH, _INSTANT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}$", r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ].+$"


def precision(c: Column) -> Column:
    return F.when(c.rlike(_DAY), "day").when(c.rlike(_YEAR), "year").when(c.rlike(_MONTH), "month").when(c.rlike(_INSTANT), "instant")


def lo(c: Column) -> Column:
    """First day; an instant stays; null for what is no date."""
    return F.when(c.rlike(_DAY), c).when(c.rlike(_YEAR), F.concat(c, F.lit("-01-01"))).when(c.rlike(_MONTH), F.concat(c, F.lit("-01"))).when(c.rlike(_INSTANT), c)


def hi(c: Column) -> Column:
    """Last day; null for an impossible month."""
    return F.when(c.rlike(_DAY), c).when(c.rlike(_YEAR), F.concat(c, F.lit("-12-31"))).when(c.rlike(_MONTH), F.last_day(F.try_to_date(c, "yyyy-MM")).cast("string")).when(c.rlike(_INSTANT), c)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 (one holds the other) or 1."""
    return (
        F.when(lo(a).isNull() | lo(b).isNull(), None).when(hi(a) < lo(b), -1).when(lo(a) > hi(b), 1)
        .when(((lo(a) <= lo(b)) & (hi(a) >= hi(b))) | ((lo(b) <= lo(a)) & (hi(b) >= hi(a))), 0).when(lo(a) < lo(b), -1).otherwise(1)
    )


def active_at(start: Column, end: Column, day: Column) -> Column:
    """True without any scope; false for a day that cannot be read."""
    none = start.isNull() & end.isNull()
    inside = F.coalesce(lo(start), F.lit("0000")) <= hi(day)
    inside = inside & (F.coalesce(hi(end), F.lit("9999-99")) >= lo(day))
    return none | F.coalesce(inside, F.lit(False))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed intervals; a missing bound is open, a missing scope overlaps all."""
    return (F.coalesce(lo(s1), F.lit("0000")) <= F.coalesce(hi(e2), F.lit("9999-99"))) & (F.coalesce(lo(s2), F.lit("0000")) <= F.coalesce(hi(e1), F.lit("9999-99")))


def _month(name: Column) -> Column:
    out = None
    for k, m in enumerate(MONTHS):
        hit = F.lower(F.substring(name, 1, 3)) == m[:3]
        out = F.when(hit, f"{k + 1:02d}") if out is None else out.when(hit, f"{k + 1:02d}")
    return out


_NAMES = "(?i)\\b(" + "|".join([*MONTHS, *(m[:3] for m in MONTHS), "sept"]) + ")"


def parse_span(c: Column) -> Column:
    """(start, end, precision) of free text: an ISO day or instant, YYYY-MM, a range of years, 'Month DD, YYYY', 'DD Month YYYY', 'Month YYYY', a year of 1900 to 2099; null for none."""
    t = F.trim(c)
    part = lambda p, i: F.regexp_extract(t, p, i)
    span = lambda a, kind, b=None: F.struct(a.alias("start"), (a if b is None else b).alias("end"), F.lit(kind).alias("precision"))
    day = part(r"^(\d{4}-\d{2}-\d{2})(?!\d)", 1)
    month = part(r"^(\d{4}-\d{2})$", 1)
    years2 = r"^(\d{4})\s*[-\u2013]\s*(\d{4})$"
    mdy, dmy, my = _NAMES + r"\.?\s+(\d{1,2}),?\s+(\d{4})\b", r"\b(\d{1,2})\s+" + _NAMES.replace("\\b", "") + r"\.?\s+(\d{4})\b", _NAMES + r"\.?\s+(\d{4})\b"
    year = part(r"\b((?:19|20)\d{2})\b", 1)
    ok = lambda d: d.cast("int").between(1, 31)
    two = lambda d: F.lpad(d, 2, "0")
    return (
        F.when(day != "", span(day, "day")).when(month != "", span(month, "month"))
        .when(part(years2, 1) != "", span(F.least(part(years2, 1), part(years2, 2)), "year", F.greatest(part(years2, 1), part(years2, 2))))
        .when((part(mdy, 3) != "") & ok(part(mdy, 2)), span(F.concat_ws("-", part(mdy, 3), _month(part(mdy, 1)), two(part(mdy, 2))), "day"))
        .when((part(dmy, 3) != "") & ok(part(dmy, 1)), span(F.concat_ws("-", part(dmy, 3), _month(part(dmy, 2)), two(part(dmy, 1))), "day"))
        .when(part(my, 2) != "", span(F.concat_ws("-", part(my, 2), _month(part(my, 1))), "month"))
        .when(year != "", span(year, "year"))
    )


def parse_timestamp(c: Column) -> Column:
    """The start of parse_span."""
    return parse_span(c)["start"]


def year_scope(window: Column, rel: Column | None = None) -> Column:
    """(start, end, precision): years of a window; a range of years, else the first of them with an open end; null without years, or where the window names no cue of the relation."""
    from .text import relation_cues

    y = r"\b((?:19|20)\d{2})\b"
    both = y + r"\s*(?:-|to|until|through)\s*" + y
    a, b = (F.regexp_extract(window, "(?i)" + both, i) for i in (1, 2))
    first = F.get(years(window), F.lit(0))
    none = F.lit(None).cast("string")
    out = F.when(a != "", F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.lit("year").alias("precision"))).when(first.isNotNull(), F.struct(first.alias("start"), none.alias("end"), F.lit("year").alias("precision")))
    if rel is None:
        return out
    low = F.lower(window)
    return F.when(F.exists(relation_cues(rel), lambda x: F.contains(low, x)), out)


def years(c: Column) -> Column:
    """The distinct years of a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1)))
