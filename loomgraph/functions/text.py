"""String functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_STOP = "the a an of in on at for to and or with about who what where when why how is are was were does do did which that all show find related involving connected within hops hop entities entity events event companies company".split()
SEARCH_STOP = "the a an of in on at for to and or with about who what where when why how is are was were all show".split()
TITLES = "dr prof mr mrs ms miss sir".split()


def squeeze(c: Column) -> Column:
    """One space between words, none around."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def norm(c: Column) -> Column:
    return F.lower(squeeze(c))


def query_tokens(c: Column, stop: list[str] = QUERY_STOP) -> Column:
    """Words of two letters or more that are not stop words."""
    parts = F.split(F.regexp_replace(norm(c), r"[(),]", " "), r"(?U)\s+")
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~x.isin(*stop))


def py_query_tokens(text: str, stop: list[str] = QUERY_STOP) -> list[str]:
    return [w for w in re.sub(r"[(),]", " ", " ".join(text.lower().split())).split() if len(w) > 1 and w not in stop]


def normalize_entity_name(c: Column) -> Column:
    """Lower case, without a leading title (also one glued to the name, as far as it matches) and a trailing generation, one space."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^(?:mr|mrs|ms|dr|prof)\.?\s*", "")
    return squeeze(F.regexp_replace(c, r"\s+(?:jr|sr|ii|iii|iv)\.?$", ""))


def sanitize_identifier(c: Column, default: str = "UNKNOWN") -> Column:
    """Upper-case identifier of letters, digits and single underscores; digits in front get an underscore."""
    s = F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z_]", "_"), r"_+", "_")
    s = F.upper(F.regexp_replace(s, r"^_+|_+$", ""))
    s = F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)
    return F.when(s.rlike(r"^\d"), F.concat(F.lit("_"), s)).otherwise(s)


def contains_word(text: Column, term: Column) -> Column:
    """Whole-word, case-insensitive containment; the term may hold any characters."""
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return (F.length(F.trim(term)) > 0) & F.regexp_count(text, quoted).__gt__(0)


def redact(c: Column) -> Column:
    """Keys and tokens of the usual services, and values after key-like names."""
    c = F.regexp_replace(c, r"(?i)\b(sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{8,}", "[REDACTED]")
    return F.regexp_replace(c, r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*)(\"?)[^\s\"]+", "$1$2[REDACTED]")


def relation_cues(rel: Column) -> Column:
    """The relation as a phrase, then its parts of three letters or more, each once."""
    parts = F.split(F.lower(rel), "[_\\-\\s]+")
    return F.array_distinct(F.concat(F.array(F.array_join(F.filter(parts, lambda x: x != ""), " ")), F.filter(parts, lambda x: F.length(x) >= 3)))


NEGATIONS = ["no longer", "never", "did not", "does not", "do not", "is not", "was not", "are not", "were not", "cannot", "can't", "won't", "ceased to", "stopped", "discontinued", "discontinue"]
MAKING = ("produces", "produce", "produced", "manufactures", "manufacture", "makes", "make")


def negated(window: Column, rel: Column) -> Column:
    """A cue of negation in a window that also names the first part of the relation (of four letters or more), or for a relation of making any such verb."""
    w = F.lower(window)
    cue = F.lit(False)
    for n in NEGATIONS:
        cue = cue | w.contains(n)
    stem = F.lower(F.element_at(F.split(rel, "_"), 1))
    making = stem.isin(*MAKING) & (w.contains("produc") | w.contains("manufactur") | w.contains("mak"))
    return F.coalesce(cue & (((F.length(stem) >= 4) & w.contains(stem)) | making), F.lit(False))


def base_name(c: Column) -> Column:
    """A relation name without a passive ending."""
    return F.regexp_replace(F.lower(F.trim(c)), r"_(?:by|of|from|in|at|to)$", "")


def role_relation(c: Column) -> Column:
    """'chief executive' becomes CHIEF_EXECUTIVE_OF; a role that ends so stays."""
    s = F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", ""))
    return F.when(s.endswith("_OF"), s).otherwise(F.concat(s, F.lit("_OF")))


def slug(c: Column) -> Column:
    """Lower case, words joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def without_ends(rel: Column, source: Column, target: Column) -> Column:
    """A relation's name without the words of its ends' types, but for what would leave nothing."""
    words = F.split(slug(rel), "_")
    kept = F.filter(words, lambda w: ~F.array_contains(F.concat(F.split(slug(source), "_"), F.split(slug(target), "_")), w))
    kept = F.filter(kept, lambda w: w != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "_")).otherwise(slug(rel))
