"""What comes out of a model, put in order: JSON coercion, evidence snippets, smallest windows; ontology scores."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(j: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(j, f"$.{k}")), F.lit("")) for k in keys])


def salvage(json: Column) -> Column:
    """The list of objects in what a model wrote: a list within other text, one object alone (also below a key), Python's quotes and words, a list that breaks off in the middle."""
    fence = F.regexp_replace(json, r"```(?:json)?", "")
    listed = F.regexp_extract(fence, r"(?s)(\[.*\])", 1)
    single = F.regexp_extract(fence, r"(?s)(\{.*\})", 1)
    cut = F.regexp_extract(fence, r"(?s)(\[\s*\{.*\})", 1)
    python = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?<=[\[{,:\s])'|'(?=\s*[\]},:])", '"'), r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    good = lambda c: F.try_parse_json(c).isNotNull() & (c != "")
    one = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    tries = [listed, python(listed), one(single), one(python(single)), one(F.regexp_replace(cut, r"^\[", "")), F.concat(cut, F.lit("]"))]
    out = F.when(good(tries[0]), tries[0])
    for t in tries[1:]:
        out = out.when(good(t), t)
    return out.otherwise(F.lit("[]"))


def read_mentions(rows: DataFrame) -> DataFrame:
    """(doc_id, name, type) of rows (doc_id, json): a list of objects with any of the usual keys; what has no name goes, a bad list gives nothing."""
    lists = F.from_json(salvage(F.col("json")), "array<string>")
    m = rows.select("doc_id", F.explode(lists).alias("j"))
    return m.select("doc_id", _any(F.col("j"), "name", "entity", "text", "mention").alias("name"), _any(F.col("j"), "type", "label", "entity_type").alias("type")).where("name IS NOT NULL").distinct()


def read_triples(rows: DataFrame) -> DataFrame:
    """(doc_id, s, r, o, confidence, is_negated) of rows (doc_id, json)."""
    lists = F.from_json(salvage(F.col("json")), "array<string>")
    t = rows.select("doc_id", F.explode(lists).alias("j"))
    j = F.col("j")
    return t.select(
        "doc_id", _any(j, "source", "subject", "s", "head").alias("s"), _any(j, "relation", "relationship", "predicate", "r", "type").alias("r"), _any(j, "target", "object", "o", "tail").alias("o"),
        F.expr("try_cast(get_json_object(j, '$.confidence') AS double)").alias("confidence"), F.coalesce(_any(j, "is_negated", "negated") == "true", F.lit(False)).alias("is_negated"),
    ).where("s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL")


def align_documents(triples: DataFrame, docs: DataFrame) -> DataFrame:
    """Triples (s, r, o) with `description` of docs(s, r, o, description): the exact triple's, else the relation's if it has only one."""
    exact = docs.groupBy("s", "r", "o").agg(F.min("description").alias("exact"))
    one = docs.groupBy("r").agg(F.countDistinct("description").alias("n"), F.min("description").alias("only")).where("n = 1").drop("n")
    return triples.join(exact, ["s", "r", "o"], "left").join(one, "r", "left").withColumn("description", F.coalesce("exact", "only")).drop("exact", "only")


def snippet(text: str, s: str, o: str, rel: str, most: int = 240) -> str:
    """The sentence that holds both names and a cue of the relation, else the shortest stretch with both, cut to `most` characters."""
    low = lambda x: x.lower()
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n", text or "") if p.strip()]
    both = [p for p in parts if low(s) in low(p) and low(o) in low(p)]
    cues = [c for c in re.split(r"[_\s-]+", rel.lower()) if len(c) > 2]
    best = next((p for p in both if any(c in low(p) for c in cues)), both[0] if both else None)
    if best is None:
        a, b = ([m.span() for m in re.finditer(re.escape(low(x)), low(text or ""))] for x in (s, o))
        pairs = [(max(p[1], q[1]) - min(p[0], q[0]), min(p[0], q[0]), max(p[1], q[1])) for p in a for q in b]
        if not pairs or min(pairs)[0] > 2500:
            return ""
        _, x, y = min(pairs)
        best = ("..." if x else "") + text[x:y] + ("..." if y < len(text) else "")
    return best if len(best) <= most else best[: most - 3] + "..."


def snippets(triples: DataFrame, docs: DataFrame) -> DataFrame:
    """Triples (doc_id, s, r, o) with their snippet."""

    @F.pandas_udf("string")
    def run(text: pd.Series, s: pd.Series, r: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, a, c, b) for t, a, b, c in zip(text, s, r, o)])

    return triples.join(docs.select("doc_id", "text"), "doc_id").withColumn("snippet", run("text", "s", "r", "o")).drop("text")


def smallest_window(text: str, names: list[str], most: int = 280) -> str:
    """The shortest stretch of a text that holds each of up to four names, cut to `most` characters; '' without one."""
    names = list(dict.fromkeys(n.lower() for n in names if n))[:4]
    found = sorted((m.start(), m.end(), k) for k, n in enumerate(names) for m in re.finditer(re.escape(n), (text or "").lower()))
    have, left, best = {}, 0, None
    for a, b, k in found:
        have[k] = have.get(k, 0) + 1
        while names and len(have) == len(names):
            x, _, j = found[left]
            if best is None or b - x < best[1] - best[0]:
                best = (x, b)
            have[j] -= 1
            if not have[j]:
                del have[j]
            left += 1
    return text[best[0] : best[1]][:most] if best else ""


def windows_of(rows: DataFrame, most: int = 280) -> DataFrame:
    """Rows (text, names ARRAY) with `window`: smallest_window of each, by an Arrow function."""

    @F.pandas_udf("string")
    def run(text: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([smallest_window(t, [] if n is None else list(n), most) for t, n in zip(text, names)])

    return rows.withColumn("window", run("text", "names"))


def read_events(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Events (id, event_type, participants, ts, location, evidence, confidence, doc_id) of rows (doc_id, json): lists of objects with any of the usual keys.

    Types are matched in any case and spelling to types(event_type); others go, and so do repeated ids; a participant may be a name or a list of names.
    """
    from .events import event_id

    j = F.col("j")
    e = rows.select("doc_id", F.explode(F.from_json(salvage(F.col("json")), "array<string>")).alias("j"))
    who = F.coalesce(F.get_json_object(j, "$.participants"), F.get_json_object(j, "$.arguments"), F.get_json_object(j, "$.roles"))
    names = F.transform_values(F.from_json(who, "map<string, string>"), lambda k, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))
    e = e.select(
        "doc_id", _any(j, "event_type", "type", "event").alias("said"), names.alias("participants"), _any(j, "timestamp", "date", "time", "when").alias("ts"), _any(j, "location", "place").alias("location"),
        _any(j, "evidence", "snippet", "trigger").alias("evidence"), F.expr("try_cast(get_json_object(j, '$.confidence') AS double)").alias("confidence"),
    )
    k = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\\s_-]+", "")
    t = types.select("event_type").distinct().groupBy(k(F.col("event_type")).alias("k")).agg(F.min("event_type").alias("event_type"))
    e = e.join(t, k(F.col("said")) == F.col("k")).where("participants IS NOT NULL AND size(participants) > 0")
    e = e.withColumn("id", event_id(F.col("event_type"), F.col("participants"), F.col("ts"), F.col("evidence")))
    cols = ("event_type", "participants", "ts", "location", "evidence", "confidence", "doc_id")
    return e.groupBy("id").agg(F.min_by(F.struct(*cols), "doc_id").alias("e")).select("id", "e.*")


