"""Entity resolution, coreference and relationship classes."""

from __future__ import annotations

import bisect
import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.plans.session import checkpoint


def _norm(name: str) -> str:
    s = re.sub(r"^(?:mr|mrs|ms|dr|prof)\.?\s*", "", name.strip().lower())
    return " ".join(re.sub(r"\s+(?:jr|sr|ii|iii|iv)\.?$", "", s).split())


def similarity(a: str, b: str) -> float:
    """1 for equal names, 0 for two different single words, more for one within the other, else the ratio of matching blocks."""
    a, b = _norm(a), _norm(b)
    if a == b:
        return 1.0
    wa, wb = a.split(), b.split()
    if len(wa) == 1 and len(wb) == 1:
        return 0.0
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    short, long_ = sorted((a, b), key=len)
    if short and re.search(rf"(?<!\w){re.escape(short)}(?!\w)", long_):
        return max(min(0.95, max(0.75, 0.75 + 0.25 * len(short) / len(long_))), ratio)
    return ratio


def threshold_for(a: str, b: str, base: float = 0.65) -> float:
    """Less for one name within the other, and for short names."""
    short, long_ = sorted((len(a), len(b)))
    x, y = _norm(a), _norm(b)
    if (x in y or y in x) and short >= 3:
        return 0.3
    if short < 5 and long_ > 10:
        return max(0.4, base - 0.25)
    if short < 8:
        return max(0.5, base - 0.15)
    return max(0.55, base - 0.1) if short < 10 else base


def blended(a: str, b: str, va=None, vb=None, weight: float = 0.7) -> float:
    """Similarity of names, or with embeddings of both a blend with their cosine; at least 0.75 where one name is a good part of the other."""
    s = similarity(a, b)
    if va is None or vb is None or len(va) != len(vb):
        return s
    dot, na, nb = sum(x * y for x, y in zip(va, vb)), sum(x * x for x in va), sum(x * x for x in vb)
    cos = max(0.0, min(1.0, dot / (na * nb) ** 0.5)) if na and nb else 0.0
    out = weight * cos + (1 - weight) * s
    x, y = sorted((_norm(a), _norm(b)), key=len)
    return max(out, 0.75) if x in y and len(x) >= 3 and len(x) / len(y) > 0.2 else out


def resolve_names(names: list[str], kind: str, base: float = 0.65, margin: float = 0.08, vectors: dict | None = None) -> dict[str, str]:
    """name to canonical name for the names of one type in their order; nothing for a single name.

    A name joins the best group that it may join if that is better than the next by the margin; else it founds one with all later names
    alike, which the longest stands for.  Different single words never join; a single word that two longer names hold joins neither of them
    as a person; persons with two names or more must agree in the last.
    """
    if len(names) <= 1:
        return {}
    person, vec = kind.lower() == "person", vectors or {}
    tok = {n: _norm(n).split() for n in names}
    long_words: dict[str, int] = {}
    for n in names:
        if len(tok[n]) > 1:
            for w in set(tok[n]):
                long_words[w] = long_words.get(w, 0) + 1

    def may(a: str, b: str) -> bool:
        x, y = tok[a], tok[b]
        if x == y:
            return True
        if len(x) == 1 and len(y) == 1:
            return False
        if person:
            for one, many in ((x, y), (y, x)):
                if len(one) == 1 and len(many) > 1 and one[0] in many and long_words.get(one[0], 0) > 1:
                    return False
            if len(x) > 1 and len(y) > 1:
                return x[-1] == y[-1]
        return True

    def score(a: str, b: str) -> float | None:
        s = blended(a, b, vec.get(a), vec.get(b)) if may(a, b) else -1.0
        return s if s >= threshold_for(a, b, base) else None

    out: dict[str, str] = {}
    heads: list[str] = []
    for i, n in enumerate(names):
        if n in out:
            continue
        found = sorted(((s, -k, h) for k, h in enumerate(heads) if (s := score(n, h)) is not None), reverse=True)
        if found and (len(found) == 1 or found[0][0] - found[1][0] >= margin):
            out[n] = found[0][2]
            continue
        group = [n, *dict.fromkeys(m for m in names[i + 1 :] if m not in out and m != n and score(n, m) is not None)]
        head = max(group, key=len)
        heads.append(head)
        out |= dict.fromkeys(group, head)
    return out


def resolve(mentions: DataFrame, threshold: float = 0.65, margin: float = 0.08) -> DataFrame:
    """(type, name, canonical) for mentions (type, name, order and embedding if there are any): alike names of a type become one.

    Names that share no word and no first three letters of a word cannot be alike by what `resolve_names` asks of a pair (equal, one within the
    other, or a ratio above the threshold of names with a word in common), so a type falls apart into components of such names; each is a task.
    """
    m = mentions.where("name IS NOT NULL")
    order = F.min("order") if "order" in m.columns else F.min("name")
    vec = F.first("embedding", ignorenulls=True) if "embedding" in m.columns else F.lit(None).cast("array<double>")
    m = checkpoint(m.groupBy("type", "name").agg(order.alias("order"), vec.alias("embedding")))
    norm = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"^(?:mr|mrs|ms|dr|prof)\.?\s*", ""), r"\s+(?:jr|sr|ii|iii|iv)\.?$", "")
    words = F.filter(F.split(norm, r"(?U)\s+"), lambda w: w != "")
    keys = m.select(F.concat_ws("\x01", F.coalesce("type", F.lit("")), "name").alias("node_id"), "type", F.explode(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 3)))).alias("k"))
    first = keys.groupBy("type", "k").agg(F.min("node_id").alias("source"), F.max("node_id").alias("z")).where("source < z").select("type", "k", "source")
    e = keys.join(first, [keys["type"].eqNullSafe(first["type"]), keys["k"] == first["k"]]).where("node_id <> source").select("source", F.col("node_id").alias("target")).distinct()
    nodes = keys.select("node_id").distinct()
    from .analytics import components

    g = Graph(nodes, e.withColumns({"edge_id": F.concat_ws(">", "source", "target"), "rel": F.lit("alike")}), nodes.select(F.lit("").alias("cluster_id"), "node_id").limit(0))
    part = components(g).withColumnRenamed("node_id", "id")
    m = m.withColumn("id", F.concat_ws("\x01", F.coalesce("type", F.lit("")), "name")).join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "name"])
        names, kind = pdf["name"].tolist(), pdf["type"].iloc[0]
        vectors = {n: v for n, v in zip(names, pdf["embedding"]) if v is not None}
        own = resolve_names(names, kind or "", threshold, margin, vectors)
        return pd.DataFrame({"type": [kind] * len(names), "name": names, "canonical": [own.get(n, n) for n in names]})

    return m.select("component", "type", "name", "order", "embedding").groupBy("component").applyInPandas(group, "type string, name string, canonical string")


PRONOUNS = dict.fromkeys(("he", "him", "his"), "male") | dict.fromkeys(("she", "her", "hers"), "female") | dict.fromkeys(("it", "its"), "neutral") | dict.fromkeys(("they", "them", "their", "theirs"), "plural")


def resolve_pronoun(pronoun: str, text: str, entities: list[tuple[str, str]], least: float = 0.85, lead: float = 0.15) -> tuple[str, float] | None:
    """(entity, score) for the first place of a pronoun: entities before it in its sentence, the nearer the better; else those of the two sentences before; else the only person.

    The best must reach `least` and lead the next by `lead`; ties and close calls are left open.
    """
    p, kind = pronoun.lower(), PRONOUNS[pronoun.lower()]
    m = re.search(rf"(?i)(?<!\w){re.escape(p)}(?!\w)", text)
    if not m:
        return None
    cuts = [x.end() for x in re.finditer(r"[.!?]", text)]
    k = bisect.bisect_right(cuts, m.start())
    bound = [0, *cuts, len(text)]
    sents = [text[a:b].strip().lower() for a, b in zip(bound[:-1], bound[1:])]
    found: list[tuple[float, str]] = []
    gendered, person = kind in ("male", "female"), {e for e, t in entities if t == "Person"}
    words = re.findall(r"\w+", sents[k])
    here = words.index(p) if p in words else -1
    for e, t in entities:
        before = [i for i, w in enumerate(words[: max(here, 0)]) if any(x in w for x in e.lower().split())]
        if before:
            fits = (gendered and t == "Person") or (kind == "neutral" and t != "Person")
            found.append(((1.5 if fits else 1.0) / (1 + 0.2 * (here - before[-1])), e))
    if not found or max(found)[0] < 0.7:
        for s in [sents[j] for j in (k - 1, k - 2) if j >= 0 and sents[j]]:
            if gendered and sum(e.lower() in s for e in person) >= 2:
                continue
            there = sorted((s.find(e.lower()), e, t) for e, t in entities if e.lower() in s)
            for rank, (_, e, t) in enumerate(there):
                fits = (gendered and t == "Person") or (kind == "neutral" and t and t != "Person")
                found.append(((0.7 if rank else 0.9) * (1.1 if fits else 1.0), e))
    if not found and gendered and len(person) == 1:
        found = [(0.9, next(iter(person)))]
    found.sort(key=lambda x: (-x[0], x[1]))
    if found and found[0][0] >= least and (len(found) == 1 or found[0][0] - found[1][0] >= lead):
        return found[0][1], found[0][0]
    return None


def coreference(docs: DataFrame) -> DataFrame:
    """(doc_id, pronoun, entity, score) for rows (doc_id, text, entities ARRAY<STRUCT<name, type>>): what each pronoun of a text stands for, where that is clear."""

    def run(batches):
        for b in batches:
            out = []
            for doc, text, ents in zip(b["doc_id"], b["text"], b["entities"]):
                own = [] if ents is None else [(e["name"], e["type"]) for e in ents]
                said = {w.lower() for w in re.findall(r"\w+", text or "")} & set(PRONOUNS)
                out += [(doc, p, *hit) for p in sorted(said) if own and (hit := resolve_pronoun(p, text, own))]
            yield pd.DataFrame(out, columns=["doc_id", "pronoun", "entity", "score"])

    return docs.select("doc_id", "text", "entities").mapInPandas(run, "doc_id bigint, pronoun string, entity string, score double")


def replace_pronouns(triples: DataFrame, found: DataFrame) -> DataFrame:
    """Triples (doc_id, s, r, o) with the entities for which their pronouns stand."""
    for side in ("s", "o"):
        f = found.select("doc_id", F.col("pronoun").alias("__p"), F.col("entity").alias("__e"))
        triples = triples.withColumn("__p", F.lower(side)).join(f, ["doc_id", "__p"], "left").withColumn(side, F.coalesce("__e", side)).drop("__p", "__e")
    return triples


#: the relations that a class may name
TAXONOMY = sorted("belongs_to caused_by causes child_of collaborates_with communicates_with consumes contains creates destroys dislikes equivalent_to fears follows has_part hates influenced_by influences informs inside knows leaves likes located_at loves meets member_of modifies near occurs_after occurs_before occurs_during outside owns parent_of part_of produces related_to requests responds_to results_in returns_to similar_to triggers trusts visits works_with".split())
#: (relation, score, cues): cues count wherever the text holds them, also within words
CUES = [
    ("causes", 0.9, ("caused", "causes", "leads to", "results in")), ("caused_by", 0.9, ("because", "due to", "result of")), ("located_at", 0.8, ("at", "in", "located", "place")),
    ("contains", 0.8, ("contains", "has", "includes")), ("occurs_before", 0.8, ("before", "earlier", "prior")), ("occurs_after", 0.8, ("after", "later", "subsequent")),
    ("influences", 0.85, ("affects", "impacts", "influences")), ("collaborates_with", 0.85, ("collaborates", "partners", "works with")), ("owns", 0.9, ("has ownership", "owns", "possesses")),
    ("member_of", 0.85, ("belongs", "member", "part of group")), ("parent_of", 0.9, ("father", "mother", "parent")), ("child_of", 0.9, ("child", "daughter", "son")),
    ("part_of", 0.8, ("belongs to", "component", "part of")),
]
FALLBACK = {("Person", "Person"): [("related_to", 0.5), ("knows", 0.4)], ("Person", "Location"): [("located_at", 0.6), ("visits", 0.5)], ("Event", "Person"): [("influences", 0.5), ("results_in", 0.4)]}
_CLASS = "array<struct<score: double, rel: string>>"


def _classes(found: list[tuple[str, float]]):
    return F.array(*[F.struct(F.lit(s).alias("score"), F.lit(r).alias("rel")) for r, s in found]).cast(_CLASS)


def classify(pairs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Rows (text, source_type, target_type, ..) with `classes` ARRAY<STRUCT<score, rel>>: relations whose cues the text holds, else by the types, else related_to.

    With a schema (name, src, dst): what it allows for the types, with 0.8 of the score where names only contain one another; if that leaves none,
    all stay.  If the first scores 0.8 or more, the first three as they come; else the best score of each relation, greatest first, at most five.
    """
    t = F.lower("text")
    hit = [F.when(F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(t, c)), F.struct(F.lit(s).alias("score"), F.lit(r).alias("rel"))) for r, s, cues in CUES]
    by_type = None
    for (a, b), found in FALLBACK.items():
        is_ = (F.col("source_type") == a) & (F.col("target_type") == b)
        by_type = F.when(is_, _classes(found)) if by_type is None else by_type.when(is_, _classes(found))
    found = F.array_compact(F.array(*hit)).cast(_CLASS)
    out = pairs.withColumn("classes", F.when(F.size(found) > 0, found).otherwise(by_type.otherwise(_classes([("related_to", 0.3)]))))
    if allowed is not None:
        a = allowed.groupBy(F.col("src").alias("source_type"), F.col("dst").alias("target_type")).agg(F.collect_set(F.lower("name")).alias("__names"))
        out = out.join(a, ["source_type", "target_type"], "left")
        fit = F.transform("classes", lambda c: F.when(F.array_contains("__names", c["rel"]), c).when(
            F.exists("__names", lambda n: F.contains(n, c["rel"]) | F.contains(c["rel"], n)), F.struct((c["score"] * 0.8).alias("score"), c["rel"].alias("rel"))))
        fit = F.array_compact(fit)
        out = out.withColumn("classes", F.when(F.col("__names").isNotNull() & (F.size(fit) > 0), fit).otherwise(F.col("classes"))).drop("__names")
    best = F.array_sort("classes", lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(0))
    once = F.aggregate(best, F.array().cast(_CLASS), lambda acc, c: F.when(F.exists(acc, lambda d: d["rel"] == c["rel"]), acc).otherwise(F.concat(acc, F.array(c))))
    return out.withColumn("classes", F.when(F.get("classes", F.lit(0))["score"] >= 0.8, F.slice("classes", 1, 3)).otherwise(F.slice(once, 1, 5)))
