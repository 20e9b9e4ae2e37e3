"""Ontologies: reading, lookups and the sanitising passes.

types(idx, name, description, examples) and relations(idx, group_name, name, src, dst, description), where `idx` is the order
of declaration.  An ontology is small (tens or hundreds of rows), but every pass is a DataFrame program.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIMITIVE = sorted("version value timestamp time string quantity price period percentage percent number month interval integer float duration day datetime date count cost boolean amount year".split())
_TYPES = "idx bigint, name string, description string, examples array<string>, properties string"
_RELATIONS = "idx bigint, group_name string, name string, src string, dst string, description string, detail string, properties string"
AUTO = "Auto-generated entity type"


def read_schema(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(types, relations, events, groups) of a JSON ontology, in the grouped form or as plain lists.

    events(event_type, role, required) are the declared types of events, groups(group_name, kind, examples) all groups with their examples as JSON.
    """
    d = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    end = lambda r, a, b: r.get(a) or r.get(b)
    text = lambda x: json.dumps(x, ensure_ascii=False) if x else None
    kind = lambda t: t if isinstance(t, dict) else {"name": t}
    rel = lambda g, r: (g, r["name"], end(r, "source", "src"), end(r, "target", "dst"), r.get("description"), r.get("detail"), text(r.get("properties")))
    grouped = "entity_types" in d
    types = [kind(t) for t in d["entity_types" if grouped else "entities"]] if ("entity_types" in d or "entities" in d) else []
    types = [(k, t["name"], (t.get("description") or "").strip() or AUTO, (t.get("examples") or [])[:20], text(t.get("properties"))) for k, t in enumerate(types)]
    rels = [rel(g["name"], r) for g in d.get("relation_groups", []) for r in g["relations"]] if grouped else [rel("default", r) for r in d.get("relations", [])]
    events = [(e["name"], role, role in (e.get("required_roles") or [])) for e in d.get("event_types", []) for role in {**dict.fromkeys(e.get("required_roles") or []), **dict.fromkeys(e.get("roles") or [])}]
    groups = [(g["name"], k, json.dumps(g.get("examples") or [])) for k in ("relation_groups", "entity_groups", "property_groups") for g in d.get(k, [])]
    return (
        spark.createDataFrame(types, _TYPES), spark.createDataFrame([(k, *r) for k, r in enumerate(rels)], _RELATIONS),
        spark.createDataFrame(events, "event_type string, role string, required boolean"), spark.createDataFrame(groups, "group_name string, kind string, examples string"),
    )


def relations_of(relations: DataFrame, entity_type: str) -> DataFrame:
    return relations.where((F.col("src") == entity_type) | (F.col("dst") == entity_type))


def in_order(df: DataFrame) -> DataFrame:
    """Rows with `idx`; without one they go by their columns."""
    if "idx" in df.columns:
        return df
    return df.withColumn("idx", F.row_number().over(Window.orderBy(*df.columns)).cast("bigint"))  # an ontology is small


def key(c: Column) -> Column:
    """A name for comparison: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[ \-]", "_")


# ---- vocabularies

_SYNONYMS = {
    "develops": "builds built create created creates develop developed developed_product developed_products developing develops_product develops_products makes manufactured manufactures produce produced produces",
    "partnered_with": "collaborated_with entered_agreement_with entered_into_agreement_with formed_agreement_with formed_partnership_with made_agreement_with partnered partners_with signed_agreement_with",
    "headquartered_in": "has_headquarters_in has_hq_in headquartered_at", "employs": "employ employed has_employee has_employees hired hires",
}
RELATION_NAMES = {w: to for to, words in _SYNONYMS.items() for w in words.split()}
TYPE_NAMES = dict.fromkeys("business companies company corp corporation enterprise firm institution organisation".split(), "Organization")
ARTIFACT_NAMES = dict.fromkeys("app application device framework hardware library operating_system operatingsystem os platform service software software_suite softwareapplication softwaresuite tool".split(), "Product")
GROUP_NAMES = dict.fromkeys([f"product_{x}" for x in "and_technology and_technology_lifecycle association development lifecycle usage".split()] + ["products_and_technology"], "Product & Technology")
_ROLE_WORDS = sorted("agency app application authority business city companies company concept corp corporation country device discipline employee event field firm founder fundinground government governmentbody hardware human idea incident individual institution legalcase location milestone operatingsystem org organisation organization os people person place platform product products region regulation software team technologies technology topic user".split())
_EMPTY_WORDS = "a an as at be been being by for from get gets got had has have in is are of on the to was were with".split()
_SUFFIXES = [f"_{x}" for x in "product products company companies person people os software hardware institution by for from into at as".split()]


def _table(pairs: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def endpoint_free(name: Column) -> Column:
    """A relation's name without one leading and one trailing word for a kind of entity, as long as a word of meaning is left."""
    meaning = lambda p: F.size(F.filter(p, lambda w: ~w.isin(*_ROLE_WORDS, *_EMPTY_WORDS))) > 0
    p = F.split(key(name), "_")
    tail = F.slice(p, F.lit(2), F.greatest(F.lit(0), F.size(p) - 1))
    p = F.when((F.size(p) > 1) & F.get(p, F.lit(0)).isin(*_ROLE_WORDS) & meaning(tail), tail).otherwise(p)
    head = F.slice(p, F.lit(1), F.greatest(F.lit(0), F.size(p) - 1))
    p = F.when((F.size(p) > 1) & F.element_at(p, -1).isin(*_ROLE_WORDS) & meaning(head), head).otherwise(p)
    return F.array_join(p, "_")


def base_name(name: Column) -> Column:
    """A relation's name without the first of the endings for kinds and directions that it has."""
    k = key(name)
    out = None
    for s in _SUFFIXES:
        hit = k.endswith(s) & (F.length(k) > len(s))
        cut = F.substring(k, F.lit(1), F.length(k) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(k)


# ---- passes, in the order of `sanitise`


def canonical_relations(relations: DataFrame) -> DataFrame:
    """Names that mean the same become one, without words for the kinds of their ends."""
    k = key(F.col("name"))
    new = endpoint_free(F.coalesce(_table(RELATION_NAMES, k), k))
    return relations.withColumn("name", F.when(new == k, F.col("name")).otherwise(new))


def canonical_types(types: DataFrame, relations: DataFrame, artifacts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kinds of entities that mean the same become one (also kinds of products, if asked): examples are united, the description of the one that had the name counts."""
    names = TYPE_NAMES | (ARTIFACT_NAMES if artifacts else {})
    to = lambda c: F.coalesce(_table(names, key(c)), c)
    t = in_order(types)
    for c in ("description", "properties"):
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("string"))
    if "examples" not in t.columns:
        t = t.withColumn("examples", F.array().cast("array<string>"))
    t = t.withColumns({"to": to(F.col("name")), "own": F.col("name") != to(F.col("name"))})
    best = F.struct("own", "idx")
    one = t.groupBy("to").agg(
        F.min("idx").alias("idx"), F.min_by("description", best).alias("description"), F.min_by("properties", best).alias("properties"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("examples", F.array().cast("array<string>")).alias("e")))), lambda x: x["e"]))).alias("examples"),
    )
    return one.withColumnRenamed("to", "name").select("idx", "name", "description", "examples", "properties"), relations.withColumns({c: to(F.col(c)) for c in ("src", "dst")})


def merge_groups(relations: DataFrame) -> DataFrame:
    """Groups of relations that are parts of one family become one; spellings of a name become the first one."""
    r = in_order(relations)
    name = F.coalesce(_table(GROUP_NAMES, key(F.regexp_replace("group_name", "&", "and"))), F.col("group_name"))
    first = r.groupBy(key(name).alias("k")).agg(F.min_by(name, "idx").alias("g"))
    return r.withColumn("k", key(name)).join(first, "k").withColumn("group_name", F.col("g")).drop("k", "g").select(*r.columns)


def drop_primitive(types: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types of plain values go, and the relations at them."""
    bad = lambda c: F.lower(F.trim(c)).isin(*PRIMITIVE)
    return types.where(~bad(F.col("name"))), relations.where(~bad(F.col("src")) & ~bad(F.col("dst")))


def repair_ends(types: DataFrame, relations: DataFrame) -> DataFrame:
    """Ends in the spelling of the types; relations with unknown ends go."""
    t = in_order(types).groupBy(key(F.col("name")).alias("__k")).agg(F.min_by("name", "idx").alias("__t"))
    for side in ("src", "dst"):
        relations = relations.join(t, key(F.col(side)) == F.col("__k")).withColumn(side, F.col("__t")).drop("__k", "__t")
    return relations


def _firsts(relations: DataFrame, *keys: Column) -> DataFrame:
    r = in_order(relations)
    return r.groupBy(*[k.alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*r.columns), "idx").alias("b")).select("b.*")


def distinct_relations(relations: DataFrame) -> DataFrame:
    """The first of the relations of equal (name, src, dst) in any spelling."""
    return _firsts(relations, *[key(F.col(c)) for c in ("name", "src", "dst")])


def distinct_meanings(relations: DataFrame) -> DataFrame:
    """The first of the relations whose names differ in an ending only, for the same ends either way."""
    a, b = key(F.col("src")), key(F.col("dst"))
    return _firsts(relations, base_name(F.col("name")), F.least(a, b), F.greatest(a, b))


def distinct_groups(relations: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Of groups (rows of relations with another spelling of a group's name) the first stays."""
    r = in_order(relations)
    first = r.groupBy(key(F.col("group_name")).alias("k")).agg(F.min_by("group_name", "idx").alias("g"))
    return r.join(first, (key(F.col("group_name")) == F.col("k")) & (F.col("group_name") == F.col("g")), "left_semi")


_ROLES = {
    "actor": "company|corporation|organi[sz]ation|institution|government|agency|authority|body|ministry|department|firm|entity|party|person|individual|human|employee|staff|user|founder|ceo|executive|leader|director|manager|officer|team|group|committee",
    "artifact": "product|hardware|software|device|tool|system|platform|application|service|framework|library|module|component|infrastructure|feature|interface|protocol|format|standard|specification|document|report|publication|asset|resource",
    "place": "location|place|region|country|city|state|area|territory|site|address|venue|building|campus|headquarters|office|facility",
    "occurrence": "event|transaction|merger|acquisition|process|incident|milestone|deal|agreement|round|phase|stage|period|lawsuit|trial|campaign|conflict|war|launch|release|meeting|conference",
}


def role(c: Column) -> Column:
    """actor, artifact, place, occurrence or unknown, by what a type's name holds."""
    out = None
    for name, words in _ROLES.items():
        hit = F.lower(c).rlike(words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


_A, _P = ("actor", "unknown"), ("place", "unknown")
#: (pattern of the name, roles allowed at the source, at the target); the first that fits decides
_FITTING = [
    ("antitrust|audit|charg|compliance|examin|fine|investigat|lawsuit|legal_action|penalt|prosecut|regulat|sanction|scrutin", _A, _A),
    ("market_cap|valuat|valued?_(?:above|at|over)|worth_(?:above|over)", _A, _A),
    ("accus|blam|censur|condemn|critici[sz]|fault|reproach", _A, _A),
    ("based_in|founded_in(?!_year)|headquarter|incorporated_in|located_in|operates_in|presence_in|registered_in", _A, _P),
    ("employ|hired_by|member_of_org|reports_to|staff_of|works?_for", _A, _A),
    ("_on$|_when$|(?:established|founded|incorporated|ipo|launched|listed|started)_on|went_public", None, ("actor", "artifact", "place", "unknown")),
    ("diversif.*into|enter.*(?:domain|industry|market|sector)|expan.*into|expand_to|moved_into|pivot.*to", _A, _P),
]


def fitting_roles(relations: DataFrame) -> DataFrame:
    """Relations whose ends can play the parts that the relation's name asks for."""
    s, d = role(F.col("src")), role(F.col("dst"))
    ok = None
    for pattern, source, target in _FITTING:
        hit = F.lower("name").rlike(pattern)
        fits = (s.isin(*source) if source else F.lit(True)) & d.isin(*target)
        ok = F.when(hit, fits) if ok is None else ok.when(hit, fits)
    return relations.where(ok.otherwise(F.lit(True)))


_ONE_OFF = "|".join([
    "^(?:announced|features|for_hardware|introduced|is_a|is_brand_of|launched|marketed|named_by|owns|relocated_to|unveiled|used_for)$", "(?:suggest|propos).*name",
    "(?:creat|made|generat).*(?:million|billion)aire", "filed.*(?:complaint|injunct|motion)|(?:injunction|motion)_against", "^(?:created|established|formed)_division$", "^is_extension_(?:for|of)$",
    "^(?:among_the|considered_as|known_as|one_of|ranked_as)_", "largest_by_|most_(?:influential|powerful|profitable|valuable)", "grew_to_(?:become|control|dominate)|rose_to_(?:control|dominate|lead)",
    "had_ipo|ipo_in|listed_in|went_ipo|went_public", "became_success|became.*hit", "captured.*market|dominat.*market|rose.*dominat", "^bundled_(?:with$|together)", "drew_inspiration|was_inspired_by|^inspired_by$",
    "deployed_in_operation|used_in_(?:conflict|military|operation)", "^moved_(?:headquarters|hq|.*_to$)", "^(?:replaced|succeeded|resigned)_as_|_as_ceo$|^became_ceo$",
])


def reusable(relations: DataFrame) -> DataFrame:
    """Without relations that tell of one event of one document."""
    return relations.where(~key(F.col("name")).rlike(_ONE_OFF))


#: (pattern of an unused type, pattern of a relation, the relation's new name)
_RESCUE = [
    ("lawsuit|legalcase|litigation", "^(?:filed_against|litigated_against|sued_by)$", "filed_against"), ("lawsuit|legalcase|litigation", "^(?:reached_settlement|settled_with)$", "settled_case"),
    ("^(?:directive|legislation|policy|regulation)$", "^(?:designated_as|regulated_by|subject_to_regulation)$", "subject_to"),
    ("funding_?round|investment_round", "^(?:had_valuation_of|raised_in_round|valued_at)$", "raised_in"),
]


def rescue_types(types: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that speak of a type no relation has yet end there: for each such type the first relation of the first rule that has one."""
    r, t = in_order(relations), in_order(types)
    unused = t.join(_ends(r), "name", "left_anti").select(F.col("name").alias("t"), F.col("idx").alias("ti"))
    found = None
    for k, (kind, rel, new) in enumerate(_RESCUE):
        x = unused.where(F.lower("t").rlike(kind)).crossJoin(r.where(key(F.col("name")).rlike(rel)).select("idx")).select("t", "ti", F.lit(k).alias("k"), "idx", F.lit(new).alias("new"))
        found = x if found is None else found.unionByName(x)
    best = found.groupBy("t").agg(F.min(F.struct("k", "idx", "ti", "new")).alias("b")).select("t", "b.idx", "b.ti", "b.new")
    best = best.groupBy("idx").agg(F.min_by(F.struct("t", "new"), "ti").alias("b"))  # a relation has room for one type
    both = r.join(best, "idx", "left")
    return both.withColumns({"name": F.coalesce("b.new", "name"), "dst": F.coalesce("b.t", "dst")}).drop("b").select(*r.columns)


def _ends(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("src").alias("name")).union(relations.select("dst")).distinct()


def used_types(types: DataFrame, relations: DataFrame) -> DataFrame:
    """Types at the end of some relation."""
    return types.join(_ends(relations), "name", "left_semi")


def fitting_examples(examples: DataFrame, types: DataFrame, relations: DataFrame) -> DataFrame:
    """Examples (group_name, head, relation, tail) of relations that their group has and whose ends, where they are examples of types, are of the right ones; without a relation's name an example stays."""
    r = relations.groupBy("group_name", key(F.col("name")).alias("r")).agg(F.max_by(F.struct("src", "dst"), "idx").alias("rel")) if "idx" in relations.columns else relations.groupBy("group_name", key(F.col("name")).alias("r")).agg(F.first(F.struct("src", "dst")).alias("rel"))
    known = types.select("name", F.explode("examples").alias("e")).groupBy(key(F.col("e")).alias("e")).agg(F.collect_set("name").alias("of"))
    x = examples.withColumn("r", key(F.col("relation"))).join(r, ["group_name", "r"], "left")
    x = x.join(known.select(F.col("e").alias("h"), F.col("of").alias("ho")), key(F.col("head")) == F.col("h"), "left")
    x = x.join(known.select(F.col("e").alias("t"), F.col("of").alias("to")), key(F.col("tail")) == F.col("t"), "left")
    right = lambda of, c: F.col(of).isNull() | F.coalesce(F.array_contains(of, F.col(c)), F.lit(False))
    named = F.coalesce(F.trim("relation"), F.lit("")) != ""
    return x.where(~named | (F.col("rel").isNotNull() & right("ho", "rel.src") & right("to", "rel.dst"))).select(*examples.columns)


def sanitise(types: DataFrame, relations: DataFrame, artifacts: bool = False, groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """All passes: names, kinds, groups, plain values, ends, repetitions, meanings, repeated groups, roles, one-off relations, unused types that can be used, unused types; groups without relations are gone with them."""
    types, relations = in_order(types), canonical_relations(in_order(relations))
    types, relations = canonical_types(types, relations, artifacts)
    if groups:
        relations = merge_groups(relations)
    types, relations = drop_primitive(types, relations)
    relations = distinct_groups(distinct_meanings(distinct_relations(repair_ends(types, relations))))
    relations = rescue_types(types, reusable(fitting_roles(relations)))
    return used_types(types, relations), relations


def merge_coverage(types: DataFrame, relations: DataFrame, more_types: DataFrame, more_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An ontology with what another pass found besides: types with new names, and relations with new (name, src, dst) between known types."""
    t, r = in_order(types), in_order(relations)
    add = in_order(more_types).withColumn("idx", F.col("idx") + 1_000_000).join(t.select(key(F.col("name")).alias("k")).distinct(), key(F.col("name")) == F.col("k"), "left_anti")
    t = t.unionByName(_firsts(add, key(F.col("name"))), allowMissingColumns=True)
    more = repair_ends(t, in_order(more_relations).withColumn("idx", F.col("idx") + 1_000_000))
    return t, distinct_relations(r.unionByName(more, allowMissingColumns=True))


def augment_reversed(relations: DataFrame) -> DataFrame:
    """The relations and the inverses that are missing."""
    from .build import reverse_name

    back = relations.select("group_name", reverse_name(F.col("name")).alias("name"), F.col("dst").alias("src"), F.col("src").alias("dst")).where("name IS NOT NULL")
    have = relations.select(F.lower("name").alias("name"), "src", "dst")
    return relations.select("group_name", "name", "src", "dst").unionByName(back.join(have, ["name", "src", "dst"], "left_anti").distinct())
