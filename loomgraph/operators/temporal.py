"""As-of, timeline, change, overlap and conflict queries over partial dates."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import dates as D
from loomgraph.functions.json import js, obj, union
from loomgraph.graph import Graph, full_edges, full_nodes, meta
from loomgraph.plans.session import checkpoint


def scoped(edges: DataFrame) -> DataFrame:
    """Edges with the scope they are valid in: the temporal block of the metadata as a whole, where it has one, else the columns; precision by the dates where none is given."""
    e = full_edges(edges)
    block = {k: F.nullif(F.coalesce(*[meta(f"temporal.{x}") for x in names]), F.lit("")) for k, names in {
        "valid_from": ("valid_from", "start"), "valid_to": ("valid_to", "end"), "created_at": ("created_at",), "updated_at": ("updated_at",),
        "precision_from": ("precision_from", "precision"), "precision_to": ("precision_to",),
    }.items()}
    has = F.coalesce(block["valid_from"], block["valid_to"], block["created_at"], block["updated_at"]).isNotNull()
    own = {"valid_from": F.col("valid_from"), "valid_to": F.col("valid_to"), "created_at": F.coalesce("created_at", meta("created_at")), "updated_at": F.coalesce("updated_at", meta("updated_at"))}
    out = e.withColumns({k: F.when(has, block[k]).otherwise(v) for k, v in own.items()} | {f"precision_{s}": F.when(has, block[f"precision_{s}"]) for s in ("from", "to")})
    return out.withColumns({f"precision_{s}": F.coalesce(f"precision_{s}", D.precision(F.col(f"valid_{s}"))) for s in ("from", "to")})


def bounded(edges: DataFrame) -> DataFrame:
    """Edges with `lo` and `hi`, the first and last day they are valid: computed once, compared as strings after."""
    return edges.withColumns({
        "dated": F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull(),
        "lo": F.when(F.col("valid_from").isNull(), "0000").otherwise(D.lo(F.col("valid_from"))), "hi": F.when(F.col("valid_to").isNull(), "9999-99").otherwise(D.hi(F.col("valid_to"))),
    })


def _day(edges: DataFrame, day: str) -> tuple:
    """(lo, hi) of a day given as text, as plain strings; None for what is no date."""
    if not re.fullmatch(r"\d{4}(?:-\d{2}(?:-\d{2}(?:[T ].+)?)?)?", day):
        return None, None
    if len(day) == 4:
        return f"{day}-01-01", f"{day}-12-31"
    if len(day) == 7:
        y, m = int(day[:4]), int(day[5:])
        return (f"{day}-01", f"{day}-{calendar.monthrange(y, m)[1]:02d}") if 1 <= m <= 12 else (None, None)
    return day, day


def _holds(edges: DataFrame, day: str):
    lo, hi = _day(edges, day)
    inside = F.lit(False) if lo is None else F.coalesce((F.col("lo") <= hi) & (F.col("hi") >= lo), F.lit(False))
    return ~F.col("dated") | inside


def active_at(edges: DataFrame, day: str, rel: str | None = None, target: str | None = None) -> DataFrame:
    """Edges whose validity holds the day; edges without dates always do."""
    if rel is not None:
        edges = edges.where(F.lower("rel") == rel.lower())
    if target is not None:
        edges = edges.where(F.col("target") == target)
    return bounded(edges).where(_holds(edges, day)).select(*edges.columns)


def role_holders(g: Graph, rel: str, target: str, day: str) -> DataFrame:
    return active_at(g.edges, day, rel, target).select(F.col("source").alias("holder")).distinct()


def parse_question(text: str) -> tuple[str, str, str] | None:
    """(relation, target, date) of 'who was ROLE of TARGET in DATE' or 'TARGET ROLE in DATE'."""
    q, day = " ".join(text.split()).rstrip("? "), r"(\d{4}(?:-\d{2}(?:-\d{2})?)?)"
    m = re.match(rf"(?i)(?:who\s+(?:was|is)\s+)?(.+?)\s+of\s+(.+?)\s+in\s+{day}$", q)
    if m:
        role, target, d = m.groups()
    else:
        m = re.match(rf"(?i)(.+?)\s+([a-z][a-z0-9_-]*)\s+in\s+{day}$", q)
        if not m:
            return None
        target, role, d = m.groups()
    role = re.sub(r"[^A-Za-z0-9_]+", "_", role.strip()).strip("_").upper()
    return role if role.endswith("_OF") else role + "_OF", target.strip(), d


def ask(g: Graph, text: str) -> DataFrame:
    """The edges that answer a question with a role and a date; none if it can't be read."""
    q = parse_question(text)
    return g.edges.where("false") if q is None else active_at(g.edges.where(F.lower("target") == q[1].lower()), q[2], q[0])


def timeline(edges: DataFrame, entity: str | None = None) -> DataFrame:
    """Dated edges in the order of valid_from, source and edge."""
    if entity is not None:
        edges = edges.where((F.col("source") == entity) | (F.col("target") == entity))
    return edges.where("valid_from IS NOT NULL OR valid_to IS NOT NULL").orderBy(F.coalesce("valid_from", F.lit("")), "source", "edge_id")


def changes(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(edge_id, source, rel, target, change): started (active at the end, not at the start) or ended."""
    e = bounded(edges).withColumns({"a": _holds(edges, start), "b": _holds(edges, end)}).where("a <> b")
    return e.select("edge_id", "source", "rel", "target", F.when(F.col("b"), "started").otherwise("ended").alias("change"))


_DATED = ("edge_id", "source", "rel", "target", "valid_from", "valid_to", "lo", "hi")


def _twice(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    e = bounded(edges).where("dated AND lo IS NOT NULL AND hi IS NOT NULL").select(*_DATED)
    return e, e.toDF(*[f"{c}_2" for c in _DATED])


def _together(a: DataFrame, b: DataFrame):
    return (a.lo <= b.hi_2) & (b.lo_2 <= a.hi)


def overlaps(edges: DataFrame) -> DataFrame:
    """(edge_id, edge_id_2): edges of the same triple whose validity overlaps."""
    a, b = _twice(edges)
    on = (a.source == b.source_2) & (a.rel == b.rel_2) & (a.target == b.target_2) & (a.edge_id < b.edge_id_2)
    return a.join(b, on & _together(a, b)).select("edge_id", "edge_id_2")


def conflicts(edges: DataFrame, few: int = 1000) -> DataFrame:
    """(edge_id, edge_id_2): different holders of one role at the same time; one that begins on the day the other ends took over.

    Roles of up to `few` edges meet whole.  In larger ones edges meet by the years they are valid in (the first and last ones, and all between),
    each pair in the first year that both have; open bounds count from the first and to the last year of the data.
    """
    e, _ = _twice(edges)
    large = checkpoint(e.groupBy("rel", "target").agg(F.count("*").alias("n")).where(F.col("n") > few).select(F.col("rel").alias("__r"), F.col("target").alias("__t")))
    at = (F.col("rel") == F.col("__r")) & (F.col("target") == F.col("__t"))
    some = large.count()
    in_turn = "lo = '0000' OR hi = '9999-99' OR substring(lo, 1, 4) <= substring(hi, 1, 4)"  # as for the years below
    small = (e.join(large, at, "left_anti") if some else e).where(in_turn)
    found = _conflicting(small.withColumns({"y0": F.lit(0), "y": F.lit(0)}))
    if not some:
        return found
    a = e.join(large, at, "left_semi")
    year = lambda c, open_, d: F.when(F.col(c) == open_, F.lit(None)).otherwise(F.substring(c, 1, 4).cast("int")).alias(d)
    ends = a.select(year("lo", "0000", "a"), year("hi", "9999-99", "b")).agg(F.least(F.min("a"), F.min("b")).alias("from"), F.greatest(F.max("a"), F.max("b")).alias("to"))  # one row
    y = a.crossJoin(ends).withColumns({
        "y0": F.greatest("from", F.coalesce(F.when(F.col("lo") != "0000", F.substring("lo", 1, 4).cast("int")), "from")),
        "y1": F.coalesce(F.when(F.col("hi") != "9999-99", F.substring("hi", 1, 4).cast("int")), "to"),
    })
    return found.unionByName(_conflicting(y.where("y0 <= y1").withColumn("y", F.explode(F.sequence("y0", "y1"))).drop("from", "to", "y1")))


def _conflicting(y: DataFrame) -> DataFrame:
    b = y.toDF(*[f"{c}_2" for c in y.columns])
    on = (y.rel == b.rel_2) & (y.target == b.target_2) & (y.y == b.y_2) & (y.edge_id < b.edge_id_2) & (y.source != b.source_2)
    on = on & (y.y == F.greatest(y.y0, b.y0_2)) & (y.lo <= b.hi_2) & (b.lo_2 <= y.hi)
    hand_over = F.coalesce(y.valid_to == b.valid_from_2, F.lit(False)) | F.coalesce(b.valid_to_2 == y.valid_from, F.lit(False))
    return y.join(b, on & ~hand_over).select("edge_id", "edge_id_2")


def transitions(edges: DataFrame, entity: str, direction: str = "out") -> DataFrame:
    """The dated edges that leave an entity (or reach it, with 'in'), in time; 'both' is the same as 'out'."""
    return timeline(edges.where(F.col("target" if direction == "in" else "source") == entity))


def migrate(edges: DataFrame) -> DataFrame:
    """Edges with a temporal block in the metadata, from their dates, where it has none yet; it can run again."""
    e = full_edges(edges)
    own = {"valid_from": "valid_from", "valid_to": "valid_to", "created_at": "created_at", "updated_at": "updated_at"}
    block = obj(**{k: js(F.col(c)) for k, c in own.items()})
    new = union(F.col("metadata"), obj(temporal=block), new_wins=False)
    return e.withColumn("metadata", F.when(F.get_json_object("metadata", "$.temporal").isNull() & (block != "{}"), new).otherwise(F.col("metadata")))


def migrate_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose properties hold dates of validity get them as a temporal block of the metadata, and lose them there."""
    n = full_nodes(nodes)
    a, b = (meta(f"valid_{s}", "properties") for s in ("from", "to"))
    move = F.get_json_object("metadata", "$.temporal").isNull() & F.coalesce(a, b).isNotNull()
    rest = F.to_json(F.map_filter(F.from_json("properties", "map<string, variant>"), lambda k, _: ~k.isin("valid_from", "valid_to")))
    return n.withColumns({
        "metadata": F.when(move, union(F.col("metadata"), obj(temporal=obj(valid_from=js(a), valid_to=js(b))))).otherwise(F.col("metadata")),
        "properties": F.when(move, rest).otherwise(F.col("properties")),
    })
