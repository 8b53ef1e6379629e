"""The query DSL: text to a checked record, a cost estimate, and a DataFrame program that runs it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import occurrences

# The closed lists, bounds, messages and clause patterns of the language.
LABELS = ("Paper", "Author", "Topic", "Method", "Dataset", "Institution", "Claim", "Community")
RELATIONSHIPS = ("AUTHORED", "CITES", "STUDIES", "USES_METHOD", "USES_DATASET", "AFFILIATED_WITH", "MAKES_CLAIM", "SUPPORTS", "CONTRADICTS", "BELONGS_TO", "RELATED_TO")
DEPTH, LIMIT, FANOUT, BUDGET, SEEDS = 1, 50, 8.0, 4000, 200
UNKNOWN, EMPTY = "Unknown {what} '{name}'. Allowed: {known}", 'empty query: give free text, a topic:"…" phrase, or a structured clause'
CLAUSES = {
    "topic": r'topic\s*:\s*"([^"]+)"',
    "author": r'author\s*:\s*"([^"]+)"',
    "year_min": r"year\s*>=\s*(\d{4})",
    "year_max": r"year\s*<=\s*(\d{4})",
    "depth": r"depth\s*<=?\s*(\d{1,2})",
    "limit": r"limit\s+(\d{1,4})",
    "type": r"type\s+in\s*\(([^)]*)\)",
    "rel": r"rel\s+in\s*\(([^)]*)\)",
}


class DslError(ValueError):
    """A query that names something outside the closed lists, or nothing at all."""


@dataclass
class Query:
    text: str | None = None
    labels: list[str] = field(default_factory=list)
    relationships: list[str] = field(default_factory=list)
    filters: list[tuple[str, str, object]] = field(default_factory=list)  # (kind, field, value)
    depth: int = DEPTH
    limit: int = LIMIT


def _named(raw: str, known: tuple[str, ...], what: str) -> list[str]:
    by = {k.lower(): k for k in known}
    out = []
    for name in (p.strip() for p in raw.split(",")):
        if name and name.lower() not in by:
            raise DslError(UNKNOWN.format(what=what, name=name, known=", ".join(known)))
        if name:
            out.append(by[name.lower()])
    return out


def parse(text: str | None) -> Query:
    """Take the clauses out of the text one after another; what is left is free text."""
    rest, got = text or "", {}
    for name, pattern in CLAUSES.items():
        m = re.search(pattern, rest, re.IGNORECASE)
        if m:
            got[name] = m.group(1).strip()
            rest = rest.replace(m.group(0), " ")
    q = Query()
    if "author" in got:
        q.filters.append(("TextContains", "name", got["author"]))
    if "year_min" in got:
        q.filters.append(("IntAtLeast", "year", int(got["year_min"])))
    if "year_max" in got:
        q.filters.append(("IntAtMost", "year", int(got["year_max"])))
    q.labels = _named(got.get("type", ""), LABELS, "node type")
    q.relationships = _named(got.get("rel", ""), RELATIONSHIPS, "relationship")
    q.depth = min(3, max(1, int(got.get("depth", DEPTH))))
    q.limit = min(500, max(1, int(got.get("limit", LIMIT))))
    free = " ".join(rest.split()).strip('"')
    q.text = " ".join(x for x in (got.get("topic"), free) if x) or None
    if not (q.text or q.filters or q.labels or q.relationships):
        raise DslError(EMPTY)
    return q


def cost(q: Query) -> dict:
    seeds = min(q.limit, SEEDS)
    raw = seeds * (1 + FANOUT * max(0, q.depth - 1))
    return {"depth": q.depth, "fanout": FANOUT, "seeds": seeds, "estimated_nodes_visited": min(int(raw), BUDGET), "budget": BUDGET, "strategy": "fulltext -> expand" if q.text else "label scan -> rank", "safe": raw <= BUDGET}


def _predicate(kind: str, name: str, value):
    c = F.col(name)
    if kind == "TextEquals":
        return F.lower(c) == str(value).lower()
    if kind == "TextContains":
        return F.lower(c).contains(str(value).lower())
    if kind == "IntAtLeast":
        return c >= value
    if kind == "IntAtMost":
        return c <= value
    if kind == "InList":
        return c.isin(list(value))
    raise DslError(f"Unknown predicate '{kind}'")


def run(q: Query | str, nodes: DataFrame, edges: DataFrame, rank: str | None = None) -> DataFrame:
    """(id, label, name, year, score, depth): matches ranked by text score or ``rank``, then what depth - 1 hops add.

    Filters are applied before the page is cut.  A free text matches where the name holds any of its words.
    """
    from graphloom.operators.graph import has_relationship
    from graphloom.operators.paths import distances

    q = parse(q) if isinstance(q, str) else q
    n = nodes.where(F.col("label").isin(q.labels)) if q.labels else nodes
    for f in q.filters:
        n = n.where(_predicate(*f))
    if q.relationships:
        n = has_relationship(n, edges, q.relationships)
    if q.text:
        low = F.lower(F.coalesce("name", F.lit("")))
        terms = list(dict.fromkeys(re.findall(r"[a-z0-9]+", q.text.lower())))
        score = sum((occurrences(low, t) for t in terms), F.lit(0)) if terms else F.lit(0)
        n = n.withColumn("score", (score + F.when(low == q.text.lower(), 2).otherwise(0)).cast("double")).where("score > 0")
    else:
        n = n.withColumn("score", (F.coalesce(F.col(rank), F.lit(0.0)) if rank else F.lit(0.0)).cast("double"))
    cols = ["id", "label", "name", "year", "score"]
    top = n.select(*cols).orderBy(F.desc("score"), "id").limit(q.limit)
    if q.depth == 1:
        return top.withColumn("depth", F.lit(0))
    e = edges.where(F.col("type").isin(q.relationships)) if q.relationships else edges
    found = distances(e, top.select("id"), q.depth - 1)
    return found.join(nodes.select("id", "label", "name", "year"), "id").join(top.select("id", "score"), "id", "left").select("id", "label", "name", "year", F.coalesce("score", F.lit(0.0)).alias("score"), "depth").orderBy("depth", F.desc("score"), "id").limit(BUDGET)
