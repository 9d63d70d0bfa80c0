"""Edges between definitions, relationship views and dependency traversal.

An edge has kind, related (the other definition) and evidence (the reference that shows it); edges of several nodes
carry `parent`, the rank of their node in the frontier. Budgets follow the feature: what they bound (at most 200 edges
and 8 nodes) is all that is ever numbered in one place or brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.resolve import COMPATIBLE, named, owners, three_tiers
from tessera.operators.search import by_path, root_place
from tessera.plans.shared import written

KINDS = ["incoming_call", "incoming_reference", "outgoing_call", "outgoing_reference"]
NODE = ("root", "path", "start", "name", "language", "kind", "stop")
FRONTIER, LEAST_EDGES, MOST_EDGES = 8, 80, 200


def nodes_frame(like: DataFrame, nodes: list[dict]) -> DataFrame:
    """The frontier as a table: parent rank and node columns."""
    schema = "parent int, " + ", ".join(f"n_{c} {'long' if c in ('start', 'stop') else 'string'}" for c in NODE)
    return like.sparkSession.createDataFrame([(i, *(n.get(c) for c in NODE)) for i, n in enumerate(nodes)], schema)


def incoming(references: DataFrame, definitions: DataFrame, nodes: list[dict]) -> DataFrame:
    """Uses of the nodes' names in compatible languages, with the definition that owns each; reason says why a use is
    no edge: ownerless, unresolved or self."""
    front = nodes_frame(references, nodes)
    pairs = references.sparkSession.createDataFrame([(i, m) for i, n in enumerate(nodes) for m in COMPATIBLE.get(n["language"], (n["language"],))], "parent int, language string")
    front = front.join(pairs, "parent").withColumn("lname", F.lower("n_name"))
    uses = references.withColumn("lname", F.lower("name")).join(F.broadcast(front), ["language", "lname"]).drop("lname")
    uses = uses.filter(~((F.col("root") == F.col("n_root")) & (F.col("path") == F.col("n_path")) & (F.col("start") == F.col("n_start"))))
    held = owners(uses, definitions)
    itself = (F.col("owner.root") == F.col("n_root")) & (F.col("owner.path") == F.col("n_path")) & (F.col("owner.start") == F.col("n_start"))
    reason = F.when(F.col("encl_name").isNull(), "ownerless").when(F.col("owner").isNull(), "unresolved").when(itself, "self")
    kind = F.when(F.col("ref_kind") == "call", "incoming_call").otherwise("incoming_reference")
    return held.select("parent", kind.alias("edge_kind"), F.col("owner").alias("related"), F.struct("root", "path", "start").alias("evidence"), F.col("name").alias("used"), reason.alias("reason"))


def outgoing(references: DataFrame, definitions: DataFrame, nodes: list[dict]) -> DataFrame:
    """Uses inside the nodes' ranges with the definition each means; reason: unresolved or self."""
    front = nodes_frame(references, nodes)
    inside = references.join(F.broadcast(front), (F.col("root") == F.col("n_root")) & (F.col("path") == F.col("n_path")) & F.col("start").between(F.col("n_start"), F.col("n_stop")))
    inside = inside.filter(F.col("start") != F.col("n_start"))
    # Only definitions of a name that is used inside can be meant.
    held = three_tiers(inside, named(definitions, inside))
    itself = (F.col("target.root") == F.col("n_root")) & (F.col("target.path") == F.col("n_path")) & (F.col("target.start") == F.col("n_start"))
    reason = F.when(F.col("target").isNull(), "unresolved").when(itself, "self")
    kind = F.when(F.col("ref_kind") == "call", "outgoing_call").otherwise("outgoing_reference")
    related = F.when(F.col("target").isNotNull(), F.struct(*[F.col(f"target.{k}").alias(k) for k in ("root", "path", "start", "kind", "name")]))
    return held.select("parent", kind.alias("edge_kind"), related.alias("related"), F.struct("root", "path", "start").alias("evidence"), F.col("name").alias("used"), reason.alias("reason"))


def tried(references: DataFrame, definitions: DataFrame, nodes: list[dict], kinds: list[str] | None = None, roots: list[str] | None = None, language: str | None = None) -> DataFrame:
    """Edges and rejected uses of the nodes, of the kinds asked for; directions without a kind are not computed. With roots
    or a language, only uses that others make there count, and edges whose other end lies there."""
    kinds = kinds or KINDS
    uses = references.filter(F.col("language") == language) if language else references
    sides = []
    if any(k.startswith("incoming") for k in kinds):
        sides.append(incoming(uses.filter(F.col("root").isin(roots)) if roots else uses, definitions, nodes))
    if any(k.startswith("outgoing") for k in kinds):  # a use and what it means have the same language
        found = outgoing(uses, definitions, nodes)
        sides.append(found.filter(F.col("related").isNull() | F.col("related.root").isin(roots)) if roots else found)
    out = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return out.filter(F.col("edge_kind").isin(kinds))


def edges(references: DataFrame, definitions: DataFrame, nodes: list[dict], kinds: list[str] | None = None, roots: list[str] | None = None, language: str | None = None) -> DataFrame:
    return tried(references, definitions, nodes, kinds, roots, language).filter("reason IS NULL").drop("reason")


def kind_place():
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("edge_kind"))


def edge_order(order: list[str] | None = None, locale: bool = False) -> list:
    """Kind, related and evidence by root (as configured, if `order` says how), path and place."""
    out = [kind_place()]
    for s in ("related", "evidence"):
        out += [root_place(order, F.col(f"{s}.root"))] if order else []
        out += [*by_path(f"{s}.root", f"{s}.path", locale=locale), F.col(f"{s}.start")]
    return out


def edge_limit(limit: int, offset: int) -> int:
    return min(MOST_EDGES, max(LEAST_EDGES, offset + limit + 50))


def unique(found: DataFrame, hop: int) -> DataFrame:
    """Equal edges once, with the first parent that has them."""
    key = ["edge_kind", "related", "evidence"]
    return found.groupBy(*key).agg(F.min("parent").alias("parent")).withColumn("hop", F.lit(hop))


def relationship_view(references: DataFrame, definitions: DataFrame, seed: dict, depth: int = 1, limit: int = 50, offset: int = 0, kinds: list[str] | None = None, roots: list[str] | None = None, language: str | None = None, order: list[str] | None = None, locale: bool = False) -> tuple[DataFrame, bool]:
    """Edges (hop, edge_kind, related, evidence) up to two hops from the seed, and whether a budget was reached: an edge, or
    an equal one again, came after the last that it allows, or a node after the last of the frontier. Roots and language
    restrict edges before the budget counts them; `order` has the configured roots. At depth 2 each hop is computed once
    and written."""
    first = unique(edges(references, definitions, [seed], kinds, roots, language), 1).drop("parent")
    if depth == 1:
        return first, False
    first = written(first, "hop1")
    most = edge_limit(limit, offset)
    keys = edge_order(order, locale)
    near = first.orderBy(*keys).limit(most + 1).collect()
    if len(near) > most:
        return first.orderBy(*keys).limit(most), True
    seen = {(seed["root"], seed["path"], seed["start"])}
    frontier: list[dict] = []
    reached = False
    for e in near:
        at = (e["related"]["root"], e["related"]["path"], e["related"]["start"])
        if at not in seen:
            seen.add(at)
            reached = len(frontier) == FRONTIER
            if reached:
                break
            frontier.append(dict(zip(("root", "path", "start"), at, strict=True)))
    if not frontier:
        return first, reached
    places = nodes_frame(definitions, frontier).select("parent", F.col("n_root").alias("root"), F.col("n_path").alias("path"), F.col("n_start").alias("start"))
    nodes = [r.asDict() for r in definitions.join(F.broadcast(places), ["root", "path", "start"]).orderBy("parent").collect()]
    found = written(edges(references, definitions, nodes, kinds, roots, language), "hop2")
    second = unique(found, 2)
    left = most - len(near)
    many = second.limit(left + 1).count()
    if many == left and not reached:  # so few that the sequence itself tells whether anything follows the last new edge
        met: set = set()
        for e in found.orderBy("parent", *keys).collect():
            reached = reached or len(met) == left
            met.add((e["edge_kind"], tuple(e["related"]), tuple(e["evidence"])))
    far = second.orderBy("parent", *keys).limit(left)
    return first.unionByName(far.drop("parent")), reached or many > left


def dependencies(links: DataFrame, seed: str, depth: int = 2, kinds: list[str] | None = None, checkpoint=written, allowed: DataFrame | None = None) -> DataFrame:
    """Nodes that depend on the seed or that it depends on, with one shortest path each.

    links: (source, kind, target): the source uses the target; kind is call or reference. Both directions are followed
    at once, each with the kinds allowed and, if given, to nodes in `allowed` (node) alone; first arrivals win, ties go to
    the better placed parent and edge, nodes by their keys. The seed is not marked beforehand, so a cycle finds it again.
    Links are written once; per hop: one join, one aggregation, one anti join; `checkpoint` (a function of a DataFrame and
    a name) cuts the lineage after each.
    """
    used = kinds or KINDS
    links = checkpoint(links, "links")
    out = links.select(F.col("source").alias("at"), F.lit("outgoing").alias("direction"), F.concat(F.lit("outgoing_"), "kind").alias("edge_kind"), F.col("target").alias("node"))
    into = links.select(F.col("target").alias("at"), F.lit("incoming").alias("direction"), F.concat(F.lit("incoming_"), "kind").alias("edge_kind"), F.col("source").alias("node"))
    moves = out.unionByName(into).filter(F.col("edge_kind").isin(used)).withColumn("place", kind_place())
    moves = moves.join(allowed, "node", "left_semi") if allowed is not None else moves
    spark = links.sparkSession
    frontier = spark.createDataFrame([(d, seed, [], []) for d in ("outgoing", "incoming")], "direction string, at string, trail array<string>, steps array<string>")
    found = None
    for hop in range(1, depth + 1):
        # A trail, compared element by element, orders arrivals: the parent's trail, then the edge's place and node.
        trail = F.concat("trail", F.array(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("node"))))
        walked = F.concat("steps", F.array(F.concat("edge_kind", F.lit(">"), F.col("node"))))
        reached = moves.join(frontier, ["direction", "at"]).select("direction", "node", F.struct(trail.alias("trail"), walked.alias("steps")).alias("by"))
        first = reached.groupBy("direction", "node").agg(F.min("by").alias("by"))
        if found is not None:
            first = first.join(found.select("direction", "node"), ["direction", "node"], "left_anti")
        first = checkpoint(first.select("direction", "node", F.lit(hop).alias("depth"), F.col("by.trail").alias("trail"), F.col("by.steps").alias("steps")), f"hop{hop}")
        found = first if found is None else found.unionByName(first)
        frontier = first.select("direction", F.col("node").alias("at"), "trail", "steps")
    return found.drop("trail")
