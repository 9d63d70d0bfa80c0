"""The registered queries: each applies one operator to the driver's tables, beside the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import analysis, graph, refresh, resolve, search
from tessera.operators.search import Filters
from tessera.plans import bindings as B
from tessera.plans.catalog import register
from tessera.plans.shared import written
from tessera.sources import discovery, languages

# --- ranked search and filters over entities -------------------------------------------------------------------------

WORD = "an"  # what the searches look for
SCORE = f"""CASE WHEN lower(name) = '{WORD}' THEN 0 WHEN starts_with(lower(name), '{WORD}') THEN 100 + length(name) - {len(WORD)}
  WHEN instr(lower(name), '{WORD}') > 0 THEN 199 + instr(lower(name), '{WORD}') + length(name) - {len(WORD)} END"""
ROOTS = ["w1", "w0", "w2"]
ROOT_PLACE = "CASE root WHEN 'w1' THEN 0 WHEN 'w0' THEN 1 WHEN 'w2' THEN 2 ELSE 3 END"


@register("name_score", f"WITH {B.ENTITY} SELECT start, name, CAST({SCORE} AS INTEGER) AS score FROM defs")
def name_score(spark: SparkSession, d: str) -> DataFrame:
    return B.entity(spark, d).select("start", "name", T.name_score(F.col("name"), WORD).alias("score"))


def top(where: str, limit: int) -> str:
    return f"""WITH {B.ENTITY}, s AS (SELECT *, {SCORE} AS score FROM defs WHERE {where})
SELECT root, path, language, kind, name, start, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY score, {ROOT_PLACE}, root, path, start) AS INTEGER) AS rank
FROM s WHERE score IS NOT NULL QUALIFY rank <= {limit}"""


@register("search_definitions_topk", top("true", 50))
def search_definitions_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.search(B.entity(spark, d), WORD, roots=ROOTS)


@register("search_symbols_filtered", top("root IN ('w1', 'w2') AND language = 'Brand#13'", 20))
def search_symbols_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.search(B.entity(spark, d), WORD, Filters(roots=["w1", "w2"], language="Brand#13"), ROOTS, 20)


def filtered(filters: Filters):
    return lambda spark, d: B.entity(spark, d).filter(filters.definitions())


for _name, _filters, _where in (
    ("filter_root", Filters(roots=["w0", "w2"]), "root IN ('w0', 'w2')"),
    ("filter_language", Filters(language="Brand#23"), "language = 'Brand#23'"),
    ("filter_path_prefix", Filters(prefix="Brand#2"), "path = 'Brand#2' OR starts_with(path, 'Brand#2/')"),
    ("filter_path_prefix_segment", Filters(prefix="Brand#1"), "path = 'Brand#1' OR starts_with(path, 'Brand#1/')"),
    ("filter_kind", Filters(kinds=["ECONOMY", "STANDARD"]), "kind IN ('ECONOMY', 'STANDARD')"),
):
    register(_name, f"WITH {B.ENTITY} SELECT * FROM defs WHERE {_where}")(filtered(_filters))


@register("workspace_breakdown", f"""WITH {B.ENTITY}, s AS (SELECT *, {SCORE} AS score FROM defs WHERE root IN ('w1', 'w2')),
p AS (SELECT * FROM s WHERE score IS NOT NULL ORDER BY score, {ROOT_PLACE}, root, path, start LIMIT 50),
r AS (SELECT unnest(['w1', 'w2']) AS root)
SELECT r.root, (SELECT count(*) FROM defs WHERE defs.root = r.root) AS searched_files, (SELECT count(DISTINCT path) FROM p WHERE p.root = r.root) AS matched_files,
  (SELECT count(*) FROM p WHERE p.root = r.root) AS returned_results FROM r""")
def workspace_breakdown(spark: SparkSession, d: str) -> DataFrame:
    defs = B.entity(spark, d)
    return search.breakdown(defs.select("root", "path"), search.search(defs, WORD, Filters(roots=["w1", "w2"]), ROOTS), ["w1", "w2"])


@register("matched_files", f"WITH {B.ENTITY}, s AS (SELECT *, {SCORE} AS score FROM defs) SELECT count(DISTINCT (root, path)) AS matched_files FROM (SELECT * FROM s WHERE score IS NOT NULL ORDER BY score, {ROOT_PLACE}, root, path, start LIMIT 50)")
def matched_files(spark: SparkSession, d: str) -> DataFrame:
    return search.search(B.entity(spark, d), WORD, roots=ROOTS).agg(F.count_distinct("root", "path").alias("matched_files"))


# --- resolution and references over texts -----------------------------------------------------------------------------

SYMBOL = "the"


@register("resolve_definition", f"WITH {B.TEXT} SELECT root, path, language, kind, name, start, stop FROM defs WHERE lower(name) = '{SYMBOL}' ORDER BY root, path, start LIMIT 1")
def resolve_definition(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_definition(B.definitions(spark, d), SYMBOL)


@register("resolve_definition_prefix", f"WITH {B.TEXT} SELECT root, path, language, kind, name, start, stop FROM defs WHERE lower(name) = '{SYMBOL}' AND starts_with(path, 'en/') AND kind = 'class' ORDER BY root, path, start LIMIT 1")
def resolve_definition_prefix(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_definition(B.definitions(spark, d), SYMBOL, Filters(prefix="en", kinds=["class"]))


@register("resolve_definition_each", f"WITH {B.TEXT} SELECT lower(name) AS lname, arg_min(root, (root, path, start)) AS root, arg_min(path, (root, path, start)) AS path, arg_min(start, (root, path, start)) AS start FROM defs GROUP BY ALL")
def resolve_definition_each(spark: SparkSession, d: str) -> DataFrame:
    return resolve.best_of_each(B.definitions(spark, d)).select("lname", "root", "path", "start")


TIERS = """, t0 AS (SELECT language, root, path, lower(name) AS n, min(start) AS start FROM defs GROUP BY ALL),
t1 AS (SELECT language, root, n, arg_min(path, (path, start)) AS path, arg_min(start, (path, start)) AS start FROM t0 GROUP BY ALL),
t2 AS (SELECT language, n, arg_min(root, (root, path, start)) AS root, arg_min(path, (root, path, start)) AS path, arg_min(start, (root, path, start)) AS start FROM t0 GROUP BY ALL),
tiers AS (SELECT refs.*, CASE WHEN t0.start IS NOT NULL THEN 0 WHEN t1.start IS NOT NULL THEN 1 WHEN t2.start IS NOT NULL THEN 2 END AS tier,
  CASE WHEN t0.start IS NOT NULL THEN refs.root WHEN t1.start IS NOT NULL THEN refs.root ELSE t2.root END AS t_root,
  CASE WHEN t0.start IS NOT NULL THEN refs.path WHEN t1.start IS NOT NULL THEN t1.path ELSE t2.path END AS t_path, coalesce(t0.start, t1.start, t2.start) AS t_start
 FROM refs LEFT JOIN t0 ON refs.language = t0.language AND refs.root = t0.root AND refs.path = t0.path AND lower(refs.name) = t0.n
 LEFT JOIN t1 ON refs.language = t1.language AND refs.root = t1.root AND lower(refs.name) = t1.n LEFT JOIN t2 ON refs.language = t2.language AND lower(refs.name) = t2.n)"""


@register("resolve_three_tier", f"WITH {B.TEXT}{TIERS} SELECT root, path, start, name, tier, t_root, t_path, t_start FROM tiers WHERE tier IS NOT NULL")
def resolve_three_tier(spark: SparkSession, d: str) -> DataFrame:
    out = resolve.three_tiers(B.references(spark, d), B.definitions(spark, d)).filter("tier IS NOT NULL")
    return out.select("root", "path", "start", "name", "tier", F.col("target.root").alias("t_root"), F.col("target.path").alias("t_path"), F.col("target.start").alias("t_start"))


def seed(spark: SparkSession, d: str, symbol: str = SYMBOL) -> dict:
    """The definition of the symbol: one row."""
    row = resolve.resolve_definition(B.definitions(spark, d), symbol).first()
    return row.asDict() if row else {"root": "", "path": "", "start": -1, "stop": -1, "name": symbol, "language": "", "kind": ""}


SEED = f"seed AS (SELECT * FROM defs WHERE lower(name) = '{SYMBOL}' ORDER BY root, path, start LIMIT 1)"
USES = f"uses AS (SELECT refs.* FROM refs, seed WHERE lower(refs.name) = lower(seed.name) AND refs.language = seed.language AND NOT (refs.root = seed.root AND refs.path = seed.path AND refs.start = seed.start))"


@register("references_search", f"WITH {B.TEXT}, {SEED}, {USES} SELECT root, path, ref_kind, name, start, encl_name, encl_kind FROM uses")
def references_search(spark: SparkSession, d: str) -> DataFrame:
    return resolve.references_to(B.references(spark, d), seed(spark, d)).select("root", "path", "ref_kind", "name", "start", "encl_name", "encl_kind")


MIXED = "mixed AS (SELECT root, path, language, name, start FROM refs UNION ALL SELECT root, path, language, name, start FROM defs)"


@register("references_exclude_self", f"WITH {B.TEXT}, {SEED}, {MIXED} SELECT b.root, b.path, b.name, b.start FROM mixed b, seed WHERE lower(b.name) = lower(seed.name) AND b.language = seed.language AND NOT (b.root = seed.root AND b.path = seed.path AND b.start = seed.start)")
def references_exclude_self(spark: SparkSession, d: str) -> DataFrame:
    columns = ["root", "path", "language", "name", "start"]
    both = B.references(spark, d).select(*columns).unionByName(B.definitions(spark, d).select(*columns))
    return resolve.references_to(both, seed(spark, d)).select("root", "path", "name", "start")


REF_ORDER = "root, path, CASE ref_kind WHEN 'call' THEN 0 ELSE 1 END, start"


@register("references_page", f"WITH {B.TEXT}, {SEED}, {USES} SELECT root, path, ref_kind, name, start, CAST(row_number() OVER (ORDER BY {REF_ORDER}) AS INTEGER) AS rank FROM uses QUALIFY rank > 20 AND rank <= 70")
def references_page(spark: SparkSession, d: str) -> DataFrame:
    found = resolve.references_to(B.references(spark, d), seed(spark, d)).select("root", "path", "ref_kind", "name", "start")
    return search.ordered(found, [F.col("root"), F.col("path"), F.when(F.col("ref_kind") == "call", 0).otherwise(1), F.col("start")], 50, 20)


@register("pagination_meta", f"WITH {B.TEXT}, {SEED}, {USES}, n AS (SELECT count(*) AS total FROM uses) SELECT 50 AS limit_, 20 AS offset_, greatest(0, least(50, total - 20))::BIGINT AS returned, total, total > 20 + greatest(0, least(50, total - 20)) AS has_more, CASE WHEN total > 20 + greatest(0, least(50, total - 20)) THEN (20 + greatest(0, least(50, total - 20)))::BIGINT END AS next_offset FROM n")
def pagination_meta(spark: SparkSession, d: str) -> DataFrame:
    return search.page_facts(resolve.references_to(B.references(spark, d), seed(spark, d)), 50, 20)


@register("language_compat_join", f"WITH {B.FILES}, c AS (SELECT * FROM (VALUES ('en', 'en'), ('en', 'fr'), ('fr', 'en'), ('fr', 'fr'), ('de', 'de'), ('es', 'es')) t(language, other)) SELECT language, other, count(*) AS n FROM files JOIN c USING (language) GROUP BY ALL")
def language_compat_join(spark: SparkSession, d: str) -> DataFrame:
    pairs = resolve.language_pairs(spark, {"en": ("en", "fr"), "fr": ("en", "fr"), "de": ("de",), "es": ("es",)})
    return B.files(spark, d).join(F.broadcast(pairs), "language").groupBy("language", "other").agg(F.count(F.lit(1)).alias("n"))


OWNERS = """, own AS (SELECT root, path, language, kind, lower(name) AS n, min(start) AS start FROM defs GROUP BY ALL),
owned AS (SELECT refs.*, own.start AS o_start FROM refs LEFT JOIN own ON refs.root = own.root AND refs.path = own.path AND refs.language = own.language AND refs.encl_kind = own.kind AND lower(refs.encl_name) = own.n)"""


@register("enclosing_owner", f"WITH {B.TEXT}{OWNERS} SELECT root, path, start, name, encl_kind, o_start FROM owned")
def enclosing_owner(spark: SparkSession, d: str) -> DataFrame:
    return resolve.owners(B.references(spark, d), B.definitions(spark, d)).select("root", "path", "start", "name", "encl_kind", F.col("owner.start").alias("o_start"))


@register("nearest_enclosing", """SELECT conv_id, turn, role, max(CASE WHEN role IN ('system', 'user') THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scope_turn FROM conversations""")
def nearest_enclosing(spark: SparkSession, d: str) -> DataFrame:
    turns = B.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return resolve.nearest_before(turns, ["conv_id"], "turn", F.col("role").isin("system", "user"), "scope_turn")


# --- edges ------------------------------------------------------------------------------------------------------------

INCOMING = """, inc AS (SELECT CASE owned.ref_kind WHEN 'call' THEN 'incoming_call' ELSE 'incoming_reference' END AS edge_kind, owned.root AS r_root, owned.path AS r_path, o_start AS r_start, owned.root AS e_root, owned.path AS e_path, owned.start AS e_start,
  CASE WHEN encl_name IS NULL THEN 'ownerless' WHEN o_start IS NULL THEN 'unresolved' WHEN owned.root = seed.root AND owned.path = seed.path AND o_start = seed.start THEN 'self' END AS reason
 FROM owned, seed WHERE lower(owned.name) = lower(seed.name) AND owned.language = seed.language AND NOT (owned.root = seed.root AND owned.path = seed.path AND owned.start = seed.start))"""
OUTGOING = """, outg AS (SELECT CASE tiers.ref_kind WHEN 'call' THEN 'outgoing_call' ELSE 'outgoing_reference' END AS edge_kind, t_root AS r_root, t_path AS r_path, t_start AS r_start, tiers.root AS e_root, tiers.path AS e_path, tiers.start AS e_start,
  CASE WHEN tier IS NULL THEN 'unresolved' WHEN t_root = seed.root AND t_path = seed.path AND t_start = seed.start THEN 'self' END AS reason
 FROM tiers, seed WHERE tiers.root = seed.root AND tiers.path = seed.path AND tiers.start BETWEEN seed.start AND seed.stop AND tiers.start <> seed.start)"""
EDGE = "edge_kind, r_root, r_path, r_start, e_root, e_path, e_start"
GRAPH = f"WITH {B.TEXT}, {SEED}{TIERS}{OWNERS}{INCOMING}{OUTGOING}, tried AS (SELECT * FROM inc UNION ALL SELECT * FROM outg), edges AS (SELECT {EDGE} FROM tried WHERE reason IS NULL)"
KIND_PLACE = "list_position(['incoming_call', 'incoming_reference', 'outgoing_call', 'outgoing_reference'], edge_kind)"
EDGE_ORDER = f"{KIND_PLACE}, r_root, r_path, r_start, e_root, e_path, e_start"


def flat(edges: DataFrame, *more: str) -> DataFrame:
    part = [F.col(f"{s}.{c}").alias(f"{s[0]}_{c}") for s in ("related", "evidence") for c in ("root", "path", "start")]
    return edges.select("edge_kind", *part, *more)


@register("incoming_edges", f"{GRAPH} SELECT {EDGE} FROM inc WHERE reason IS NULL")
def incoming_edges(spark: SparkSession, d: str) -> DataFrame:
    return flat(graph.incoming(B.references(spark, d), B.definitions(spark, d), [seed(spark, d)]).filter("reason IS NULL"))


@register(
    "outgoing_edges",
    f"""{GRAPH}, nodes AS (SELECT *, row_number() OVER (ORDER BY root, path, start) - 1 AS parent FROM defs QUALIFY parent < 8)
SELECT CAST(parent AS INTEGER) AS parent, CASE tiers.ref_kind WHEN 'call' THEN 'outgoing_call' ELSE 'outgoing_reference' END AS edge_kind, t_root AS r_root, t_path AS r_path, t_start AS r_start, tiers.root AS e_root, tiers.path AS e_path, tiers.start AS e_start
 FROM tiers JOIN nodes ON tiers.root = nodes.root AND tiers.path = nodes.path AND tiers.start BETWEEN nodes.start AND nodes.stop
 WHERE tiers.start <> nodes.start AND tier IS NOT NULL AND NOT (t_root = nodes.root AND t_path = nodes.path AND t_start = nodes.start)""",
)
def outgoing_edges(spark: SparkSession, d: str) -> DataFrame:
    """Of the first eight definitions."""
    nodes = [r.asDict() for r in B.definitions(spark, d).orderBy("root", "path", "start").limit(8).collect()]
    return flat(graph.outgoing(B.references(spark, d), B.definitions(spark, d), nodes).filter("reason IS NULL"), "parent")


@register("edge_dedup", f"{GRAPH} SELECT DISTINCT {EDGE} FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges)")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = graph.edges(B.references(spark, d), B.definitions(spark, d), [seed(spark, d)])
    return flat(graph.unique(found.unionByName(found), 1))


@register("edge_sort_rank", f"{GRAPH} SELECT {EDGE}, CAST(row_number() OVER (ORDER BY {EDGE_ORDER}) AS INTEGER) AS rank FROM edges QUALIFY rank <= 200")
def edge_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    found = graph.edges(B.references(spark, d), B.definitions(spark, d), [seed(spark, d)])
    return flat(search.ordered(found, graph.edge_order(), 200), "rank")


@register("relationship_depth1", f"{GRAPH} SELECT DISTINCT {EDGE}, 1 AS hop FROM edges WHERE edge_kind IN ('incoming_reference', 'outgoing_call')")
def relationship_depth1(spark: SparkSession, d: str) -> DataFrame:
    found, _ = graph.relationship_view(B.references(spark, d), B.definitions(spark, d), seed(spark, d), kinds=["incoming_reference", "outgoing_call"])
    return flat(found, "hop")


BUDGET = graph.edge_limit(50, 0)


@register(
    "relationship_depth2_budget",
    f"""{GRAPH}, hop1 AS (SELECT DISTINCT {EDGE} FROM edges ORDER BY {EDGE_ORDER} LIMIT {BUDGET}),
numbered AS (SELECT *, row_number() OVER (ORDER BY {EDGE_ORDER}) AS place FROM hop1),
front AS (SELECT r_root, r_path, r_start, row_number() OVER (ORDER BY first) - 1 AS parent FROM (SELECT r_root, r_path, r_start, min(place) AS first FROM numbered, seed WHERE NOT (r_root = seed.root AND r_path = seed.path AND r_start = seed.start) GROUP BY ALL) QUALIFY parent < 8),
nodes AS (SELECT front.parent, defs.* FROM front JOIN defs ON r_root = defs.root AND r_path = defs.path AND r_start = defs.start),
in2 AS (SELECT parent, CASE owned.ref_kind WHEN 'call' THEN 'incoming_call' ELSE 'incoming_reference' END AS edge_kind, owned.root AS r_root, owned.path AS r_path, o_start AS r_start, owned.root AS e_root, owned.path AS e_path, owned.start AS e_start
 FROM owned JOIN nodes ON lower(owned.name) = lower(nodes.name) AND owned.language = nodes.language WHERE NOT (owned.root = nodes.root AND owned.path = nodes.path AND owned.start = nodes.start) AND o_start IS NOT NULL AND NOT (owned.root = nodes.root AND owned.path = nodes.path AND o_start = nodes.start)),
out2 AS (SELECT parent, CASE tiers.ref_kind WHEN 'call' THEN 'outgoing_call' ELSE 'outgoing_reference' END AS edge_kind, t_root AS r_root, t_path AS r_path, t_start AS r_start, tiers.root AS e_root, tiers.path AS e_path, tiers.start AS e_start
 FROM tiers JOIN nodes ON tiers.root = nodes.root AND tiers.path = nodes.path AND tiers.start BETWEEN nodes.start AND nodes.stop WHERE tiers.start <> nodes.start AND tier IS NOT NULL AND NOT (t_root = nodes.root AND t_path = nodes.path AND t_start = nodes.start)),
hop2 AS (SELECT {EDGE}, min(parent) AS parent FROM (SELECT * FROM in2 UNION ALL SELECT * FROM out2) GROUP BY ALL)
SELECT {EDGE}, 1 AS hop FROM hop1 UNION ALL (SELECT {EDGE}, 2 AS hop FROM (SELECT *, row_number() OVER (ORDER BY parent, {EDGE_ORDER}) AS n FROM hop2) WHERE n <= {BUDGET} - (SELECT count(*) FROM hop1))""".replace("{SYMBOL}", "")
    .replace(f"lower(name) = '{SYMBOL}'", "lower(name) = 'for'"),
)
def relationship_depth2_budget(spark: SparkSession, d: str) -> DataFrame:
    found, _ = graph.relationship_view(B.references(spark, d), B.definitions(spark, d), seed(spark, d, "for"), depth=2)
    return flat(found, "hop")


for _reason in ("self", "unresolved", "ownerless"):

    def _rejected(spark: SparkSession, d: str, reason: str = _reason) -> DataFrame:
        found = graph.tried(B.references(spark, d), B.definitions(spark, d), [seed(spark, d)])
        return found.filter(F.col("reason") == reason).select("edge_kind", F.col("evidence.root").alias("e_root"), F.col("evidence.path").alias("e_path"), F.col("evidence.start").alias("e_start"), "reason")

    register(f"{_reason}_{'edge_' if _reason == 'self' else ''}diagnostics", f"{GRAPH} SELECT edge_kind, e_root, e_path, e_start, reason FROM tried WHERE reason = '{_reason}'")(_rejected)


@register("seen_anti_join", f"WITH {B.TEXT} SELECT r.root, r.path, r.start FROM refs r WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.language = r.language AND lower(d.name) = lower(r.name))")
def seen_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return resolve.named(B.references(spark, d), B.definitions(spark, d), known=False).select("root", "path", "start")


# --- dependencies -----------------------------------------------------------------------------------------------------


def hops(seed_: str, depth: int, kinds: list[str] = graph.KINDS) -> str:
    """SQL of a traversal, hop by hop."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    out = f"""WITH {B.LINKS}, steps0 AS (SELECT source AS at, 'outgoing' AS direction, 'outgoing_' || kind AS edge_kind, target AS node FROM links UNION ALL SELECT target, 'incoming', 'incoming_' || kind, source FROM links),
steps AS (SELECT *, {KIND_PLACE} AS place FROM steps0 WHERE edge_kind IN ({listed})),
h0 AS (SELECT unnest(['outgoing', 'incoming']) AS direction, '{seed_}' AS node, []::VARCHAR[] AS trail, []::VARCHAR[] AS path)"""
    for i in range(1, depth + 1):
        seen = " AND ".join(f"(s.direction, s.node) NOT IN (SELECT (direction, node) FROM h{j})" for j in range(1, i)) or "true"
        out += f""",
r{i} AS (SELECT s.direction, s.node, list_append(h.trail, s.place || ':' || s.node) AS trail, list_append(h.path, s.edge_kind || '>' || s.node) AS path FROM steps s JOIN h{i - 1} h ON s.direction = h.direction AND s.at = h.node WHERE {seen}),
h{i} AS (SELECT direction, node, min(trail) AS trail, arg_min(path, trail) AS path FROM r{i} GROUP BY ALL)"""
    return out + ", found AS (" + " UNION ALL ".join(f"SELECT direction, node, {i} AS depth, path FROM h{i}" for i in range(1, depth + 1)) + ")"


def followed(spark: SparkSession, d: str, seed_: str, depth: int, kinds: list[str] | None = None) -> DataFrame:
    return graph.dependencies(B.links(spark, d), seed_, depth, kinds, written)


@register("dependency_bfs", hops("supplier:1", 4) + " SELECT direction, node, depth FROM found")
def dependency_bfs(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d, "supplier:1", 4).select("direction", "node", "depth")


@register("dependency_paths", hops("customer:1", 3) + " SELECT direction, node, depth, array_to_string(path, ' ') AS path FROM found")
def dependency_paths(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d, "customer:1", 3).select("direction", "node", "depth", F.array_join("steps", " ").alias("path"))


CALLS = ["incoming_call", "outgoing_call"]


@register("dependency_kind_filter", hops("supplier:1", 2, CALLS) + " SELECT direction, node, depth FROM found")
def dependency_kind_filter(spark: SparkSession, d: str) -> DataFrame:
    return followed(spark, d, "supplier:1", 2, CALLS).select("direction", "node", "depth")


# --- snapshots, freshness, diagnostics --------------------------------------------------------------------------------


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = B.table(spark, d, "documents")
    row = lambda df, text: df.select(F.col("source").alias("root"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("double").alias("mtime"), F.length(text).alias("size"), F.sha1(text.cast("binary")).alias("hash"))
    return row(docs.filter("doc_id % 10 <> 2"), F.col("text")), row(docs.filter("doc_id % 10 <> 0"), F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


CHANGES = """old AS (SELECT source AS root, lang || '/' || doc_id AS path, sha1(text) AS hash FROM documents WHERE doc_id % 10 <> 2),
new AS (SELECT source AS root, lang || '/' || doc_id AS path, sha1(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 0),
changes AS (SELECT coalesce(o.root, n.root) AS root, coalesce(o.path, n.path) AS path, CASE WHEN o.root IS NULL THEN 'added' WHEN n.root IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'refreshed' END AS status
 FROM old o FULL OUTER JOIN new n ON o.root = n.root AND o.path = n.path)"""


@register("refresh_classify", f"WITH {CHANGES} SELECT * FROM changes")
def refresh_classify(spark: SparkSession, d: str) -> DataFrame:
    return refresh.classify(*snapshots(spark, d))


@register("refresh_removed", f"WITH {CHANGES} SELECT root, path FROM changes WHERE status = 'removed'")
def refresh_removed(spark: SparkSession, d: str) -> DataFrame:
    return refresh.removed(*snapshots(spark, d))


@register("content_hash", f"WITH {B.FILES} SELECT root, path, sha1(coalesce(content, '')) AS content_hash FROM files")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return B.files(spark, d).select("root", "path", T.content_hash(F.col("content")).alias("content_hash"))


@register("fingerprint", """WITH r AS (SELECT source AS root, list_sort(list_distinct(list(lang))) AS x FROM documents GROUP BY source)
SELECT root, sha1('{"root":"' || root || '","exclusions":["' || array_to_string(x, '","') || '"],"version":"1"}') AS fingerprint FROM r""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    roots = B.table(spark, d, "documents").groupBy(F.col("source").alias("root")).agg(F.collect_set("lang").alias("x"))
    return roots.select("root", T.fingerprint(F.col("root"), F.col("x"), "1").alias("fingerprint"))


STATE = "CASE event_type WHEN 'error' THEN 'degraded' WHEN 'signup' THEN 'rebuilding' WHEN 'purchase' THEN 'refreshed' ELSE 'fresh' END"
WORST = "CASE max(list_position(['fresh', 'refreshed', 'degraded', 'rebuilding'], state)) WHEN 1 THEN 'fresh' WHEN 2 THEN 'refreshed' WHEN 3 THEN 'degraded' WHEN 4 THEN 'rebuilding' END"


def states(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return B.table(spark, d, "events").withColumn("state", F.when(kind == "error", "degraded").when(kind == "signup", "rebuilding").when(kind == "purchase", "refreshed").otherwise("fresh"))


@register("state_rank_agg", f"SELECT user_id, {WORST} AS state FROM (SELECT user_id, {STATE} AS state FROM events) GROUP BY user_id")
def state_rank_agg(spark: SparkSession, d: str) -> DataFrame:
    return refresh.worst_state(states(spark, d), ["user_id"])


@register("freshness_fold", f"SELECT coalesce({WORST}, 'rebuilding') AS state FROM (SELECT {STATE} AS state FROM events WHERE event_type <> 'signup')")
def freshness_fold(spark: SparkSession, d: str) -> DataFrame:
    return refresh.fold_states(states(spark, d).filter("event_type <> 'signup'"))


@register("freshness_combine", f"""SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type) FILTER (state = 'refreshed'))), ',') AS refreshed,
 array_to_string(list_sort(list_distinct(list(event_type) FILTER (state = 'degraded'))), ',') AS degraded, max(event_id) AS checked_at, {WORST} AS state FROM (SELECT *, {STATE} AS state FROM events) GROUP BY user_id""".replace("array_to_string(", "coalesce(array_to_string(").replace(", ',')", ", ','), '')"))
def freshness_combine(spark: SparkSession, d: str) -> DataFrame:
    only = lambda s: F.when(F.col("state") == s, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    parts = states(spark, d).select("user_id", "state", F.col("event_id").alias("checked_at"), only("refreshed").alias("refreshed"), only("degraded").alias("degraded"))
    out = refresh.combine_freshness(parts, ["user_id"])
    return out.select("user_id", F.array_join("refreshed", ",").alias("refreshed"), F.array_join("degraded", ",").alias("degraded"), "checked_at", "state")


@register("diagnostic_dedup", "SELECT event_type AS code, user_id AS reason, min(event_id) AS place FROM events GROUP BY ALL")
def diagnostic_dedup(spark: SparkSession, d: str) -> DataFrame:
    return refresh.distinct_diagnostics(B.table(spark, d, "events").select(F.col("event_type").alias("code"), F.col("user_id").alias("reason"), F.col("event_id").alias("place")))


NAMED = "(SELECT source AS root, lang || '/' || (doc_id % 200) AS path FROM documents)"


@register("label_disambiguation", f"SELECT root, path, CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN root || '/' || path ELSE path END AS label FROM {NAMED}")
def label_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    named = B.table(spark, d, "documents").select(F.col("source").alias("root"), F.concat("lang", F.lit("/"), (F.col("doc_id") % 200).cast("string")).alias("path"))
    return refresh.labels(named)


# --- discovery and paths ----------------------------------------------------------------------------------------------

PAGES = "p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS root, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS path FROM pages)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("root"), F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1).alias("path"))


EXTENSION = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"


@register("extension_lookup", f"WITH {PAGES} SELECT page_id, {EXTENSION} AS extension FROM p")
def extension_lookup(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", T.extension(F.col("path")).alias("extension"))


KNOWN = ", ".join(f"('{k}', '{e}')" for k, v in sorted(languages.LANGUAGES.items()) for e in v)
SOURCES = "(SELECT p_partkey AS id, p_name || CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.h++' WHEN 4 THEN '.md' WHEN 5 THEN '.rs' WHEN 6 THEN '' ELSE '.go' END AS path FROM part)"


@register("discover_supported", f"SELECT s.id, s.path, l.language, CASE WHEN l.language IS NULL THEN 'no language has the extension ' || chr(39) || {EXTENSION} || chr(39) END AS reason FROM {SOURCES} s LEFT JOIN (VALUES {KNOWN}) l(language, extension) ON {EXTENSION} = l.extension")
def discover_supported(spark: SparkSession, d: str) -> DataFrame:
    names = [".py", ".TS", ".tsx", ".h++", ".md", ".rs", "", ".go"]
    named = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("path"))
    return discovery.with_language(named).select("id", "path", "language", "reason")


@register("exclusion_filter", f"WITH {PAGES} SELECT page_id, path FROM p WHERE NOT (list_has_any(string_split(path, '/'), ['de', 'es']) OR path = 'en/1' OR starts_with(path, 'en/1/') OR instr('/' || path || '/', '/en/1/') > 0)")
def exclusion_filter(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).filter(~T.excluded(F.col("path"), ["de", "es", "en/1"])).select("page_id", "path")


OWNED = [("all", ""), ("english", "en"), ("german", "de"), ("tens", "en/10")]


@register("root_ownership", f"WITH {PAGES}, r AS (SELECT * FROM (VALUES {', '.join(str(x) for x in OWNED)}) t(owner, prefix)) SELECT page_id, path, arg_max(owner, length(prefix)) AS owner FROM p JOIN r ON prefix = '' OR path = prefix OR starts_with(path, prefix || '/') GROUP BY ALL")
def root_ownership(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", "path", T.longest_owner(F.col("path"), OWNED).alias("owner"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace(translate(x, '\\', '/'), '/{2,}', '/', 'g'), '^(\\./)+', ''), '(.)/$', '\\1')"


@register("path_normalize", f"SELECT page_id, {CLEAN} AS path FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN './' WHEN 1 THEN '\\' ELSE '' END || replace(url, '://', '//') || CASE page_id % 2 WHEN 0 THEN '/' ELSE '' END AS x FROM pages)")
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    head = F.when(n % 3 == 0, "./").when(n % 3 == 1, "\\").otherwise("")
    x = F.concat(head, F.regexp_replace("url", "://", "//"), F.when(n % 2 == 0, "/").otherwise(""))
    return B.table(spark, d, "pages").select("page_id", T.clean_path(x).alias("path"))


COLLAPSE = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@register("snippet", f"SELECT doc_id, CASE WHEN length(s) > 180 THEN substring(s, 1, 177) || '...' ELSE s END AS snippet FROM (SELECT doc_id, {COLLAPSE.format('text')} AS s FROM documents)")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@register("context_snippet", f"""SELECT doc_id, CASE WHEN length(s) > 160 THEN trim(substring(s, CAST(floor((length(s) - 160) / 2) AS BIGINT) + 1, 157)) || '...' ELSE s END AS snippet
FROM (SELECT doc_id, {COLLAPSE.format('substring(text, lo + 1, pos + 90 - lo)')} AS s FROM (SELECT doc_id, text, doc_id % 300 AS pos, greatest(doc_id % 300 - 80, 0) AS lo FROM documents))""")
def context_snippet(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("doc_id") % 300).cast("int")
    return B.table(spark, d, "documents").select("doc_id", T.context_snippet(F.col("text"), at, at + 10).alias("snippet"))


# --- analysis ---------------------------------------------------------------------------------------------------------

BRANCH = ["and", "or", "y", "o", "und", "et", "if", "for"]
NODES = B.LINES + f""",
words AS (SELECT root, path, line, unnest(words) AS w, generate_subscripts(words, 1) AS place, words FROM lines),
nodes AS (SELECT root, path, line, lower(w) IN ({', '.join(f"'{b}'" for b in BRANCH)}) AS is_branch, w LIKE '%.' OR w LIKE '%,' AS is_statement, len(list_filter(list_slice(words, 1, place - 1), lambda x: lower(x) IN ({', '.join(f"'{b}'" for b in BRANCH)}))) AS depth FROM words),
metrics AS (SELECT root, path, line, 1 + sum(is_branch::INT)::BIGINT AS cyclomatic_complexity, sum(is_statement::INT)::BIGINT AS statement_count, max(depth)::BIGINT AS max_nesting_depth, (max(line) - min(line) + 1)::BIGINT AS lines_of_code FROM nodes GROUP BY root, path, line)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Words of a line as nodes of a function; the branches before a word are those above it."""
    each = B.lines(spark, d).select("root", "path", "line", F.posexplode("words").alias("place", "w"))
    branch = F.lower("w").isin(BRANCH)
    before = Window.partitionBy("root", "path", "line").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(branch.cast("int")).over(before), F.lit(0))
    nodes = each.select("root", "path", "line", branch.alias("is_branch"), (F.col("w").endswith(".") | F.col("w").endswith(",")).alias("is_statement"), depth.alias("depth"))
    return analysis.function_metrics(nodes.withColumn("at", F.col("line")), ["root", "path", "at"]).withColumn("line", F.col("at").cast("long")).drop("at")


@register("complexity_metrics", f"WITH {NODES} SELECT * FROM metrics")
def complexity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d)


@register("complexity_summary", f"WITH {NODES} SELECT count(*) AS total, coalesce(floor(avg(cyclomatic_complexity) * 100 + 0.5) / 100.0, 0.0)::DOUBLE AS average, coalesce(max(cyclomatic_complexity), 0) AS greatest FROM metrics")
def complexity_summary(spark: SparkSession, d: str) -> DataFrame:
    return analysis.complexity_summary(metrics(spark, d))


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """Words that end a sentence call what stands before the stop; lines of a file enclose by their first words."""
    each = B.lines(spark, d).select("root", "path", "line", F.posexplode("words").alias("place", "w"), F.col("words"))
    each = each.filter(F.col("w").endswith("."))
    chain = F.when(F.col("place") == 0, F.array().cast("array<string>")).when(F.col("line") % 2 == 0, F.array(F.col("words")[0])).otherwise(F.array(F.lit("outer"), F.col("words")[0]))
    return each.select("root", "path", F.regexp_replace("w", r"\.+$", "").alias("callee"), (F.col("line").cast("long") * B.LINE + F.col("place")).alias("start"), chain.alias("chain"), F.array_join("words", " ").alias("text"), "line")


SITES = B.LINES + f""",
sites0 AS (SELECT root, path, line, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS place, words FROM lines),
sites AS (SELECT root, path, regexp_replace(w, '\\.+$', '') AS callee, line * {B.LINE} + place AS start, line, array_to_string(words, ' ') AS text,
  CASE WHEN place = 0 THEN []::VARCHAR[] WHEN line % 2 = 0 THEN [words[1]] ELSE ['outer', words[1]] END AS chain FROM sites0 WHERE w LIKE '%.')"""


@register("find_callers", f"WITH {SITES} SELECT root, path, start, CASE WHEN len(chain) > 0 THEN chain[-1] ELSE '(module level)' END AS function_name, CASE WHEN length(s) > 120 THEN substring(s, 1, 117) || '...' ELSE s END AS snippet FROM (SELECT *, {COLLAPSE.format('text')} AS s FROM sites) WHERE callee = 'the' AND len(chain) <= 1")
def find_callers(spark: SparkSession, d: str) -> DataFrame:
    return analysis.find_callers(call_sites(spark, d), "the", 1).select("root", "path", "start", "function_name", "snippet")


@register("call_chain", f"WITH {SITES} SELECT root, path, start, array_to_string(chain, '>') AS chain, len(chain)::INT AS depth FROM sites WHERE callee = 'the'")
def call_chain(spark: SparkSession, d: str) -> DataFrame:
    return analysis.find_callers(call_sites(spark, d), "the", 5).select("root", "path", "start", F.array_join("chain", ">").alias("chain"), F.size("chain").alias("depth"))


@register("symbol_callees", f"WITH {SITES}, f AS (SELECT root, path, callee, min(start) AS start FROM sites GROUP BY ALL) SELECT root, path, string_agg(callee, ' ' ORDER BY start) AS callees FROM f GROUP BY ALL")
def symbol_callees(spark: SparkSession, d: str) -> DataFrame:
    return analysis.callees(call_sites(spark, d), ["root", "path"]).select("root", "path", F.array_join("callees", " ").alias("callees"))


@register("symbol_signature", f"WITH {B.ENTITY} SELECT start, CASE WHEN start % 2 = 0 THEN 'class ' || name || ' extends ' || language ELSE name || '(' || kind || ') -> ' || root END AS signature FROM defs")
def symbol_signature(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("start") % 2 == 0
    defs = B.entity(spark, d).select("start", "name", F.when(even, "class").otherwise("function").alias("kind"), F.col("kind").alias("params"), F.col("root").alias("returns"), F.col("language").alias("base"))
    return analysis.signature(defs).select("start", "signature")
