"""The engine: a workspace, its index, and the requests that are answered from it.

Every answer has the freshness of the index it was read from; tables come back as DataFrames. Lists of file names in an
answer's facts and diagnostics have at most LISTED entries, with the whole number beside them. What answers read is kept
in the shared folder for the last ANSWERS of them; what was written on the way is deleted at once. Roots on a disk are
walked by the driver; larger workspaces belong into a store, whose uri Spark lists and reads.
"""

from __future__ import annotations

import json
import threading
from collections import deque
from concurrent.futures import Future
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import in_locale
from tessera.operators import analysis, graph, refresh, resolve, search
from tessera.operators.search import MAX_PAGE, PAGE, Filters
from tessera.plans import shared
from tessera.plans.shared import drop, forget, shared_dir, written
from tessera.sources import discovery, index
from tessera.sources.discovery import RequestError
from tessera.sources.languages import FRONTENDS, LANGUAGES

REQUESTS = ["info", "set_workspace", "capabilities", "health", "list_file_symbols", "search_workspace_symbols", "search_definitions", "resolve_definition", "search_references", "relationship_view", "analyze_complexity", "find_callers", "symbol_context", "dependency_analysis"]
QUERY_TYPES = list(dict.fromkeys(["file_symbols", "workspace_symbols"] + ["definition_search", "definition_resolve"] + ["reference_search", "call_site_search"] + ["relationship_view"]))
SAMPLE, LISTED, ANSWERS = 20, 1_000, 32


@dataclass
class Answer:
    """Rows, and what is said about them."""

    rows: DataFrame | None = None
    facts: dict[str, Any] = field(default_factory=dict)
    diagnostics: list[dict[str, str]] = field(default_factory=list)

    def to_json(self, most: int = MAX_PAGE) -> str:
        """The answer as one JSON object, with at most so many rows (a page never has more)."""
        rows = [json.loads(r) for r in self.rows.limit(most).toJSON().collect()] if self.rows is not None else []
        return json.dumps({"rows": rows, "facts": self.facts, "diagnostics": self.diagnostics}, default=str)


def problem(code: str, message: str, severity: str = "warning") -> dict[str, str]:
    return {"code": code, "severity": severity, "message": message}


class Engine:
    """Requests over one workspace of one or more roots."""

    def __init__(self, spark: SparkSession, folder: str | None = None, stat_only: bool = False):
        """stat_only: files whose time and size have not changed are not read again to compare their contents."""
        self.spark, self.stat_only = spark, stat_only
        self.store = index.Store(spark, folder or f"{shared_dir(spark)}/index")
        self.roots: list[str] = []
        self.exclusions: list[str] = []
        self.loads: dict[str, dict] = {}
        self._lock, self._running = threading.Lock(), None
        self._kept: deque[DataFrame] = deque()

    def keep(self, rows: DataFrame, name: str, since: int) -> DataFrame:
        """rows, written for an answer; what was written on the way, after the first `since` tables, is deleted."""
        out = written(rows, name)
        forget(self.spark, since, keep=(out, *self._kept))
        self._kept.append(out)
        while len(self._kept) > ANSWERS:
            drop(self._kept.popleft())
        return out

    # --- workspace ---

    def set_workspace(self, root: str | None = None, roots: list[str] | None = None, exclusions: list[str] | None = None) -> Answer:
        self.roots = discovery.resolve_roots(root, roots)
        self.exclusions = list(dict.fromkeys(exclusions or []))
        files = self.files()
        counts = files.groupBy("root").agg(F.count("language").alias("searchable"), F.count_if(F.col("language").isNull()).alias("unsupported"))
        facts = {"roots": self.roots, "counts": {r["root"]: (r["searchable"], r["unsupported"]) for r in counts.collect()}, **self.samples(files)}
        try:
            records, more = self.records()
        except Exception as e:  # noqa: BLE001  the workspace stands without its index
            return Answer(files, facts, [problem("index_build_failed", str(e).split("\n")[0])])
        return Answer(files, facts | more, self.notes(more) + self.failures(records))

    def samples(self, files: DataFrame) -> dict[str, list[dict]]:
        """The first SAMPLE files of either kind, by root as configured and path."""
        order = [search.root_place(self.roots), in_locale(F.col("path"))]
        first = lambda found, *columns: [r.asDict() for r in found.orderBy(*order).limit(SAMPLE).select("root", "path", *columns).collect()]
        return {"searchable_sample": first(files.filter("language IS NOT NULL"), "language"), "unsupported_sample": first(files.filter("language IS NULL"), "reason")}

    def files(self) -> DataFrame:
        if not self.roots:
            raise RequestError("workspace_not_set", "no workspace is set")
        return discovery.discover(self.spark, self.roots, self.exclusions)

    def fingerprints(self) -> list[str]:
        return [index.workspace_fingerprint(r, [*discovery.EXCLUSIONS, *self.exclusions]) for r in self.roots]

    def records(self) -> tuple[DataFrame, dict[str, Any]]:
        """Records of all roots, brought up to date, and their freshness. Requests that come while this runs share it."""
        with self._lock:
            mine = self._running is None
            if mine:
                self._running = Future()
            running = self._running
        if mine:
            try:
                running.set_result(self.refreshed())
            except BaseException as e:  # noqa: BLE001  the others get it too
                running.set_exception(e)
            finally:
                with self._lock:
                    self._running = None
        return running.result()

    def refreshed(self) -> tuple[DataFrame, dict[str, Any]]:
        files, out, parts, since = self.files(), None, [], len(shared.WRITTEN)
        counts = {"refreshed": 0, "degraded": 0}
        for root, fingerprint in zip(self.roots, self.fingerprints(), strict=True):
            records, changes, state = index.refresh(self.store, fingerprint, files.filter(F.col("root") == root), self.stat_only)
            self.loads[root] = self.store.last
            named = {"refreshed": changes, "degraded": records.filter("failure IS NOT NULL") if state == "degraded" else None}
            names: dict[str, list[str]] = {"refreshed": [], "degraded": []}
            for kind, rows in named.items():
                if rows is not None:
                    names[kind] = [r["path"] for r in rows.select("path").orderBy("path").limit(LISTED).collect()]
                    counts[kind] += len(names[kind]) if len(names[kind]) < LISTED else rows.count()
            parts.append((root, names["refreshed"], names["degraded"], state))
            out = records if out is None else out.unionByName(records)
        seen = self.spark.createDataFrame(list({(root, p) for root, a, b, _ in parts for p in a + b}), "root string, path string")
        label = {(r["root"], r["path"]): r["label"] for r in refresh.labels(seen).collect()}
        named = [(0, *[[label[root, p] for p in x] for x in (a, b)], datetime.now(UTC).isoformat(), state) for root, a, b, state in parts]
        held = self.spark.createDataFrame(named, "one int, refreshed array<string>, degraded array<string>, checked_at string, state string")
        whole = refresh.combine_freshness(held, ["one"]).first()
        forget(self.spark, since, keep=tuple(self._kept))
        facts = {"freshness": whole["state"], "checked_at": whole["checked_at"], "fingerprint": index.aggregate_fingerprint(self.fingerprints())}
        for kind, n in counts.items():
            facts |= {f"{kind}_files": whole[kind][:LISTED], f"{kind}_count": n}
        return out, facts

    @staticmethod
    def notes(facts: dict[str, Any]) -> list[dict[str, str]]:
        """What the freshness of the index says about an answer."""
        degraded, changed = facts.get("degraded_count", 0), facts.get("refreshed_count", 0)
        out = [problem("index_refresh_failed", f"of the changed files, {degraded} could not be read or parsed")] if degraded and changed else []
        return out + ([problem("index_degraded", f"{degraded} files have no rows in this answer")] if degraded else [])

    @staticmethod
    def failures(records: DataFrame) -> list[dict]:
        """The files without rows and why, each once."""
        found = refresh.distinct_diagnostics(index.diagnostics(records).withColumn("place", F.concat_ws("/", "root", "path")))
        return [r.asDict() for r in found.orderBy("place").limit(LISTED).drop("place").collect()]

    def child(self, name: str) -> tuple[DataFrame, dict[str, Any]]:
        records, facts = self.records()
        return index.child(records, name), facts

    def info(self) -> Answer:
        return Answer(facts={"name": "tessera", "version": index.VERSION, "requests": REQUESTS})

    def capabilities(self) -> Answer:
        return Answer(facts={"languages": {k: LANGUAGES[k] for k in sorted(FRONTENDS)}, "query_types": QUERY_TYPES, "requests": REQUESTS, "roots": self.roots})

    def health(self) -> Answer:
        if not self.roots:
            return Answer(facts={"status": "unset", "languages": sorted(FRONTENDS), "query_types": QUERY_TYPES}, diagnostics=[problem("workspace_not_set", "no workspace is set", "info")])
        records, facts = self.records()
        saved = [m for m in map(self.store.manifest, self.fingerprints()) if m]
        summary = {"indexed_files": sum(m["files"] for m in saved), "saved_at": max((m["saved_at"] for m in saved), default=None), "state": facts["freshness"], "by_root": {r["root"]: (r["files"], r["degraded"]) for r in self.by_root(records).collect()}}
        stale = [problem("index_schema_mismatch", f"the index of {r} had version {x['actual']} and was built anew") for r, x in self.loads.items() if x["status"] == "schema_mismatch"]
        return Answer(index.diagnostics(records), {"status": "ok", "roots": self.roots, "exclusions": [*discovery.EXCLUSIONS, *self.exclusions], "languages": sorted(FRONTENDS), "query_types": QUERY_TYPES, "index": summary, **self.samples(self.files()), **facts}, self.notes(facts) + stale)

    def by_root(self, records: DataFrame) -> DataFrame:
        """Per root: records and how many of them are degraded."""
        return records.groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.count("failure").alias("degraded")).orderBy(search.root_place(self.roots))

    # --- search ---

    def filters(self, roots=None, language=None, prefix=None, kinds=None) -> Filters:
        """Roots, then the prefix, then the language are checked; the first that does not hold is the error."""
        chosen, under = discovery.chosen_roots(roots, self.roots), discovery.prefix_of(prefix, self.roots)
        return Filters(chosen, self.known_language(language), under, list(dict.fromkeys(kinds or [])))

    @staticmethod
    def known_language(language: str | None) -> str | None:
        name = language.strip().lower() if language else ""
        if name and name not in FRONTENDS:
            raise RequestError("unsupported_language", f"{name} is none of {', '.join(sorted(FRONTENDS))}")
        return name or None

    def list_file_symbols(self, path: str, root: str | None = None) -> Answer:
        """The symbols of one file, parsed now."""
        root, rel = self.target(path, root)
        file = discovery.discover(self.spark, [root], self.exclusions).filter(F.col("path") == rel)
        found = file.first()
        if found is None:
            return Answer(diagnostics=[problem("file_not_found", f"{rel} is not in {root}", "error")])
        if found["language"] is None:
            return Answer(diagnostics=[problem("unsupported_file", found["reason"], "error")])
        records = index.parse(file)
        return Answer(index.child(records, "definitions").orderBy("start"), diagnostics=self.failures(records))

    def list_file_references(self, path: str, root: str | None = None, symbol: str | None = None) -> Answer:
        """The references in one file, parsed now; of one symbol if asked for."""
        root, rel = self.target(path, root)
        records = index.parse(discovery.discover(self.spark, [root], self.exclusions).filter(F.col("path") == rel))
        found = index.child(records, "references")
        found = found.filter(F.lower("name") == symbol.strip().lower()) if symbol else found
        return Answer(found.orderBy("start"), diagnostics=self.failures(records))

    def target(self, path: str, root: str | None = None) -> tuple[str, str]:
        """Root and relative path of a file: of the root given, of the longest that holds an absolute path, else of the
        only root that has the relative one."""
        import os

        roots = discovery.chosen_roots([root], self.roots) if root else self.roots
        if os.path.isabs(path):
            owner = max((r for r in roots if path.startswith(r + "/")), key=len, default=None)
            if owner is None:
                raise RequestError("workspace_path_out_of_scope", f"{path} lies in no root")
            return owner, discovery.inside(owner, path)
        rel = discovery.inside(roots[0], path)
        there = [r for r in roots if os.path.exists(f"{r}/{rel}")]
        if len(there) > 1:
            raise RequestError("workspace_path_out_of_scope", f"{rel} is in several roots")
        return (there or roots)[0], rel

    def search_definitions(self, query: str, roots=None, language=None, prefix=None, kinds=None, limit: int = PAGE) -> Answer:
        filters = self.filters(roots, language, prefix, kinds)
        records, facts = self.records()
        page = self.keep(search.search(index.child(records, "definitions"), query, filters, self.roots, limit, locale=True), "page", len(shared.WRITTEN))
        parts = search.breakdown(records.filter(filters.files()).select("root", "path"), page, filters.roots or self.roots)
        total = search.scored(index.child(records, "definitions"), query, filters).count() if query.strip() else 0
        return Answer(page.orderBy("rank"), {"total": total, "truncated": total > min(limit, MAX_PAGE), "breakdown": [r.asDict() for r in parts.collect()], **facts}, self.notes(facts))

    search_workspace_symbols = search_definitions

    def seed(self, definitions: DataFrame, symbol: str | None = None, lookup: dict | None = None) -> dict | None:
        """The definition a request means: by symbol, else by lookup (name, language, root, path, kind)."""
        lookup = lookup or {}
        name = symbol or lookup.get("name")
        if not name:
            return None
        filters = self.filters([lookup["root"]] if lookup.get("root") and not symbol else None, None if symbol else lookup.get("language"), None if symbol else lookup.get("path"), None if symbol or not lookup.get("kind") else [lookup["kind"]])
        row = resolve.resolve_definition(definitions, name, filters).first()
        return row.asDict() if row else None

    def resolve_definition(self, symbol: str | None = None, lookup: dict | None = None) -> Answer:
        definitions, facts = self.child("definitions")
        found = self.seed(definitions, symbol, lookup)
        if found is None:
            return Answer(facts=facts, diagnostics=[problem("definition_not_found", f"no definition of {symbol or (lookup or {}).get('name')}", "error")])
        return Answer(facts={"definition": found, **facts}, diagnostics=self.notes(facts))

    def graph_tables(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """References and definitions keyed by the place of their names."""
        definitions = index.child(records, "definitions").withColumn("range_start", F.col("start")).withColumn("start", F.col("sel_start"))
        references = index.child(records, "references").withColumn("range_start", F.col("start")).withColumn("start", F.col("sel_start"))
        return references, definitions

    def search_references(self, symbol: str | None = None, lookup: dict | None = None, roots=None, language=None, prefix=None, limit: int = PAGE, offset: int = 0, context: bool = True) -> Answer:
        records, facts = self.records()
        references, definitions = self.graph_tables(records)
        found = self.seed(definitions, symbol, lookup)
        if found is None:
            return Answer(facts=facts, diagnostics=[problem("definition_not_found", f"no definition of {symbol or (lookup or {}).get('name')}", "error")])
        filters = self.filters(roots, language, prefix)
        uses = resolve.references_to(references, found).filter(filters.files()).withColumn("symbol_kind", F.lit(found["kind"]))
        uses = uses if context else uses.drop("context", "encl_name", "encl_kind")
        limit = min(limit, MAX_PAGE)
        order = [search.root_place(self.roots), *search.by_path("root", "path", locale=True), F.when(F.col("ref_kind") == "call", 0).otherwise(1), F.col("start")]
        page = self.keep(search.ordered(uses, order, limit, offset), "page", len(shared.WRITTEN))
        facts |= {"target": found, "pagination": search.page_facts(uses, limit, offset).first().asDict()}
        searched = records.filter(filters.files() & resolve.compatible(found["language"]))
        facts["breakdown"] = [r.asDict() for r in search.breakdown(searched.select("root", "path"), page, filters.roots or self.roots).collect()]
        none = [problem("reference_not_found", f"no use of {found['name']}")] if not page.limit(1).count() else []
        return Answer(page.orderBy("rank"), facts, none + self.notes(facts) + self.failures(searched))

    def relationship_view(self, symbol: str | None = None, lookup: dict | None = None, roots=None, language=None, kinds: list[str] | None = None, depth: int = 1, limit: int = PAGE, offset: int = 0) -> Answer:
        if depth not in (1, 2):
            raise RequestError("relationship_depth_invalid", "depth is 1 or 2")
        chosen, language = discovery.chosen_roots(roots, self.roots), self.known_language(language)
        records, facts = self.records()
        references, definitions = self.graph_tables(records)
        found = self.seed(definitions, symbol, lookup)
        if found is None:
            return Answer(facts=facts, diagnostics=[problem("definition_not_found", "no such definition", "error")])
        kinds = [k for k in graph.KINDS if k in kinds] if kinds else graph.KINDS
        since = len(shared.WRITTEN)
        edges, reached = graph.relationship_view(references, definitions, found, depth, limit, offset, kinds, chosen, language, self.roots, locale=True)
        edges = self.keep(edges, "edges", since)
        limit = min(limit, MAX_PAGE)
        facts |= {"seed": found, "budget_reached": reached, "pagination": search.page_facts(edges, limit, offset).first().asDict()}
        skipped = graph.tried(references, definitions, [found], kinds, chosen, language).filter("reason IS NOT NULL").groupBy("reason").count().collect()
        notes = [problem("reference_not_found", f"{r['count']} uses are {r['reason']}", "info") for r in skipped] + ([problem("relationship_budget_reached", "more edges exist than were followed")] if reached else [])
        return Answer(search.ordered(edges, [F.col("hop"), *graph.edge_order(self.roots, locale=True)], limit, offset).orderBy("rank"), facts, notes + self.notes(facts))

    def key(self, of: str = "") -> Any:
        """A definition's key, which sorts by root as configured, path and place."""
        c = lambda x: F.col(f"{of}.{x}" if of else x)
        place = F.lpad(search.root_place(self.roots, c("root")).cast("int").cast("string"), 6, "0")
        return F.concat_ws("|", place, c("path"), F.lpad(c("start").cast("string"), 12, "0"))

    def links(self, records: DataFrame) -> DataFrame:
        """All resolved uses as (source, kind, target), by keys."""
        references, definitions = self.graph_tables(records)
        held = resolve.owners(resolve.three_tiers(references, definitions).filter("target IS NOT NULL"), definitions).filter("owner IS NOT NULL")
        return held.select(self.key("owner").alias("source"), F.col("ref_kind").alias("kind"), self.key("target").alias("target")).filter("source <> target").distinct()

    def dependency_analysis(self, symbol: str | None = None, lookup: dict | None = None, roots=None, language=None, kinds: list[str] | None = None, depth: int = 2, limit: int = PAGE, offset: int = 0) -> Answer:
        """What depends on a definition and what it depends on; roots and language restrict each step's other end."""
        if not 1 <= depth <= 4:
            raise RequestError("dependency_depth_invalid", "depth is 1 to 4")
        filters = self.filters(roots, language)
        records, facts = self.records()
        _, definitions = self.graph_tables(records)
        found = self.seed(definitions, symbol, lookup)
        if found is None:
            return Answer(facts=facts, diagnostics=[problem("definition_not_found", "no such definition", "error")])
        seed = self.spark.createDataFrame([tuple(found[c] for c in ("root", "path", "start"))], "root string, path string, start long").select(self.key()).first()[0]
        names = definitions.select(self.key().alias("node"), "name", "kind", "root", "path", "start", "language")
        allowed = names.filter(filters.files()).select("node") if filters.roots or filters.language else None
        since = len(shared.WRITTEN)
        out = graph.dependencies(self.links(records), seed, depth, kinds, written, allowed)
        out = self.keep(out.join(names.drop("language"), "node").drop("node"), "dependencies", since)
        limit = min(limit, MAX_PAGE)
        order = [F.col("depth"), F.col("direction"), search.root_place(self.roots), *search.by_path("root", "path", locale=True), F.col("start")]
        return Answer(search.ordered(out, order, limit, offset).orderBy("rank"), {"seed": found, "pagination": search.page_facts(out, limit, offset).first().asDict(), **facts}, self.notes(facts))

    # --- analysis ---

    def analyze_complexity(self, path: str, root: str | None = None, symbol: str | None = None) -> Answer:
        """Metrics of the functions of one file, parsed now, and their summary."""
        root, rel = self.target(path, root)
        file = discovery.discover(self.spark, [root], self.exclusions).filter(F.col("path") == rel)
        found = file.first()
        if found is None or found["language"] is None:
            return Answer(diagnostics=[problem("unsupported_file", found["reason"], "error") if found else problem("file_not_found", f"{rel} is not in {root}", "error")])
        metrics = analysis.function_metrics(index.nodes(file), ["root", "path", "name", "start", "stop"])
        metrics = metrics.filter(F.col("name") == symbol) if symbol else metrics
        return Answer(metrics.orderBy("start"), {"summary": analysis.complexity_summary(metrics).first().asDict()}, self.failures(index.parse(file)))

    def find_callers(self, symbol: str, roots=None, language=None, depth: int = 2) -> Answer:
        filters = self.filters(roots, language)
        calls, facts = self.child("calls")
        calls = calls.filter(filters.files())
        matched = calls.filter(F.col("callee") == symbol).agg(F.count_distinct("root", "path").alias("n")).first()["n"]
        found = analysis.find_callers(calls.withColumnRenamed("snippet", "text"), symbol, depth)
        return Answer(found.orderBy(search.root_place(self.roots), *search.by_path("root", "path", locale=True), "start"), {"matched_files": matched, **facts}, self.notes(facts))

    def symbol_context(self, symbol: str, path: str | None = None) -> Answer:
        records, facts = self.records()
        references, definitions = self.graph_tables(records)
        named = definitions.filter(F.col("name") == symbol)
        named = named.filter(F.col("path") == self.target(path)[1]) if path else named
        first = analysis.signature(named).orderBy("root", "path", "start").limit(20).collect()
        if not first:
            return Answer(facts=facts, diagnostics=[problem("definition_not_found", f"no definition of {symbol}", "error")])
        one = first[0]
        calls = index.child(records, "calls").filter((F.col("root") == one["root"]) & (F.col("path") == one["path"]) & F.col("start").between(one["range_start"], one["stop"]))
        called = analysis.callees(calls, ["root", "path"]).first()
        uses = references.filter(F.lower("name") == symbol.lower()).orderBy("root", "path", "start").limit(50)
        facts |= {"signature": one["signature"], "callees": called["callees"] if called else [], "extends": one["base"], "implements": [x.strip() for x in (one["implements"] or "").split(",") if x.strip()], "definitions": [r.asDict() for r in first]}
        return Answer(uses, facts, self.notes(facts))
