"""End to end: workspaces on disk, through the index, to answers."""

import pytest

from tessera.plans.engine import Engine
from tessera.sources import index
from tessera.sources.discovery import RequestError

CORE = """function sanitizeName(n) { return n; }
function formatName(n) { return sanitizeName(n); }
function helper(n) { const kept = formatName; helper(n); missingExternal(n); return formatName(n); }
class Greeter { sayHello(n) { take(helper); return helper(n); } }
function orchestrate(n) { return helper(n); }
helper;
"""
VIEW = 'import { helper } from "./core";\nexport function Panel() { return helper("a"); }\n'


@pytest.fixture
def root(tmp_path):
    src = tmp_path / "ws" / "src"
    src.mkdir(parents=True)
    (src / "core.ts").write_text(CORE)
    (src / "view.tsx").write_text(VIEW)
    (src / "broken.ts").write_text("function broken( {")
    (tmp_path / "ws" / "notes.txt").write_text("x")
    (tmp_path / "ws" / "node_modules").mkdir()
    (tmp_path / "ws" / "node_modules" / "a.js").write_text("function hidden() {}")
    return tmp_path / "ws"


@pytest.fixture
def engine(spark, tmp_path, root):
    out = Engine(spark, f"file://{tmp_path}/index")
    out.set_workspace(str(root))
    return out


def test_discovery(engine, root):
    rows = {(r["path"], r["language"]) for r in engine.files().collect()}
    assert rows == {("notes.txt", None), ("src/broken.ts", "typescript"), ("src/core.ts", "typescript"), ("src/view.tsx", "tsx")}
    assert engine.set_workspace(str(root), [str(root)]).facts["counts"] == {str(root): (3, 1)}


def test_search_and_resolve(engine, root):
    found = engine.search_definitions("name")
    assert [r["name"] for r in found.rows.collect()] == ["formatName", "sanitizeName"]
    assert found.facts["breakdown"] == [{"root": str(root), "searched_files": 3, "matched_files": 1, "returned_results": 2}]
    assert engine.search_definitions(" ").rows.count() == 0
    assert engine.resolve_definition("HELPER").facts["definition"]["name"] == "helper"
    assert engine.resolve_definition("nothing").diagnostics[0]["code"] == "definition_not_found"


def test_references(engine):
    out = engine.search_references("helper", limit=3)
    assert out.facts["pagination"] == {"limit_": 3, "offset_": 0, "returned": 3, "total": 7, "has_more": True, "next_offset": 3}
    assert [r["ref_kind"] for r in out.rows.collect()] == ["call", "call", "call"]
    assert {d["code"] for d in out.diagnostics} == {"parse_failed", "index_degraded"}
    assert engine.search_references("orchestrate").diagnostics[0]["code"] == "reference_not_found"
    uses = engine.list_file_references("src/core.ts", symbol="HELPER").rows.collect()
    assert uses and {r["name"] for r in uses} == {"helper"}


def test_relationships(engine):
    rows = engine.relationship_view("helper").rows.collect()
    assert {(r["edge_kind"], r["related"]["name"]) for r in rows} == {("incoming_call", "sayHello"), ("incoming_call", "orchestrate"), ("incoming_call", "Panel"), ("outgoing_call", "formatName"), ("outgoing_reference", "formatName"), ("incoming_reference", "sayHello")}
    two = engine.relationship_view("helper", depth=2).rows.collect()
    assert {(r["hop"], r["edge_kind"], r["related"]["name"]) for r in two} >= {(2, "outgoing_call", "sanitizeName")}
    assert not any(r["related"]["name"] == "helper" for r in two if r["hop"] == 1)
    with pytest.raises(RequestError):
        engine.relationship_view("helper", depth=3)


def test_dependencies(engine):
    out = engine.dependency_analysis("orchestrate", depth=3).rows.collect()
    assert {(r["direction"], r["name"], r["depth"]) for r in out} == {("outgoing", "helper", 1), ("outgoing", "formatName", 2), ("outgoing", "sanitizeName", 3)}
    assert all(len(r["steps"]) == r["depth"] for r in out)


def test_analysis(engine):
    found = engine.analyze_complexity("src/core.ts")
    assert found.facts["summary"]["total"] == 5 and found.diagnostics == []
    assert [(r["name"], r["cyclomatic_complexity"], r["lines_of_code"]) for r in found.rows.collect()][:2] == [("sanitizeName", 2, 1), ("formatName", 2, 1)]
    assert [r["name"] for r in engine.analyze_complexity("src/core.ts", symbol="helper").rows.collect()] == ["helper"]
    broken = engine.analyze_complexity("src/broken.ts")
    assert broken.facts["summary"]["total"] == 0 and broken.diagnostics[0]["code"] == "parse_failed"
    assert engine.analyze_complexity("notes.txt").diagnostics[0]["code"] == "unsupported_file"
    callers = engine.find_callers("helper").rows.collect()
    assert [r["function_name"] for r in callers] == ["helper", "sayHello", "orchestrate", "Panel"]
    context = engine.symbol_context("helper").facts
    assert context["signature"] == "helper(n)" and context["callees"] == ["helper", "missingExternal", "formatName"]


def test_file_symbols(engine):
    assert [r["name"] for r in engine.list_file_symbols("src/view.tsx").rows.collect()] == ["Panel"]
    assert engine.list_file_symbols("src/broken.ts").diagnostics[0]["code"] == "parse_failed"
    assert engine.list_file_symbols("notes.txt").diagnostics[0]["code"] == "unsupported_file"
    assert engine.list_file_symbols("src/none.ts").diagnostics[0]["code"] == "file_not_found"


def test_refresh(engine, root):
    assert engine.records()[1]["freshness"] == "degraded"  # a broken file
    (root / "src" / "broken.ts").write_text("function mended() { return helper(1); }")
    records, facts = engine.records()
    assert (facts["freshness"], facts["refreshed_files"], facts["refreshed_count"], facts["degraded_files"]) == ("refreshed", ["src/broken.ts"], 1, [])
    assert ("incoming_call", "mended") in {(r["edge_kind"], r["related"]["name"]) for r in engine.relationship_view("helper").rows.collect()}
    (root / "src" / "broken.ts").unlink()
    assert engine.records()[1]["refreshed_files"] == ["src/broken.ts"]
    facts = engine.records()[1]
    assert (facts["freshness"], facts["refreshed_files"], facts["degraded_count"]) == ("fresh", [], 0)


def test_two_roots(spark, tmp_path):
    roots = []
    for name in ("a", "b"):
        (tmp_path / name / "src").mkdir(parents=True)
        (tmp_path / name / "src" / "shared.py").write_text("def greet():\n    return bridge()\n\ndef bridge():\n    return 1\n\ndef greet_all():\n    return greet()\n")
        roots.append(str(tmp_path / name))
    engine = Engine(spark, f"file://{tmp_path}/index")
    engine.set_workspace(roots=roots[::-1])
    found = engine.search_definitions("greet").rows.collect()
    assert [(r["name"], r["root"]) for r in found] == [("greet", roots[1]), ("greet", roots[0]), ("greet_all", roots[1]), ("greet_all", roots[0])]
    edges = engine.relationship_view("bridge").rows.collect()
    assert {(r["edge_kind"], r["related"]["root"]) for r in edges} == {("incoming_call", r) for r in roots}
    assert {r["root"] for r in engine.search_definitions("greet", roots=[roots[0]]).rows.collect()} == {roots[0]}
    with pytest.raises(RequestError):
        engine.search_definitions("greet", roots=["/nowhere"])
    with pytest.raises(RequestError):
        engine.search_definitions("greet", prefix="../x")
    with pytest.raises(RequestError):
        Engine(spark, f"file://{tmp_path}/other").files()


def test_a_store_that_only_spark_reads(spark, tmp_path, root):
    engine = Engine(spark, f"file://{tmp_path}/index")
    uri = f"file://{root}"
    engine.set_workspace(uri)
    assert sorted(r["path"] for r in engine.files().collect()) == ["notes.txt", "src/broken.ts", "src/core.ts", "src/view.tsx"]
    assert [r["name"] for r in engine.search_definitions("helper").rows.collect()] == ["helper"]
    assert engine.records()[1]["freshness"] == "degraded"


@pytest.fixture
def two(spark, tmp_path):
    """Root a has 121 callers of bridge, root b one in Python and one in JavaScript; configured as b, a."""
    roots = [str(tmp_path / name) for name in ("a", "b")]
    for r in roots:
        (tmp_path / r / "src").mkdir(parents=True)
    (tmp_path / "a" / "src" / "many.py").write_text("def bridge():\n    return 1\n" + "".join(f"def caller{i:03d}():\n    return bridge()\n" for i in range(121)))
    (tmp_path / "b" / "src" / "one.py").write_text("def only():\n    return bridge()\ndef above():\n    return only()\n")
    (tmp_path / "b" / "src" / "one.js").write_text("function bridge() { return other(); }\nfunction script() { return bridge(); }\n")
    engine = Engine(spark, f"file://{tmp_path}/index")
    engine.set_workspace(roots=roots[::-1])
    return engine, roots


def test_filters_come_before_the_budget(two):
    engine, (a, b) = two
    lookup = {"name": "bridge", "root": a, "language": "python"}
    for depth in (1, 2):
        rows = engine.relationship_view(lookup=lookup, roots=[b], depth=depth).rows.collect()
        assert {(r["hop"], r["related"]["name"]) for r in rows} == {(1, "only"), (2, "above")} - ({(2, "above")} if depth == 1 else set())
    everything = engine.relationship_view(lookup=lookup, depth=2)
    assert everything.facts["budget_reached"] and any(d["code"] == "relationship_budget_reached" for d in everything.diagnostics)
    assert engine.relationship_view(lookup=lookup, language="javascript", depth=2).rows.count() == 0
    python = engine.relationship_view(lookup=lookup, roots=[b], language="Python", depth=2).rows.collect()
    assert {r["related"]["name"] for r in python} <= {"only", "above"} and python


def test_roots_come_as_configured(two):
    engine, (a, b) = two
    rows = engine.relationship_view(lookup={"name": "bridge", "root": a, "language": "python"}, limit=3).rows.collect()
    assert [r["related"]["root"] for r in rows] == [b, a, a]
    found = engine.dependency_analysis(lookup={"name": "bridge", "root": a, "language": "python"}, depth=1).rows.collect()
    assert [r["root"] for r in found][:2] == [b, a] and len(found) == 50
    only = engine.dependency_analysis(lookup={"name": "bridge", "root": a, "language": "python"}, roots=[b], depth=3).rows.collect()
    assert {(r["name"], r["depth"]) for r in only} == {("only", 1), ("above", 2)}
    assert engine.dependency_analysis(lookup={"name": "bridge", "root": a, "language": "python"}, language="javascript").rows.count() == 0
    uses = engine.search_references(lookup={"name": "bridge", "root": a, "language": "python"}, limit=2).rows.collect()
    assert [r["root"] for r in uses] == [b, a]


def test_a_duplicate_past_the_limit_marks_the_budget(spark, monkeypatch):
    from tessera.operators import graph

    columns = "root string, path string, language string, kind string, name string, start long, stop long"
    defs = spark.createDataFrame([("r", "p", "python", "function", n, s, e) for n, s, e in (("seed", 0, 9), ("outer", 100, 199), ("inner", 150, 180), ("leaf", 300, 309))], columns)
    refs = spark.createDataFrame([("r", "p", "python", "call", n, s, w, "function") for n, s, w in (("seed", 110, "outer"), ("seed", 160, "inner"), ("leaf", 170, "inner"))], "root string, path string, language string, ref_kind string, name string, start long, encl_name string, encl_kind string")
    seed = defs.filter("name = 'seed'").first().asDict()
    edges, reached = graph.relationship_view(refs, defs, seed, 2, kinds=["incoming_call", "outgoing_call"])
    # Both outer and inner hold the call of leaf at 170, and that of seed at 160: equal edges of two nodes.
    n = edges.count()
    assert not reached
    for limit, want in ((n, True), (n + 1, False), (n - 1, True)):
        monkeypatch.setattr(graph, "edge_limit", lambda *_, limit=limit: limit)
        edges, reached = graph.relationship_view(refs, defs, seed, 2, kinds=["incoming_call", "outgoing_call"])
        assert (edges.count(), reached) == (min(limit, n), want)


def test_dictionary_order(spark, tmp_path):
    (tmp_path / "ws").mkdir()
    for name in ("b.py", "A.py", "a.py", "B.py", "_x.py", "\u00e9.py"):
        (tmp_path / "ws" / name).write_text("def same():\n    pass\n")
    engine = Engine(spark, f"file://{tmp_path}/index")
    answer = engine.set_workspace(str(tmp_path / "ws"))
    want = ["_x.py", "a.py", "A.py", "b.py", "B.py", "\u00e9.py"]
    assert [r["path"] for r in engine.search_definitions("same").rows.collect()] == want
    assert [x["path"] for x in answer.facts["searchable_sample"]] == want


def test_what_cannot_be_read_is_said(engine, root):
    import json
    import shutil

    health = engine.health()
    assert {d["code"] for d in health.diagnostics} == {"index_degraded"} and health.facts["degraded_files"] == ["src/broken.ts"]
    assert [x["path"] for x in health.facts["unsupported_sample"]] == ["notes.txt"] and health.facts["index"]["indexed_files"] == 3
    assert health.facts["index"]["by_root"] == {str(root): (3, 1)}
    (root / "src" / "view.tsx").write_text("function broken( {")
    assert {d["code"] for d in engine.search_definitions("helper").diagnostics} == {"index_degraded", "index_refresh_failed"}
    files = engine.files().filter("path = 'src/core.ts'")
    (root / "src" / "core.ts").unlink()  # listed, and gone when it is parsed
    (row,) = index.parse(files).collect()
    assert row["failure"] == index.UNREADABLE and row["hash"] is None and row["definitions"] == []
    assert index.diagnostics(index.parse(files)).first()["code"] == "file_unreadable"
    with pytest.raises(RequestError, match="cobol") as e:
        engine.search_definitions("helper", language="cobol")
    assert e.value.code == "unsupported_language"
    out = json.loads(engine.search_definitions("Panel").to_json())
    assert out["rows"] == [] and out["facts"]["total"] == 0 and out["diagnostics"]
    shutil.rmtree(root)
    assert engine.set_workspace(str(root.parent)).facts["freshness"] in ("fresh", "degraded")


def test_the_store_checks_what_it_loads(spark, tmp_path, root, monkeypatch):
    engine = Engine(spark, f"file://{tmp_path}/index")
    engine.set_workspace(str(root))
    (fingerprint,) = engine.fingerprints()
    for _ in range(3):
        engine.store.save(fingerprint, engine.records()[0], "refreshed")
    assert sorted(p.name for p in (tmp_path / "index" / "records" / fingerprint).iterdir()) == ["3", "4"]
    part = next((tmp_path / "index" / "records" / fingerprint / "4").glob("*.parquet"))
    part.unlink()
    assert engine.store.load(fingerprint) is None and engine.store.last["status"] == "invalid"
    assert engine.records()[0].count() == 3 and engine.store.last["status"] == "missing"
    monkeypatch.setattr(index, "VERSION", "999")
    monkeypatch.setattr(engine, "fingerprints", lambda: [fingerprint])
    assert "index_schema_mismatch" in {d["code"] for d in engine.health().diagnostics}
    assert engine.store.manifest(fingerprint)["version"] == "999"


def test_answers_leave_nothing_but_themselves(engine, monkeypatch):
    from tessera.plans import engine as module, shared

    monkeypatch.setattr(module, "ANSWERS", 2)
    before = len(shared.WRITTEN)
    engine.relationship_view("helper", depth=2)
    engine.dependency_analysis("orchestrate", depth=3)
    assert len(shared.WRITTEN) == before + 2
    last = engine.search_definitions("helper"), engine.search_references("helper")
    assert len(shared.WRITTEN) == before + 2 and all(x.rows.count() for x in last)


def test_where_a_file_breaks(spark):
    from tessera.sources.languages import FRONTENDS

    for language, text, place in (("typescript", "let x = 1;\nfunction broken( {", (28, 2, 18)), ("javascript", "a();\n}", (5, 2, 1)), ("python", "x = 1\ndef two(:\n", (14, 2, 9)), ("python", "x = (1,\n", (4, 1, 5))):
        out = FRONTENDS[language](text)
        assert out.failure and (out.at, out.line, out.column) == place


def test_requests_at_once_share_a_refresh(engine, monkeypatch):
    import threading

    times, go = [], threading.Event()
    real = engine.refreshed

    def slow():
        times.append(1)
        go.wait(30)
        return real()

    monkeypatch.setattr(engine, "refreshed", slow)
    out = []
    threads = [threading.Thread(target=lambda: out.append(engine.records()[1]["freshness"])) for _ in range(4)]
    for t in threads:
        t.start()
    while not times:
        pass
    threading.Timer(0.5, go.set).start()
    for t in threads:
        t.join()
    assert out == ["degraded"] * 4 and len(times) == 1


def test_time_and_size_alone_can_decide(spark, tmp_path, root):
    import os

    engine = Engine(spark, f"file://{tmp_path}/index", stat_only=True)
    engine.set_workspace(str(root))
    path = root / "src" / "view.tsx"
    at = os.stat(path)
    path.write_text(VIEW.replace("Panel", "Other"))
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert engine.records()[1]["refreshed_files"] == []
    assert Engine(spark, f"file://{tmp_path}/other").set_workspace(str(root)) and engine.records()[1]["refreshed_files"] == []
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns + 5_000_000_000))
    assert engine.records()[1]["refreshed_files"] == ["src/view.tsx"]


def test_implements_of_a_symbol(spark, tmp_path):
    (tmp_path / "ws").mkdir()
    (tmp_path / "ws" / "a.ts").write_text("class A extends B implements C, D { run() { return 1; } }")
    engine = Engine(spark, f"file://{tmp_path}/index")
    engine.set_workspace(str(tmp_path / "ws"))
    facts = engine.symbol_context("A").facts
    assert facts["extends"] == "B" and facts["implements"] == ["C", "D"] and facts["signature"] == "class A extends B"
