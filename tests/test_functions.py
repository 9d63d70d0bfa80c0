import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import analysis, graph, refresh, search
from tessera.sources import discovery


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_paths(spark):
    assert values(spark, ["./a//b/", "a\\b\\c", "././x", "/", None], T.clean_path) == ["a/b", "a/b/c", "x", "/", None]
    assert values(spark, ["a/b.TS", "x.h++", ".bashrc", "noext", "a.d/b", None], T.extension) == [".ts", ".h++", "", "", "", None]
    gone = ["node_modules/x", "a/dist/b", "src/gen/x.ts", "a/src/gen", "src/generated.ts", "srcs/gen/x"]
    assert values(spark, gone, lambda c: T.excluded(c, ["node_modules", "dist", "src/gen"])) == [True, True, True, True, False, False]


def test_scores(spark):
    assert values(spark, ["greet", "Greeter", "a_greet", "other", "", None], lambda c: T.name_score(c, " Greet ")) == [0, 102, 204, None, None, None]


def test_snippets(spark):
    assert values(spark, ["  a \n b ", "x" * 200, None], T.snippet) == ["a b", "x" * 177 + "...", None]
    long = "".join(chr(97 + i % 26) for i in range(1000))
    (out,) = values(spark, [long], lambda c: T.context_snippet(c, F.lit(500), F.lit(510)))
    assert len(out) == 160 and out[:-3] in long[420:590]


def test_half_up(spark):
    row = spark.sql("SELECT 1.005D a, 2.675D b, 2.5D c").select(T.half_up(F.col("a")), T.half_up(F.col("b")), T.half_up(F.col("c"), 0)).first()
    assert list(row) == [1.0, 2.68, 3.0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "root string, path string, language string, kind string, name string, start long, stop long")
    assert search.search(empty, "x").count() == 0 and search.page_facts(empty, 5, 0).first()["total"] == 0
    assert [r["searched_files"] for r in search.breakdown(empty, empty, ["a"]).collect()] == [0]
    assert analysis.complexity_summary(spark.createDataFrame([], "cyclomatic_complexity long")).first().asDict() == {"total": 0, "average": 0.0, "greatest": 0}
    assert refresh.fold_states(spark.createDataFrame([], "state string")).first()["state"] == "rebuilding"


def test_dependency_cycle_finds_the_seed(spark):
    links = spark.createDataFrame([("a", "call", "b"), ("b", "call", "a"), ("b", "reference", "c")], "source string, kind string, target string")
    got = {(r["direction"], r["node"], r["depth"]) for r in graph.dependencies(links, "a", 3, ["outgoing_call", "outgoing_reference"], lambda df, _: df).collect()}
    assert got == {("outgoing", "b", 1), ("outgoing", "a", 2), ("outgoing", "c", 2)}


def test_roots_and_prefixes(tmp_path):
    (tmp_path / "a").mkdir()
    a = str(tmp_path / "a")
    assert discovery.resolve_roots(a, [a, f"{a}/../a"]) == [a]
    assert discovery.prefix_of(f"{a}/src", [a]) == "src" and discovery.prefix_of(".\\src\\nested", [a]) == "src/nested" and discovery.prefix_of(".", [a]) is None
    for bad in ("../x", "/elsewhere"):
        with pytest.raises(discovery.RequestError):
            discovery.prefix_of(bad, [a])
    with pytest.raises(discovery.RequestError):
        discovery.resolve_roots(f"{a}/none")
