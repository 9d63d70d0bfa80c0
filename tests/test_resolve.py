import pytest

from tessera.operators import resolve
from tessera.plans import shared


@pytest.mark.parametrize("hot_rows", [2_000, 100])
def test_references_of_a_name_in_all_files_are_spread(spark, monkeypatch, hot_rows):
    from pyspark.sql import functions as F

    monkeypatch.setattr(shared, "HOT_ROWS", hot_rows)
    defs = spark.createDataFrame([("r", f"p{i}", "python", "function", f"name{i}", 1) for i in range(50)] + [("r", "p0", "python", "function", "hot", 9)], "root string, path string, language string, kind string, name string, start long")
    refs = spark.createDataFrame([("r", f"p{i % 50}", "python", "Hot" if i % 3 else f"name{i % 60}", 100 + i) for i in range(6_000)], "root string, path string, language string, name string, start long")
    hot = resolve.hot_names(refs, F.xxhash64("root", "path", "start")).collect()
    assert "hot" in {r["lname"] for r in hot} and (hot_rows < 1_000 or len(hot) == 1)
    rows = resolve.three_tiers(refs, defs).collect()
    assert len(rows) == 6_000
    for r in rows:
        name = r["name"].lower()
        known = name == "hot" or int(name[4:]) < 50
        home = "p0" if name == "hot" else f"p{name[4:]}"
        assert (r["target"] and r["target"]["path"], r["tier"]) == ((home, 0 if r["path"] == home else 1) if known else (None, None))


def test_best_of_each_and_nearest(spark):
    from pyspark.sql import functions as F

    defs = spark.createDataFrame([("r", "b", "function", "X", 1), ("r", "a", "class", "x", 7), ("q", "z", "class", "x", 2)], "root string, path string, kind string, name string, start long")
    assert [(r["lname"], r["root"], r["path"], r["start"]) for r in resolve.best_of_each(defs).collect()] == [("x", "q", "z", 2)]
    turns = spark.createDataFrame([(1, i, role) for i, role in enumerate("sauau")], "k int, turn int, role string")
    got = resolve.nearest_before(turns, ["k"], "turn", F.col("role").isin("s", "u"), "scope").orderBy("turn").collect()
    assert [r["scope"] for r in got] == [None, 0, 0, 2, 2]
