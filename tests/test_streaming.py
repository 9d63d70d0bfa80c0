from tessera.sources import index
from tessera.streaming import live


def rows(spark, *files):
    return spark.createDataFrame([("r", p, float(t), len(c or ""), c) for p, t, c in files], live.FILES)


def test_stream_keeps_the_index(spark, tmp_path):
    store = index.Store(spark, f"file://{tmp_path}/index")
    source = f"{tmp_path}/in"
    rows(spark, ("a.py", 1, "def one():\n    return two()\n"), ("b.py", 1, "def two(:"), ("c.txt", 1, "x")).write.parquet(source)

    def run():
        live.follow(spark, source, store, "f", f"{tmp_path}/checkpoint").awaitTermination()
        records = store.load("f")
        return sorted(r["name"] for r in index.child(records, "definitions").collect()), sorted(r["path"] for r in index.diagnostics(records).collect())

    assert run() == (["one"], ["b.py"])
    rows(spark, ("b.py", 2, "def late():\n    pass\n"), ("b.py", 3, "def two():\n    pass\n"), ("a.py", 2, None)).write.mode("append").parquet(source)
    assert run() == (["two"], [])
    assert store.manifest("f")["generation"] == 2
