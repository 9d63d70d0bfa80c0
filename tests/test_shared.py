import pytest

from tessera.plans import shared


def test_salted_join_meets_hot_and_cold_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    left = spark.createDataFrame([(i, "a" if i < 20 else "b" if i < 22 else "c" if i < 23 else None) for i in range(24)], "i long, k string")
    right = spark.createDataFrame([("a", 20, 1), ("b", 2, 2), (None, 1, 9)], "k string, n long, v long")
    got = {r["i"]: (r["v"], r["n"]) for r in shared.salted_join(left, right, ["k"], "n").collect()}
    assert got == {i: (1, 20) if i < 20 else (2, 2) if i < 22 else (None, None) for i in range(24)}
    monkeypatch.setattr(shared, "HOT_KEYS", 0)
    assert {r["i"]: (r["v"], r["n"]) for r in shared.salted_join(left, right, ["k"], "n").collect()} == got


def test_written_tables_can_be_dropped(spark):
    before = len(shared.WRITTEN)
    kept, gone, other = (shared.written(spark.range(3), "t") for _ in range(3))
    shared.drop(gone)
    assert kept.count() == 3 and len(shared.WRITTEN) == before + 2
    shared.forget(spark, before, keep=(kept,))
    assert kept.count() == 3 and shared.WRITTEN[before:] == [kept._tessera_path]
    with pytest.raises(Exception, match=r"(?i)not.*exist"):
        other.count()


def test_a_cluster_needs_a_shared_folder():
    class Held:
        def isDefined(self):
            return False

    class Conf(dict):
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    return Held()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
