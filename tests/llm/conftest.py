import pytest

TEXTS = [
    (1, "Alpha beta gamma delta.", "en", "s"),
    (2, "Alpha  beta\tgamma delta.", "en", "s"),
    (3, None, None, None),
    (4, "", "fr", "s"),
    (5, "Alpha beta gamma delta.", "de", "t"),
    (5, "Alpha beta gamma delta.", "de", "t"),
    (None, "no id here", "en", "t"),
    (7, "x " * 20000, "en", "t"),
    (8, "42 !!", "en", "t"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    clash = {c: frame["source"] for c in ("hash", "fp", "n", "rid", "score", "keep_id", "x", "words", "key", "group_size", "_salt", "block", "parts", "_cuts", "n_cut", "_text", "_language", "_certainty", "spans", "owner", "bucket", "place", "digest")}
    return frame.withColumns(clash)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
