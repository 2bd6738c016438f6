import pytest

#: Rows with nulls, empty and white texts, ties, repeats, a long text, and words that many share.
_COMMON = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, "Alpha  beta\tgamma"), (2, "Alpha beta gamma"), (3, None), (4, ""), (5, "   "), (6, "Alpha beta gamma"), (None, "Alpha beta gamma"), (7, _COMMON),
    (8, _COMMON + " tail of its own"), (9, "x " * 3000), (10, "one"), (10, "one"), (11, "Écoute <|endoftext|> naïve ça va bien"), (12, "a\x0bb\x0cc\r\nd"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with further columns whose names operators use themselves."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, row int").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
