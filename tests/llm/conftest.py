import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox", "en", 1, 2, 3, 4),
        (1, "The quick brown fox", "en", 1, 2, 3, 4),
        (2, "The  quick brown\tfox", None, 1, 2, 3, 4),
        (3, None, "en", None, None, None, None),
        (4, "", "en", 1, 2, 3, 4),
        (None, "no id <|endoftext|> here", None, 1, 2, 3, 4),
        (None, None, None, None, None, None, None),
        (5, long, "en", 1, 2, 3, 4),
        (6, " \n\t ", "en", 1, 2, 3, 4),
        (7, "naïve café ΑΒΣ 中文 🎉 ﷺ", "el", 1, 2, 3, 4),
        (8, "a" * 5000, "en", 1, 2, 3, 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int, _row int, score int, grams int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
