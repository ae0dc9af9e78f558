import pytest

#: Nulls in every column, empty and very long texts, repeated rows, ties, clashing extra columns.
EDGE = [
    (1, "a b c d e f g h", "en", "s1", "x"), (1, "a b c d e f g h", "en", "s1", "x"), (2, None, None, None, None), (None, "no id here at all friends", "en", "s1", None),
    (3, "", "de", "s2", "y"), (4, "wort " * 6000, "de", "s2", "z"), (5, "x" * 60000, None, "s2", None), (6, "\n \t ", "en", None, ""), (7, "one", "en", "s1", "q"),
    (8, "Ünïcödé 中文 😀 <|endoftext|> text", "en", "s3", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, size string")
    return df.selectExpr("*", "size as n_tokens", "size as bin", "size as kept", "size as class_id", "1 as n", "source as bucket")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
