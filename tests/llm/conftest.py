import pytest
from pyspark.sql import DataFrame, SparkSession

ODD = [
    (1, "Same text here"), (2, "Same  text\there"), (3, None), (4, ""), (5, "  \n "), (None, "same text here"), (1, "Same text here"),
    (6, "ß é 中文 😀 <|endoftext|> 's"), (7, "word " * 3000), (8, "word " * 3000), (9, "A, b. c! " * 40), (None, None), (10, "x" * 20_000),
]


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", 0, 7, "clash", "clash", 1.5) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, rep string, bits string, start double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
