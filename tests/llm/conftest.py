import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Odd texts beside ordinary ones, with columns whose names the operators use inside."""
    rows = [
        (0, "The quick brown fox jumps over the lazy dog and runs away from it. " * 3, "en"),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it. " * 3, "en"),
        (2, None, None), (3, "", "en"), (4, " \n\t ", "de"), (5, "7", None), (6, "one two", "en"), (7, "ONE  two", "en"),
        (8, "é" * 120 + "x" * 300, "fr"), (9, "a\x00b" * 90, None), (10, "El perro come la comida en la casa grande de la calle. " * 8, "es"),
        (11, "[INST] <|endoftext|> </s> 'quoted' don't 10:30\u00a0\u00a0end", "en"), (12, "w" * 200_000, None), (13, "lorem ipsum dolor sit amet " * 9000, "fr"),
        (None, "without an id", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("*", "1 bucket", "2 n", "'x' kept", "3 label", "4 rep").repartition(3)
