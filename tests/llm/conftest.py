import pytest


@pytest.fixture()
def docs(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and clashing extra columns."""
    rows = [
        (1, "Alpha beta gamma.\nOne two three four.\nFive six seven.\nlast line", "en", "a", 1),
        (2, "Alpha beta gamma.\nOne two three four.\nFive six seven.\nother end", "en", "a", 2),
        (2, "Alpha beta gamma.\nOne two three four.\nFive six seven.\nother end", "en", "a", 2),
        (3, "", "en", "b", 3), (4, None, None, None, None), (None, "no id here at all", None, "c", 5),
        (5, "word " * 30_000, "en", None, 6), (6, "x" * 5000, "en", "b", 7), (7, "é ü <|endoftext|> 日本語 \u0085 a\x1cb", "fr", "b", 8),
        (8, "\n\n\n\n", "en", "a", 9), (9, "same same same same same same", "en", "c", 10),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long") \
        .selectExpr("*", "size as score", "size as n_tokens", "text as ids", "size as fp", "size as removed", "size as position")
