import pytest


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, repeated and very long texts, and extra columns whose names clash."""
    rows = [
        (1, "alpha beta gamma delta", "en", "a", 22),
        (1, "alpha beta gamma delta", "en", "a", 22),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (None, "mail kim.22@mail.example.com or +1 (499) 555-6503", "en", "b", 5),
        (4, "x" * 200_000, "en", "b", 200_000),
        (5, "word " * 30_000, "de", "", 150_000),
        (6, "éß \U0001f600 中文 ▁ \x00 end\n\n", "fr", "b", 1),
    ]
    clash = ["score", "fp", "block", "epoch", "ids", "masked", "kept_id", "mix_source", "id", "component", "z", "place", "mark", "pii", "secrets", "pieces", "n_tokens", "media", "decoded", "gone", "node"]
    df = frame(spark, rows)
    for name in clash:
        df = df.selectExpr("*", f"'keep' as `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
