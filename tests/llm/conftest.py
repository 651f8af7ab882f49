import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
LONG = "the quick brown fox jumps over the lazy dog and runs along the river bank until night falls . " * 400


def prose(k: int, n: int = 80) -> str:
    return " ".join(f"w{(k * 31 + i * i * 7 + i) % 997}x{(k + i) % 89}" for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, copies, a repeated row, columns with clashing names."""
    rows = [(i, prose(i), "en" if i % 2 else "de", "s", 1, 0.5, "x") for i in range(20)]
    rows += [(20, None, None, None, None, None, None), (21, "", "en", "s", 0, None, None), (22, " \n\t ", "en", "s", 3, None, None), (None, prose(3), "en", "s", 1, None, None)]
    rows += [(23, LONG, "en", "s", len(LONG), None, None), (24, prose(5), "en", "s", 1, None, None), (24, prose(5), "en", "s", 1, None, None)]
    rows += [(25, "Licensed under the MIT License . mit license", "en", "s", 1, None, None), (26, "日本語 🙂 naïve ÀÉ", None, "s", 1, None, None), (27, "a" * 3000, "en", "s", 1, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
