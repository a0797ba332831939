import pytest

#: Rows that every operator must take: nulls in any column, empty texts, repeated rows, clashing extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, root long, fp long, hash long, words string, template string, features string, score double"
PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven small birds watch from an old tree."


@pytest.fixture(scope="session")
def table(spark):
    """Makes a documents table from (doc_id, text[, lang[, source]]) rows, with extra columns of awkward names."""

    def make(rows):
        filled = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r, 7, "x", 1, 2, 3, "w", "t", "f", 0.5) for r in filled], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    return [(1, PROSE, "en", "a/b"), (2, None, None, None), (3, "", "en", "a"), (None, PROSE, "en", "a/b"), (1, PROSE, "en", "a/b"), (4, "\n \t", None, "c"), (5, "word " * 30_000, "de", "c/d"), (6, "Ünïcödé 🙂 naïve", "fr", None)]
