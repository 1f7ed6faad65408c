import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts: ids from 0, a fixed language and source, extra columns of clashing names."""

    def make(texts, extra=False, source=lambda k: f"s{k % 3}"):
        rows = [(k, t, "en", source(k), None if t is None else len(t)) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            df = df.selectExpr("*", "'x' AS score", "1 AS block", "'y' AS slot", "2L AS fp", "'z' AS component_id", "3 AS spans")
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """NULL, empty, blank, very long, repeated and equal texts."""
    long = " ".join(f"w{k % 977}x" for k in range(60_000))
    return [None, "", " \n\t ", "a", "one two", "one two three", "one two three", long, long + " end", "Ünï cödé ß", "1" * 3000]
