import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) with clashing extra columns on request."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "uid", "key", "row", "taken", "n", "label", "unit", "target", "score"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeated rows, ties, a long text and a null doc_id."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (4, "one two three"), (5, long), (6, "one two three"), (None, "one two three"), (7, "x" * 60_000), (8, "Ünï cödé 日本 😀 \x0b mixed")]
