import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd(spark, frame):
    """Nulls, blanks, repeats, ties, a null id, and columns whose names clash with inner ones."""
    long = " ".join(f"w{k % 97}" for k in range(9000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (5, "other text here"), (None, "no id at all"), (7, long), (8, long), (9, "\n\n\n\n\n")]
    df = frame(rows)
    return df.selectExpr("*", "1 as tag", "2 as a", "3 as b", "'x' as anchor", "4 as ranges", "5 as size", "6 as rep", "7 as _row", "8 as fp", "9 as score")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
