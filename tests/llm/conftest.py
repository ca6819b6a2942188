import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with the other columns of the table and an extra one."""

    def make(rows, partitions=3):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
        return spark.createDataFrame(data, schema).repartition(partitions)

    return make


LONG = " ".join(f"word{i % 997}, And{i}" for i in range(30_000))

#: Nulls, empty and blank texts, one very long text, ties and repeated rows.
ODD = [(None, "no id here"), (1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "same text twice here"), (6, "same text twice here"), (6, "same text twice here"), (7, "É ß Ω \U0001f600 x y"), (8, "a")]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def none(documents):
    return documents([])
