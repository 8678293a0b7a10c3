import pytest


@pytest.fixture(scope="session")
def table(spark):
    """documents(doc_id, text, source, lang, n_chars) of (id, text[, source]) rows, as a DataFrame."""

    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "en", None, *extra.values()) for r in rows]
        kinds = "".join(f", `{name}` string" for name in extra)
        return spark.createDataFrame(full, f"doc_id long, text string, source string, lang string, n_chars long{kinds}")

    return make


@pytest.fixture(scope="session")
def labelled(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """These tables are tiny."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
