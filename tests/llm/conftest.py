import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with the given (doc_id, text) rows."""

    def build(rows, extra=()):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, COLUMNS)
        for name, value in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return build
