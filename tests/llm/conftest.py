import pytest
from helpers import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark, documents):
    """Real documents beside nulls, empty and long texts, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F

    some = [tuple(r) for r in documents.orderBy("doc_id").limit(60).collect()]
    long = " ".join(r[1] for r in some) * 3
    rows = some + [
        (None, some[0][1], "en", "src1", 5),
        (None, None, None, None, None),
        (1001, None, "en", None, None),
        (1002, "", None, "src2", 0),
        (1003, " \n\t ", "fr", "src2", 3),
        (1004, "12 34 %%", "de", "src3", 8),
        (1005, long, "en", "src4", len(long)),
        (1006, "one", "en", "src0", 3),
        (1006, "one", "en", "src0", 3),
        (1007, "ONE", "en", "src0", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "uid", "row", "component_id", "shard", "part", "stats", "score", "hits", "epoch", "_found", "digest", "domain", "a.b"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
