import pytest
from pyspark.sql import SparkSession

TEXT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents table of texts, or of (doc_id, text) pairs."""

    def make(rows):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(rows)]
        return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], TEXT_SCHEMA)

    return make
