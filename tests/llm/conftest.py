import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) of the smallest generated table, with the awkward cases added."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    return [*rows, (10_001, None), (10_002, ""), (10_003, "  \n\t "), (10_004, "One two."), (10_005, "One two."), (10_006, "ONE TWO."), (10_007, "é" * 3000 + " x" * 2000)]


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame([(i, t, "en", f"src{i % 5}" if i % 7 else None, len(t or "")) for i, t in documents], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def in_workers():
    """Call it with a module: its functions then go to the workers with the module's present constants. Without it the
    workers import the module anew and know nothing of what a test has set."""
    modules = []

    def send(module):
        cloudpickle.register_pickle_by_value(module)
        modules.append(module)

    yield send
    for module in modules:
        cloudpickle.unregister_pickle_by_value(module)


@pytest.fixture
def small_batches(spark):
    """Tables reach the workers ten rows at a time, so that blocks can be cut within a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10")
    yield
    spark.conf.unset(name)
