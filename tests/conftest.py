import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def table(spark):
    """A table of text cells from inline CSV: header, then records; _row is the record's number."""
    import csv
    import io

    def make(text: str, schema: str | None = None):
        records = list(csv.reader(io.StringIO(text)))
        head, rows = records[0], [[*r, *[""] * (len(records[0]) - len(r))] for r in records[1:]]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row long, " + ", ".join(f"`{h}` string" for h in head))

    return make


@pytest.fixture
def rows():
    return lambda df, *columns: [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]
