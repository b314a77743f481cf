import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text, source) rows -> documents, with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    def make(data):
        df = spark.createDataFrame(data, "doc_id long, text string, source string")
        return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "row": F.lit(1), "kept": F.lit("x"), "size": F.lit(2), "id": F.lit(3), "fp": F.lit(4), "copies": F.lit(5), "key": F.lit(6)})

    return make
