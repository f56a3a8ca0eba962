import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tsudoi.session import local_session
    session = local_session(4, "tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of one expression over rows of text columns."""
    def run(rows, schema, expression):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
        return [r[0] for r in df.select("_i", expression.alias("v")).orderBy("_i").select("v").collect()]
    return run
