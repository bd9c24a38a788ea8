import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    return local_session(4, **{
        "spark.sql.warehouse.dir": str(warehouse),
        "spark.driver.memory": "4g",
    })


@pytest.fixture
def frame(spark):
    """Rows from tuples and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def database(spark):
    import uuid

    name = f"t_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def bag(df):
    """Rows of a frame in an order that does not matter."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
