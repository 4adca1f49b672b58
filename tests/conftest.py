import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from winnowry.session import local_session

    session = local_session(8, 8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of one column expression over one literal."""
    from pyspark.sql import functions as F

    def value(make, *args):
        row = spark.range(1).select(*[F.lit(a).alias(f"a{i}") for i, a in enumerate(args)])
        return row.select(make(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return value
