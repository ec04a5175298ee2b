import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kanon.session import build_session

    s = build_session(master="local[*]", shuffle_partitions=8, app="kanon-tests")
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]


def one(spark, fn, value, schema="v string"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(value,)], schema)
    return df.select(fn(F.col("v")).alias("o")).first()["o"]
