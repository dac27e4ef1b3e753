import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corrobora.schema import CLAIMS  # noqa: E402
from corrobora.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g", shuffle_partitions=4)


@pytest.fixture
def make_claims(spark):
    """Claims from (cluster, field, value, source, ts, offer) tuples, with trust if a 7th item is given."""

    def make(rows):
        schema = CLAIMS
        if rows and len(rows[0]) == 7:
            from pyspark.sql import types as T

            schema = T.StructType([*CLAIMS.fields, T.StructField("trust", T.DoubleType())])
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def rows_of():
    return lambda df: sorted(tuple(r) for r in df.collect())
