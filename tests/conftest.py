import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from drillmill.session import build_session

    session = build_session(8, 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def make_forms(spark):
    """Forms from dicts of fields; everything else is NULL."""
    import datetime

    from drillmill.schema import FORM_SCHEMA
    from pyspark.sql import types as T

    head = [T.StructField("form_id", T.LongType()), T.StructField("source_file", T.StringType()), T.StructField("first_page", T.IntegerType()), T.StructField("template_code", T.StringType()), T.StructField("received_at", T.TimestampType())]
    schema = T.StructType([*head, *FORM_SCHEMA.fields])

    def make(*rows):
        base = {"received_at": datetime.datetime(2024, 1, 1)}
        return spark.createDataFrame([tuple((base | r).get(f.name) for f in schema) for r in rows], schema)

    return make
