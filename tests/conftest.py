import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g", "eventloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def base(spark):
    rows = [(5.7, "JBZ", 1), (14.0, "IKH", 2), (9.6, "LME", 3)]
    return spark.createDataFrame(rows, "Area_Ch01 double, Donor string, File_Number long")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
