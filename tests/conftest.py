import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(memory="4g", name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def privacy_small(spark):
    return spark.createDataFrame([
        (25, "Male", "110001", "Flu"), (25, "Male", "110001", "Cold"), (25, "Male", "110001", "Flu"),
        (30, "Female", "110002", "Flu"), (30, "Female", "110002", "Flu"), (60, "Male", "110003", "Cancer"),
    ], "Age int, Gender string, Pincode string, Diagnosis string")
