import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def spark():
    from entityflow.session import get_spark

    return get_spark("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
