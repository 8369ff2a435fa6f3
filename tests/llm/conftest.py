import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True)
def _shipped(spark):
    from shelfspark.llm.common import ship_package
    ship_package(spark)
