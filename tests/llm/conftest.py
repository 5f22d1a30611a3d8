import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from qtrail.llm._common import prepare  # noqa: E402


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)
