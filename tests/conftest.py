import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tests.check_oracles import session

    return session()


@pytest.fixture
def frame(spark):
    """A table of texts, numbered from 1."""

    def build(*texts):
        return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")

    return build
