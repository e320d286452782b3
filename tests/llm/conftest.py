import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from awkward import write  # noqa: E402


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"), empty=False)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), empty=True)
