import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cabflow.session import build_session

    scratch = tempfile.mkdtemp(prefix="cabflow-tests-")
    session = build_session(
        "local[*]",
        app="cabflow-tests",
        shuffle_partitions=8,
        scratch=scratch,
        extra={"spark.ui.showConsoleProgress": "false"},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scratch(spark):
    from cabflow.session import shared_dir

    return shared_dir(spark)
