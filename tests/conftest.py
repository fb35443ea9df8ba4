import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from forumscope.session import local_session, shared_folder  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def community(spark):
    from forumscope.sources.fixtures import Community

    return Community(spark, SMALL)
