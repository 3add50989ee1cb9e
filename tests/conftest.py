import pytest

from tallyguard.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return local_session(8, "tallyguard-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": shared})
