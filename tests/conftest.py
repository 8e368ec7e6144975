import pytest

from tripleloom.session import build_session, clear_scratch


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()
