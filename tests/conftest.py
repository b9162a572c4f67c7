import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from krylake.session import session

    s = session("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for n in os.listdir(SF):
        c.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{n}'")
    return c
