import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tessella.session import local_session

    os.environ.setdefault("TESSELLA_DRIVER_MEMORY", "4g")
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c
