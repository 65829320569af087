import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from paths import SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from hazardlens.session import checkpoint_dir, get_session
    s = get_session("hazardlens-tests", master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s)  # sets a local folder only because none is configured in tests
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    from hazardlens.sources.tables import TABLES
    for t in TABLES:
        p = os.path.join(SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con
