import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from profilespark.session import local_session

    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    d = Path("/root/testdata/sf0.001")
    if not d.exists():
        pytest.skip("no test tables")
    return str(d)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
