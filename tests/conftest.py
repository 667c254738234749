import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("OMP_NUM_THREADS", "1")

from lanternspark.plans.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark__sql__shuffle__partitions": "4", "spark__default__parallelism": "4"})


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df):
    return sorted(tuple(r) for r in df.collect())
