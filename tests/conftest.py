import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compare import local_session

    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def settings(spark):
    """Set session options for the length of a ``with`` block."""

    @contextmanager
    def use(**options):
        names = {k: k.replace("__", ".") for k in options}
        old = {n: spark.conf.get(n, None) for n in names.values()}
        for k, n in names.items():
            spark.conf.set(n, options[k])
        try:
            yield
        finally:
            for n, v in old.items():
                spark.conf.unset(n) if v is None else spark.conf.set(n, v)

    return use
