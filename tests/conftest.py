import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from tremorlake.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def quakes(spark):
    from tremorlake.sources.events_view import quakes

    return quakes(spark, DATA)


@pytest.fixture(scope="session")
def features(spark):
    from tremorlake.sources.events_view import features

    return features(spark, DATA)
