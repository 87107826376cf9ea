import pytest


@pytest.fixture(scope="session")
def small_sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
