import pytest

from lectern.session import session


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
