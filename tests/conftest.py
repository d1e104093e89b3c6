from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark():
    from cardwright.session import local_session

    made = local_session(8, 4, "tests")
    yield made
    made.stop()
