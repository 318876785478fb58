import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from strandloom.session import local_session, ship

    session = local_session(4, shuffle_partitions=4, memory="4g")
    ship(session)
    return session
