import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veloframe.session import clear_saved, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", "4", shuffle_partitions=4, memory="6g",
                      scratch=str(tmp_path_factory.mktemp("shared")))
    yield s
    clear_saved(s)
    s.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a small result."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
