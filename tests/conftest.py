import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.model import DataModel  # noqa: E402
from tessera.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="tessera-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-test-ckpt-")})
    yield s


@pytest.fixture(scope="session")
def cdm():
    path = os.path.join(os.path.dirname(__file__), "fixtures", "cdm_model.json")
    with open(path) as f:
        return DataModel.from_dict(json.load(f))


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="tessera-case-")
