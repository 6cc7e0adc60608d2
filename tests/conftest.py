import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ticketlens.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[4]", 8, app_name="ticketlens-tests")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def stages(spark):
    from ticketlens.plans.pipelines import delay_stages
    return delay_stages(spark, SF_SMALL)
