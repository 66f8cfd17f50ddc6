import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lakestone.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4,
                  extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir() and not s.sparkContext.getConf().get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakestone-test-ckpt-"))
    yield s


@pytest.fixture()
def scratch(spark):
    from lakestone.session import scratch_path
    return lambda name: scratch_path(spark, name)
