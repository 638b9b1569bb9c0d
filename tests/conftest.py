import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    from wordweir.session import session

    spark = session("local[4]", partitions=4, memory="4g")
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
