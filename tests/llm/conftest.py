import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def frame(spark):
    import samples

    def build(rows, schema=samples.SCHEMA):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def edge(frame):
    import samples

    return frame(samples.edge_rows()).repartition(3)
