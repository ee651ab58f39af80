import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from grainscope.schemas import RASTER  # noqa: E402
from grainscope.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4, "grainscope-tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def raster(spark):
    """Rasters from a dict {name: 2-D array}."""
    def make(images, source="t"):
        rows = [(source, i, "clean", int(a.shape[0]), int(a.shape[1]), [int(v) for v in a.ravel()])
                for i, a in enumerate(images.values() if isinstance(images, dict) else images)]
        return spark.createDataFrame(rows, RASTER)

    return make
