"""The registered simulations are as many as the configuration says."""

import os
from pathlib import Path

import pytest

from marketshape.engine import StressConfig
from marketshape.plans import market

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["mc_gbm", "mc_block_bootstrap"])
def test_all_simulations_run(spark, name):
    assert market.QUERIES[name](spark, DIR).select("sim_id").distinct().count() == StressConfig().simulations
