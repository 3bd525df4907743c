import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))       # helpers.py

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskprice.session import local_session
    s = local_session(shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def portfolio(spark):
    from riskprice.sources.samples import sample_portfolio
    return sample_portfolio(spark)


@pytest.fixture(scope="session")
def products(spark):
    from riskprice.sources.samples import sample_products
    return sample_products(spark)
