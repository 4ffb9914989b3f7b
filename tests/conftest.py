import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from houselights.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def table(spark):
    """Rows and a schema text to a DataFrame; timestamps are given as text."""
    def make(rows, schema, times=()):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({name: df[name].cast("timestamp_ntz") for name in times}) if times else df
    return make


@pytest.fixture
def tickets(table):
    """Tickets from (customer, type, paid, performance) plus optional zone, season and attendance."""
    def make(rows):
        full = []
        for row in rows:
            cust, kind, paid, perf, *rest = row
            zone, season, attended = (list(rest) + [None] * 3)[:3]
            full.append((cust, season or "PS 18-19 Classics", kind, float(paid), zone or "Price 1 - Orchestra", perf, perf,
                         "A", "1", "7", attended))
        return table(full, "summary_cust_id bigint, season_desc string, price_type_group string, paid_amt double, "
                           "zone_desc string, perf_dt string, order_dt string, section string, row string, seat string, "
                           "attended string", times=("perf_dt", "order_dt"))
    return make
