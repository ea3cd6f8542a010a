import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    s = get_session("tessera-tests", cpus=4, shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dirty(spark):
    """60 meter readings with untidy headers, missing tokens and one nearly empty column."""
    gaps = {7: "n/a", 19: "", 23: "?", 41: "null"}
    rows = []
    for k in range(60):
        rows.append((500 + k, gaps.get(k, f"{90 + (k * k) % 41}"), f"{0.8 + (k % 9) * 0.05:.2f}", int(k % 5 == 2),
                     {11: "unknown", 30: "NA"}.get(k, (" Harbour", "MILL ", "Quay")[k % 3]),
                     {3: "", 13: "nan", 52: "None"}.get(k, "flat" if k % 4 else "night"),
                     "leak" if k == 31 else None, ("1.25", "4", "7.5")[k % 3]))
    schema = ("`Meter No` long, `Reading ` string, pressure string, FAULT int, `Site Label` string, "
              "plan_label string, remark string, `grade ` string")
    return spark.createDataFrame(rows, schema)
