import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from editrail.runtime import session

    s = session("tests", "local[4]")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    # tables of a few rows: compiling their plans would take longer than running them
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    return s
