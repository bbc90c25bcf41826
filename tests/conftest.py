from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import build_session

    session = build_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    # tables of some rows: compiling a stage costs more than running it
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def clashing(df):
    """The table with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("count", "rank", "key", "sig", "term", "block", "bin", "fill", "hash", "line", "number", "shared", "slice", "fragment", "part", "kind", "n", "similarity", "rule"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(1))
    return df
