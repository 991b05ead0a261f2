import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tandem import session
from tandem.operators.scan import ROWS_PER_CHUNK_CONF


@pytest.fixture(scope="session")
def spark():
    built = session.build("tandem-tests", master="local[8]", shuffle_partitions=8)
    built.sparkContext.setLogLevel("ERROR")
    session.shared_dir(built)
    return built


@pytest.fixture
def small_chunks(spark):
    """Make every key of more than 20 rows hot, so that the chunked path runs."""
    spark.conf.set(ROWS_PER_CHUNK_CONF, "20")
    yield
    spark.conf.unset(ROWS_PER_CHUNK_CONF)


def rows(df):
    """Order-free content with columns in name order."""
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def slices(df, position, folder, parts):
    """A table as folders of neighbouring positions, for streams that are started again on each."""
    low, high = df.selectExpr(f"min({position})", f"max({position})").first()
    number = f"(({position} - {low}) * {parts}) div {high - low + 1}"
    df.selectExpr("*", f"{number} AS slice").write.partitionBy("slice").parquet(folder)
    names = sorted(int(n.partition("=")[2]) for n in os.listdir(folder) if n.startswith("slice="))
    return [f"{folder}/slice={n}" for n in names]
