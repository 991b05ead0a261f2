import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tandem import session

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    built = session.build("tandem-llm-tests", master="local[8]", shuffle_partitions=4)
    built.sparkContext.setLogLevel("ERROR")
    session.shared_dir(built)
    return built


#: Texts of every awkward kind: null, empty, white space, short, repeated, very long, a clashing extra column.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"),
    (8, "A b c D e f g h i j"), (9, "a b c d e f g h i x"), (None, "a b c d e f g h i j"), (10, "é" * 200 + " tail"), (11, "w " * 60_000),
    (12, "".join(chr(97 + i % 26) for i in range(300))), (13, "zz" + "".join(chr(97 + i % 26) for i in range(300))), (14, "x" * 150),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "n", 1, "k", 0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, doc string, tie int, key string, n bigint")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
