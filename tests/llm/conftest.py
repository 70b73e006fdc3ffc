import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tests_llm_prose import prose  # noqa: E402

@pytest.fixture(scope="session")
def docs(spark):
    """Ordinary, repeated, near, empty, null and long documents; a null id, a repeated row, clashing extra columns."""
    base = [prose(i, 40 + 17 * (i % 5)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[3]), (101, base[3].replace("alpha", "omega", 1)), (102, ""), (103, None), (104, " \t\n "), (105, prose(77, 6000)), (106, base[4] + "\n" + "a shared line of text"), (107, "a shared line of text\n" + base[5])]
    rows += [(None, base[6]), (7, base[7])]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("block", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("fp", T.IntegerType())])
    return spark.createDataFrame([(i, t, None, "b", 5, 6) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
