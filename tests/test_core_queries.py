"""Each query of the engine proper against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from siftwright.plans import curation, evaluation, leaks, matching, prompts, questions, runs  # noqa: F401  they register their queries
from siftwright.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(con.sql(ORACLES[name]).df())


def test_letters_only_folds_unicode(spark):
    from pyspark.sql import functions as F

    from siftwright.functions.text import letters_only

    rows = spark.createDataFrame([("Ab c-1!",), ("È ½ ﬁ",), ("",), (None,)], "text string")
    assert [r[0] for r in rows.select(letters_only(F.col("text"))).collect()] == ["abc1", "e12fi", "", None]
