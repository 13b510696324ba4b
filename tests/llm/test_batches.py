"""Texts come to Python in batches bounded by bytes, not by rows alone."""

import pyarrow as pa
import pytest

from millrace.llm import common


@pytest.fixture
def default_bound(spark):
    before = spark.conf.get(common._BOUND)
    spark.conf.unset(common._BOUND)
    yield
    spark.conf.set(common._BOUND, before)


def sizes(spark):
    docs = spark.range(0, 6000, 1, 1).selectExpr("repeat(uuid(), 100) AS text")  # 3,600 bytes a row, 21.6 MB in all
    seen = common.map_arrow(docs, lambda b: pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["n", "rows"]), "n long, rows long").collect()
    assert sum(r.rows for r in seen) == 6000
    return [r.n for r in seen]


def test_batches_are_bounded_by_bytes(spark, default_bound):
    assert max(sizes(spark)) < common.BATCH * 1.2


def test_a_bound_of_the_user_stays(spark, default_bound):
    spark.conf.set(common._BOUND, "100m")
    assert len(sizes(spark)) == 1 and spark.conf.get(common._BOUND) == "100m"
