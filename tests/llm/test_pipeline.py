import brute
import pytest

import corpus_pipeline
from millrace.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "mix_sources", "best_fit_packing"]
    docs = common.tables(spark, SF, "documents")
    columns, now = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, common.cut(stage(spark, now, SF), "test")
        seen[name] = (before, now)
        if name != "best_fit_packing":
            assert now.columns == columns
    before, after = seen["quality_rules"]
    bad = {r.doc_id for r in before.collect() if brute.quality_base(r.text)[-1]}
    assert bad and not bad & {r.doc_id for r in after.collect()}
    before, after = seen["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    firsts = {c for _, _, c, _ in brute.jaccard(rows, 5, 80)}
    assert sorted(r.doc_id for r in after.collect()) == sorted(firsts)
    before, after = seen["mix_sources"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    before, after = seen["best_fit_packing"]
    assert after.filter("piece = 0").count() == before.count()


@pytest.mark.parametrize("table", ["edge", "empty"])
def test_edges(spark, request, table):
    docs = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF), "test")
    assert "sequence_id" in docs.columns


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
