"""The pipeline's stages take effect one after the other."""

import corpus_pipeline
from roomledger.llm.queries import QUERIES, read
from roomledger.llm.staging import apart, staged

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))


def test_stages_on_the_smallest_table(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        if name == "quality_rules":
            assert 0 < docs.count() < before
            assert docs.where("size(split(trim(text), '[ \\\\t-\\\\r]+')) < 50").count() == 0
        if name in ("near_duplicates", "repeated_passages"):
            assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count()


def test_helper_names_never_clash():
    assert apart(["a", "_A", "b"], "a", "c", "c") == ["__a", "c", "_c"]
