"""The pipeline against its stages done by hand."""

import re

import corpus_pipeline
from portledger.llm import queries


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    found = plain
    sizes = [plain.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, found, "").write.parquet(str(tmp_path / str(i)))
        found = spark.read.parquet(str(tmp_path / str(i)))
        assert found.columns == plain.columns
        sizes.append(found.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    texts = [re.sub("[\x20\x09-\x0D]", "", r.text) for r in found.collect()]
    assert len(texts) == len(set(texts))
    pieces = corpus_pipeline.STAGES[-1][1](spark, found, "").toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in found.collect()}


def test_run_is_repeatable(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.run(spark, str(tmp_path)).drop("ids", "sequence_id", "offset").toPandas()
    again = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(first.doc_id) == set(again.doc_id) and first.length.sum() == again.length.sum()


def test_each_operator_has_its_query():
    numbers = [re.match(r"op(\d+)_", name)[1] for name in queries.QUERIES]
    assert sorted(map(int, numbers)) == list(range(1, 14))
