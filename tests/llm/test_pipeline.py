"""Stages of the pipeline, each on what the one before kept."""

import corpus_pipeline
from candlewick.llm.shared import stored, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert docs.select("doc_id").distinct().count() == sizes[-1]
