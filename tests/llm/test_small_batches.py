"""What the pipeline's tasks hold and write: batches of texts, and files of small tables."""

import corpus_pipeline
from candlewick.llm import components as cc
from candlewick.llm import shared
from candlewick.llm.shared import in_small_batches, table

BATCH, PARTITIONS, MERGED = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


def test_texts_go_in_small_batches(spark, sf):
    before = spark.conf.get(BATCH)
    try:
        for given, used in (("10000", 512), ("0", 512), ("100", 100)):
            spark.conf.set(BATCH, given)
            in_small_batches(spark)
            assert int(spark.conf.get(BATCH)) == used
        spark.conf.set(BATCH, "10000")
        docs = corpus_pipeline.STAGES[3][1](spark, table(spark, sf, "documents"), sf)
        assert docs.count() and int(spark.conf.get(BATCH)) <= 512
    finally:
        spark.conf.set(BATCH, before)


def test_edges_come_in_few_files(spark):
    """100 shuffle partitions that nothing merges: the edges of a round were 100 files, and the components are the same."""
    before, merged = spark.conf.get(PARTITIONS), spark.conf.get(MERGED)
    spark.conf.set(PARTITIONS, "100")
    spark.conf.set(MERGED, "false")
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(2000) if k % 5], "a long, b long")
        found = cc.components(edges)
        assert len(found.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
        rows = {tuple(x) for x in found.collect()}
    finally:
        spark.conf.set(PARTITIONS, before)
        spark.conf.set(MERGED, merged)
    assert rows == {(k, (k - 1) // 5 * 5 + 1) for k in range(1, 2001)}


def test_components_end_with_stars(spark, monkeypatch):
    """Stars are written once and no round is run to see that nothing changes; a chain, a ring and two stars that meet are right."""
    written = []
    monkeypatch.setattr(cc, "stored", lambda df, label: written.append(label) or shared.stored(df, label))
    stars = [(k, k % 3) for k in range(3, 30)]
    found = cc.components(spark.createDataFrame(stars, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {k: k % 3 for k in range(30)} and written == ["edges"]
    chain, ring = [(k, k + 1) for k in range(100, 140)], [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    meeting = [(301, 300), (302, 300), (304, 303), (302, 303), (None, 300), (305, 305)]
    found = cc.components(spark.createDataFrame(chain + ring + meeting, "a long, b long"))
    want = {k: 100 for k in range(100, 141)} | {k: 200 for k in range(200, 209)} | {k: 300 for k in range(300, 305)}
    assert {r.node: r.root for r in found.collect()} == want
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
