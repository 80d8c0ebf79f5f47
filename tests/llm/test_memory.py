"""How much text the linear scorer holds features of at once."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StringType, StructType

from candlewick.llm import linear, toxicity


def test_features_of_little_text_at_once():
    """A batch of 2 MB is scored in short slices, with the scores of the whole batch."""
    texts = pa.array([f"word{k % 977} and other{k % 89} words " * 60 for k in range(1200)])
    weights = np.random.default_rng(0).normal(size=linear.SPACE).astype(np.float32)
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    docs = SimpleNamespace(columns=["text"], schema=StructType().add("text", StringType()), sparkSession=session, mapInArrow=lambda work, schema: work)
    work = linear.scored(docs, weights, toxicity.SETTINGS)
    out = list(work(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert max(sum(map(len, b.column(0).to_pylist())) for b in out) <= 1 << 18
    got = np.concatenate([np.asarray(b.column(1)) for b in out])
    assert np.allclose(got, linear.scores(texts, weights, toxicity.SETTINGS), atol=1e-12)
