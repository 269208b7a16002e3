"""The bounded sample of op3_toxicity: the cap changes what is learnt from, not what the threshold means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import toxicity


@pytest.mark.parametrize("per_class", [6000, 600, 100])
def test_threshold_means_the_same_at_every_cap(spark, per_class):
    """A tenth of the labels is toxic whatever the words are, so each score is about a tenth; the caps bind on none, one and both classes."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, 8))) for i in range(4000)] + [(9000, ""), (9001, "unknown words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.pmod(F.hash("id"), F.lit(10)) == 0).cast("int").alias("toxic"))
    config = toxicity.ToxicityConfig(per_class=per_class)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, config).collect()}
    assert 0.02 < got[9000].score == got[9001].score < 0.3
    assert np.mean([r.score for r in got.values()]) == pytest.approx(0.1, abs=0.05)
    assert toxicity.keep_clean(docs, labels, config).count() > 0.95 * len(rows)
