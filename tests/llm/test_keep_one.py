"""keep_one decides per row: of each group of near copies one row stays, whatever ids the rows have."""

from collections import Counter

import numpy as np

from loam.llm import jaccard


def text(seed, changed=None):
    words = ["w%d" % x for x in np.random.default_rng(seed).integers(0, 400, 120)]
    if changed is not None:
        words[changed] = "changed"
    return " ".join(words)


def test_repeated_and_null_ids(spark):
    copies = [(1, text(1)), (5, text(1, 60)), (7, text(3)), (7, text(3)), (None, text(4)), (None, text(4, 60)), (None, text(6)), (None, text(6)), (12, text(1))]
    alone = [(5, text(2)), (None, text(5)), (8, ""), (8, ""), (None, None), (9, text(7)), (9, text(8))]
    variants = [(10, "One two"), (10, "one  TWO")]
    nulls_last = [(None, text(9)), (11, text(9))]
    docs = spark.createDataFrame([(*r, "x") for r in copies + alone + variants + nulls_last], "doc_id long, text string, h string").repartition(3)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(rows[x] for x in variants) == 1
    assert sum(rows[x] for x in [(None, text(4)), (None, text(4, 60))]) == 1
    expected = Counter([(1, text(1)), (7, text(3)), (None, text(6)), (11, text(9)), *alone])
    ignored = [*variants, (None, text(4)), (None, text(4, 60))]
    assert Counter({k: n for k, n in rows.items() if k not in ignored}) == expected
