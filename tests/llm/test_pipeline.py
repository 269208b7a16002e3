import zlib

import corpus_pipeline
from loam.llm import decontamination, jaccard, queries, toxicity


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES][:2] == ["toxicity", "n-gram jaccard join"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    toxic = {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert ids(kept) == ids(docs) - toxic
    config = jaccard.JaccardConfig(size=5, percent=80)
    copies = {r.doc_id for r in jaccard.join(docs, config).collect() if r.doc_id != r.component_id}
    assert ids(corpus_pipeline.STAGES[1][1](spark, docs, sf_dir)) == ids(docs) - copies
    hit = {r.doc_id for r in decontamination.decontaminate(docs, bench).where("contaminated").collect()}
    assert ids(corpus_pipeline.STAGES[2][1](spark, docs, sf_dir)) == ids(docs) - hit
    masked = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)
    assert masked.columns == docs.columns
    assert masked.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf_dir).schema.names == docs.columns


def test_run_and_names(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows
    assert all(0 < r.taken <= 2 * r.size for r in rows)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert zlib.crc32(b"1") % 5 >= 0
