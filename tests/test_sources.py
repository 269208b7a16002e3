import pytest

from loam.sources import files, sinks
from loam.streaming import ingest


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿file_id,path,name,size_bytes,md5,mime_type,modified_time,collection,category,year,author,title,openalex_id,skip\n1,/a,\"n,\n2\",5,,t,,c,d,2019,x,y,W1,True\n", encoding="utf-8")
    row = files.read_csv(spark, str(tmp_path / "m.csv"), files.MANIFEST).first()
    assert (row.file_id, row.name, row.size_bytes, row.skip) == ("1", "n,\n2", 5, True)


ITEMS = [("r1", "root", "papers", True, None), ("f1", "r1", "x.pdf", False, None), ("s1", "r1", "link", True, "r2"), ("f2", "r2", "y.pdf", False, "t9"), ("f3", "root", "z.pdf", False, None)]


def test_tree(spark):
    items = spark.createDataFrame(ITEMS, "id string, parent string, name string, is_folder boolean, target string")
    paths = lambda **more: sorted((r.id, r.path) for r in files.tree_paths(items, "root", **more).collect())
    assert paths() == [("f1", "/papers/x.pdf"), ("f3", "/z.pdf"), ("t9", "/papers/link/y.pdf")]
    assert paths(file_shortcuts=False) == [("f1", "/papers/x.pdf"), ("f3", "/z.pdf")]
    assert sorted(r.path for r in files.listing(items, "root").collect()) == ["/papers", "/z.pdf"]
    circle = spark.createDataFrame([*ITEMS, ("r3", "r1", "up", True, "r1")], items.schema)
    with pytest.raises(ValueError, match="circle"):
        files.tree_paths(circle, "root", most_levels=4)


def test_documents_and_chunks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"doc_id": "1", "collection": "c", "category": "k", "pages": [\n{"page": 1, "text": "é", "needs_ocr": false}, {"page": 2}]}', encoding="utf-8")
    assert [(r.doc_id, r.page, r.text) for r in files.pages_of(files.read_documents(spark, str(tmp_path / "d"))).collect()] == [("1", 1, "é"), ("1", 2, None)]
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "1:0000", "category": "a", "embed_tokens": 7}\n{"chunk_id": "1:0001", "category": "b"}\n')
    assert [r.chunk_id for r in files.read_chunks(spark, str(tmp_path / "c.jsonl"), "a").collect()] == ["1:0000"]
    assert sorted(r.embed_tokens for r in files.read_embed_tokens(spark, str(tmp_path / "c.jsonl")).collect()) == [0, 7]


def test_binary_pages(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.pdf").write_bytes(b"one|two||three")
    (tmp_path / "k" / "b.pdf").write_bytes(b"bad")
    (tmp_path / "k" / "c.txt").write_bytes(b"no")
    found = {r.path.rsplit("/", 1)[1]: (r.size, r.category) for r in files.read_binary(spark, str(tmp_path)).collect()}
    assert found == {"a.pdf": (14, "k"), "b.pdf": (3, "k")}

    def extract(content):
        if content == b"bad":
            raise ValueError("not a PDF")
        return [[(0.0, 1.0, x, 0), (1.0, 2.0, "image", 1)] for x in content.decode().split("|")]

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(str(tmp_path))
    blocks = files.page_blocks(content, extract)
    assert sorted((r.page, r.seq, r.text) for r in blocks.where("error is null").collect()) == [(1, 0, "one"), (2, 1, "two"), (4, 2, "three")]
    assert [r.error for r in blocks.where("error is not null").collect()] == ["ValueError: not a PDF"]
    assert sorted((r.page, r.text) for r in files.page_texts(blocks).collect()) == [(1, "one"), (2, "two"), (4, "three")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(5), path)
    sinks.replace(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    assert sinks.shard_is_done(spark, path)
    assert not sinks.shard_is_done(spark, f"{path}-none")
    assert [f.name for f in tmp_path.iterdir() if "tmp" in f.name] == []
    rows = spark.range(100).selectExpr("id", "CASE WHEN id < 90 THEN 'a' ELSE 'b' END AS category")
    sinks.write_shards(rows, f"{path}s", "id", size=20)
    sinks.write_shards(rows.where("id < 20"), f"{path}s", "id", size=20)
    kept = spark.read.parquet(f"{path}s")
    assert sorted(r.id for r in kept.collect() if r.category == "b") == list(range(90, 100))
    sinks.remove_stale(spark, f"{path}s", rows.where("id >= 90"))
    assert {r.category for r in spark.read.parquet(f"{path}s").collect()} == {"b"}
    log = spark.createDataFrame([("x", "ok"), ("y", "failed")], "path string, status string")
    sinks.log_downloads(log, f"{path}l")
    sinks.log_downloads(log.where("status = 'ok'"), f"{path}l")
    assert spark.read.parquet(f"{path}l/log").count() == 3
    assert spark.read.parquet(f"{path}l/failures").count() == 0
    sinks.write_documents(spark.createDataFrame([("1", "p")], "doc_id string, collection string"), f"{path}d")
    sinks.write_documents(spark.createDataFrame([("2", "r")], "doc_id string, collection string"), f"{path}d")
    assert spark.read.json(f"{path}d").count() == 2
    totals, each = spark.createDataFrame([(3, 7)], "PDFs int, chunks int"), spark.createDataFrame([("b", 1), ("a", 2)], "category string, documents int")
    assert [r.line for r in sinks.summary_lines(totals, each).collect()] == ["Total PDFs: 3", "Total chunks: 7", "  a: 2", "  b: 1"]


def test_partitions_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "n int, c string"), path, "c")
    files.write_partitioned(spark.createDataFrame([(4, "a")], "n int, c string"), path, "c")
    assert sorted((r.n, r.c) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "other"), (4, "a")]


def test_settings_guard(spark, tmp_path):
    path = str(tmp_path / "info")
    files.guarded_settings(spark, path, {"model": "m", "dim": "4"})
    files.guarded_settings(spark, path, {"model": "m", "dim": "4"})
    with pytest.raises(ValueError, match="dim"):
        files.guarded_settings(spark, path, {"model": "m", "dim": "5"})


def test_stream_upserts(spark, tmp_path):
    schema, source = "doc_id long, text string", tmp_path / "in"
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        ingest.upsert_batches(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        assert n < 2
    assert sorted((r.doc_id, r.text) for r in ingest.read_latest(spark, str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_batches_are_deduplicated(spark, tmp_path):
    schema, source = "doc_id long, text string", tmp_path / "in"
    rows = [(1, "same  Text"), (2, "same text"), (3, "x"), (3, "y"), (3, "x"), (None, "z"), (4, ""), (5, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    ingest.upsert_batches(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = ingest.read_latest(spark, str(tmp_path / "t")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4, 5]
    assert {r.text for r in got if r.doc_id == 3} <= {"x", "y"}
