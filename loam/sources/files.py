"""Sources and sinks: typed CSV with a byte-order mark, JSON lines, binary files, HTML pages, folder trees, partitioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file_id string, path string, name string, size_bytes long, md5 string, mime_type string, modified_time string, collection string, category string, year string, author string, title string, openalex_id string, skip boolean"
QUALITY = "file_id string, path string, local_path string, collection string, category string, size_bytes long, pages int, sampled_pages int, chars_per_page int, devanagari_ratio double, status string, error string"
PAGE = "struct<page:int,text:string,chars:int,lang:string,needs_ocr:boolean,emptied_by_cleaning:boolean,legacy_font:boolean>"
DOCUMENT = f"doc_id string, path string, collection string, category string, year string, year_raw string, author string, title string, openalex_id string, quality_status string, page_count int, references_start_page int, reference_sections int, pages array<{PAGE}>"
CHUNK = "chunk_id string, doc_id string, chunk_index int, collection string, category string, title string, year string, author string, openalex_id string, path string, section string, page_start int, page_end int, lang string, tokens int, embed_tokens int, text string, embed_text string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, quoted line ends and perhaps a byte-order mark; columns are matched by place."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Extracted documents, one JSON object a file."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def pages_of(documents: DataFrame) -> DataFrame:
    """A row for each page of each document."""
    return documents.select("doc_id", "collection", "category", F.explode("pages").alias("p")).select("doc_id", "collection", "category", "p.*")


def read_chunks(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Chunk records; a category reads its folder alone if the table is partitioned by it."""
    rows = spark.read.schema(CHUNK).json(path)
    return rows.where(F.col("category") == category) if category else rows


def read_embed_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Token counts of chunk records alone; nothing else is parsed."""
    return spark.read.schema("embed_tokens int").json(path).select(F.coalesce("embed_tokens", F.lit(0)).alias("embed_tokens"))


#: Gives the pages of a PDF's bytes, each a list of (y0, y1, text, type) blocks, where type 0 is text.
Extractor = Callable[[bytes], list[list[tuple[float, float, str, int]]]]


def page_blocks(files: DataFrame, extract: Extractor) -> DataFrame:
    """path, page (from 1), seq (over the file), y0, y1, text of each text block that isn't blank. files: path, content.

    No PDF library is part of this package; extract is called in the tasks. A file that it fails on gives a row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, seq = [], 0
                try:
                    for number, page in enumerate(extract(content.as_py()), 1):
                        for y0, y1, text, kind in page:
                            if kind == 0 and text.strip():
                                rows.append((path, number, seq, y0, y1, text, None))
                                seq += 1
                except Exception as e:  # the extractor's own errors, of any kind
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                columns = zip(*rows, strict=True) if rows else ((),) * 7
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "page", "seq", "y0", "y1", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, seq int, y0 double, y1 double, text string, error string")


def page_texts(blocks: DataFrame) -> DataFrame:
    """path, page, text: the pages' blocks joined by line ends, blank pages left out."""
    held = blocks.where("error is null").groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("b"))
    return held.select("path", "page", F.array_join(F.col("b.text"), "\n").alias("text")).where(F.trim("text") != "")


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below path: path, size, sha256 of the content, category (the folder it lies in)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("category"))


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles, comments and tags go, the usual entities are read."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def listing(items: DataFrame, folder: str) -> DataFrame:
    """What lies directly in a folder, folders and shortcuts included. items: id, parent, name, is_folder, target."""
    return items.where(F.col("parent") == folder).select("id", "name", "is_folder", "target", F.concat(F.lit("/"), "name").alias("path"))


def tree_paths(items: DataFrame, root: str, most_levels: int = 50, file_shortcuts: bool = True) -> DataFrame:
    """id, name, path of all files below root. items: id, parent, name, is_folder, target (of a shortcut, else null).

    A level at a time, by a join on the parent; folder shortcuts are followed, file shortcuts give their target's id, or
    are left out.
    """
    spark = items.sparkSession
    items = items if file_shortcuts else items.where("is_folder or target is null")
    front = spark.createDataFrame([(root, "")], "folder string, base string")
    files = None
    for _ in range(most_levels):
        level = items.join(front, F.col("parent") == F.col("folder")).select(F.coalesce("target", "id").alias("id"), "name", "is_folder", F.concat("base", F.lit("/"), "name").alias("path"))
        level = level.persist()
        found = level.where("not is_folder").select("id", "name", "path")
        files = found if files is None else files.unionByName(found)
        front = level.where("is_folder").select(F.col("id").alias("folder"), F.col("path").alias("base"))
        if front.isEmpty():
            return files
    raise ValueError(f"more than {most_levels} levels: the tree may run in a circle")


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet by `by`; only partitions that rows has are replaced. Blank partition values become other."""
    filled = rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("other")) for c in by})
    filled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def guarded_settings(spark: SparkSession, path: str, settings: dict[str, str]) -> None:
    """Write settings to path, or raise if other ones stand there: vectors of different models don't mix."""
    try:
        old = {r.key: r.value for r in spark.read.schema("key string, value string").parquet(path).collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame(sorted(settings.items()), "key string, value string").coalesce(1).write.parquet(path)
        return
    if other := {k: (old.get(k), v) for k, v in settings.items() if old.get(k) != v}:
        raise ValueError(f"settings differ from those in {path}: {other}")
