"""Queries of summaries, selections, text forms, vectors and retrieval over the tables, with their SQL.

`documents` stands for files and chunks: its source is the category, its id and length give types, states and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import answers, catalogue, encoding, noise, retrieval, structure, summaries
from loam.plans.registry import query, table

_MIME = "CASE doc_id % 5 WHEN 0 THEN 'application/vnd.google-apps.document' WHEN 1 THEN 'text/plain' ELSE 'application/pdf' END"
_FILES = f"""files AS (SELECT doc_id, '/' || CASE WHEN doc_id % 2 = 0 THEN 'papers' ELSE 'reports' END || '/' || source || '/' || doc_id || '.pdf' AS path, CASE WHEN doc_id % 2 = 0 THEN 'papers' ELSE 'reports' END AS collection, source AS category,
{_MIME} AS mime_type, n_chars * 20 AS size_bytes, md5(text) AS md5, doc_id % 7 = 0 AS skip, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'W' || doc_id END AS openalex_id,
CASE WHEN n_chars % 7 = 0 THEN 'broken' WHEN n_chars < 200 THEN 'needs_ocr' WHEN n_chars < 800 THEN 'low_text' ELSE 'ok' END AS status, n_chars FROM documents)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, "application/vnd.google-apps.document").when(F.col("doc_id") % 5 == 1, "text/plain").otherwise("application/pdf")
    collection = F.when(F.col("doc_id") % 2 == 0, "papers").otherwise("reports")
    status = F.when(F.col("n_chars") % 7 == 0, "broken").when(F.col("n_chars") < 200, "needs_ocr").when(F.col("n_chars") < 800, "low_text").otherwise("ok")
    return docs.select(
        "doc_id", F.concat(F.lit("/"), collection, F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("path"), collection.alias("collection"), F.col("source").alias("category"), kind.alias("mime_type"),
        (F.col("n_chars") * 20).alias("size_bytes"), F.md5("text").alias("md5"), (F.col("doc_id") % 7 == 0).alias("skip"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("W"), "doc_id")).alias("openalex_id"), status.alias("status"), "n_chars",
    )


@query(f"""WITH {_FILES} SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (mime_type = 'application/pdf') AS pdfs, count(*) FILTER (mime_type LIKE 'application/vnd.google-apps%') AS google_native,
count(*) FILTER (mime_type = 'text/plain') AS other FROM files""")
def type_totals(spark, sf_dir):
    return summaries.type_totals(_files(spark, sf_dir))


@query(f"""WITH {_FILES}, same AS (SELECT count(*) AS n FROM files WHERE NOT skip GROUP BY md5 HAVING count(*) > 1)
SELECT count(*) FILTER (NOT skip) AS kept, count(*) FILTER (skip) AS skipped, CAST(sum(size_bytes) FILTER (NOT skip) AS BIGINT) AS bytes, count(*) FILTER (NOT skip AND collection = 'papers') AS papers,
count(*) FILTER (NOT skip AND collection = 'papers' AND openalex_id <> '') AS parsed, count(*) FILTER (NOT skip AND mime_type <> 'application/pdf') AS not_pdf, count(*) FILTER (NOT skip AND size_bytes > 0 AND size_bytes < 20000) AS tiny,
(SELECT count(*) FROM same) AS repeated, CAST((SELECT coalesce(sum(n - 1), 0) FROM same) AS BIGINT) AS extra_copies,
round(100.0 * count(*) FILTER (NOT skip AND collection = 'papers' AND openalex_id <> '') / count(*) FILTER (NOT skip AND collection = 'papers'), 1) AS parsed_percent FROM files""")
def manifest_summary(spark, sf_dir):
    return summaries.manifest_summary(_files(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place, source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def most_common(spark, sf_dir):
    return summaries.most_common(table(spark, sf_dir, "documents"), "source", "lang", first="doc_id")


@query("SELECT count(*) AS documents, count(*) FILTER (n_chars % 10 >= 3) AS nepali FROM documents")
def nepali_count(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.round(F.col("n_chars") % 10 / 10, 3).alias("devanagari_ratio"))
    return summaries.mostly_nepali(rows)


_COUNTED = {"text_pages": 7, "empty_pages": 3, "emptied_pages": 4, "nepali_pages": 5, "other_lang_pages": 2, "reference_sections": 3, "reference_blocks_removed": 11}


@query(
    "SELECT count(*) FILTER (doc_id % 9 > 0) AS ok, count(*) FILTER (doc_id % 9 = 0) AS failed, " + ", ".join(f"CAST(sum(n_chars % {m}) FILTER (doc_id % 9 > 0) AS BIGINT) AS {c}" for c, m in _COUNTED.items())
    + """, CAST(sum(n_chars) FILTER (doc_id % 9 > 0) AS BIGINT) AS chars, count(*) FILTER (doc_id % 9 > 0 AND n_chars % 6 > 0) AS legacy_font_docs,
count(*) FILTER (doc_id % 9 > 0 AND n_chars % 4 > 0) AS docs_without_references, count(*) FILTER (doc_id % 9 > 0 AND n_chars % 3 > 1) AS docs_with_several_lists FROM documents"""
)
def extraction_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = [(F.col("n_chars") % m).alias(c) for c, m in _COUNTED.items()]
    start = F.when(F.col("n_chars") % 4 > 0, F.col("n_chars") % 4).alias("references_start_page")
    status = F.when(F.col("doc_id") % 9 == 0, "failed").otherwise("ok").alias("status")
    return summaries.extraction_totals(docs.select(status, *counted, F.col("n_chars").alias("chars"), (F.col("n_chars") % 6).alias("legacy_font_pages"), start))


@query("""SELECT CASE WHEN label IS NULL THEN 'missing_vector' ELSE 'kept' END AS reason, count(*) AS chunks FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""")
def index_totals(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    found = encoding.with_vectors(chunks, _vectors(spark, sf_dir).withColumnRenamed("id", "chunk_id"))
    return summaries.reason_totals(found.select(F.when(F.col("missing"), "missing_vector").alias("reason")))


@query("SELECT count(*) AS chunks, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, count(*) FILTER (greatest(1, length(text) // 4) > 1024) AS too_long FROM documents")
def work_totals(spark, sf_dir):
    return summaries.work_totals(table(spark, sf_dir, "documents").select(T.token_estimate(F.col("text")).alias("embed_tokens")))


@query(f"WITH {_FILES} SELECT category, count(*) FILTER (status = 'ok') AS documents, count(*) AS seen FROM files GROUP BY category")
def category_documents(spark, sf_dir):
    return summaries.per_category(_files(spark, sf_dir), F.col("status") == "ok")


@query(f"WITH {_FILES} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed, CAST(coalesce(sum(size_bytes) FILTER (status = 'ok'), 0) AS BIGINT) AS bytes FROM files")
def download_progress(spark, sf_dir):
    return summaries.download_progress(_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path, size_bytes FROM files WHERE mime_type = 'application/pdf' AND size_bytes > 0 ORDER BY size_bytes, path LIMIT 1")
def smallest_pdf(spark, sf_dir):
    return summaries.smallest_pdf(_files(spark, sf_dir))


@query(f"""WITH {_FILES} SELECT path, status FROM files WHERE status IN ('ok', 'low_text') AND category = (SELECT min(source) FROM documents) AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY path LIMIT 20""")
def selected_documents(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("file_id", F.col("doc_id"))
    least = files.agg(F.min("category")).first()[0]
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"))
    return summaries.selected(files, ["ok", "low_text"], least, 20, done).select("path", "status")


@query("""SELECT doc_id, array_to_string(CASE WHEN n_chars % 40 <= 10 THEN range(n_chars % 40) ELSE list_sort(list_distinct(list_transform(range(10), lambda k: CAST(round_even(k * (n_chars % 40 - 1) / 9.0, 0) AS BIGINT)))) END, ',') AS pages FROM documents""")
def page_samples(spark, sf_dir):
    sample = catalogue.page_samples(F.col("n_chars") % 40, 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sample.cast("array<string>"), ",").alias("pages"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'needs_ocr' WHEN doc_id % 7 = 0 OR n_chars % 3 = 0 THEN 'empty' WHEN lang = 'de' THEN 'other_language' WHEN doc_id % 2 = 0 THEN 'legacy_font' END AS reason FROM documents""")
def page_skip_reasons(spark, sf_dir):
    text = F.when(F.col("n_chars") % 3 == 0, "").otherwise("text")
    reason = structure.page_skip_reason(F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0, text, F.when(F.col("lang") == "de", "other").otherwise("en"), F.col("doc_id") % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


_LAST = "regexp_extract(url, '([^/]*)$', 1)"


@query(f"""SELECT page_id, regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1F]', '_', 'g') AS safe, array_to_string(list_transform(list_filter(string_split(url, '/'), lambda p: p <> ''),
lambda p: CASE WHEN rtrim(regexp_replace(p, '[<>:"/\\\\|?*\\x00-\\x1F]', '_', 'g'), ' .') = '' THEN '_' ELSE rtrim(regexp_replace(p, '[<>:"/\\\\|?*\\x00-\\x1F]', '_', 'g'), ' .') END), '/') AS path,
trim(replace(regexp_replace(regexp_replace({_LAST}, '([^.])\\.[^.]*$', '\\1'), '^\\d+_', ''), '_', ' ')) AS name, trim(regexp_replace(url, '[^a-zA-Z0-9_]+', ' ', 'g')) AS terms FROM pages""")
def file_names(spark, sf_dir):
    last = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"), T.local_path(F.col("url")).alias("path"), T.readable(last).alias("name"), T.search_terms(F.col("url")).alias("terms"))


@query("""WITH y AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' 1970' WHEN 1 THEN '0' WHEN 2 THEN CAST(1990 + doc_id % 30 AS VARCHAR) || ' ' ELSE 'n.d.' END AS year FROM documents)
SELECT doc_id, CASE WHEN trim(year) IN ('0', '1970') THEN '' ELSE trim(year) END AS year, CASE WHEN regexp_matches(trim(year), '^[0-9]+$') AND trim(year) NOT IN ('0', '1970') THEN CAST(trim(year) AS INTEGER) ELSE 0 END AS year_int, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id FROM y""")
def index_years(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 4 == 0, " 1970").when(F.col("doc_id") % 4 == 1, "0").when(F.col("doc_id") % 4 == 2, F.concat((1990 + F.col("doc_id") % 30).cast("string"), F.lit(" "))).otherwise("n.d.")
    year = T.clean_year(raw)
    return table(spark, sf_dir, "documents").select("doc_id", year.alias("year"), T.year_number(year).alias("year_int"), F.format_string("%08d", "doc_id").alias("id"))


@query("""WITH p AS (SELECT doc_id, n_chars % 50 AS a, n_chars % 50 + doc_id % 3 AS b FROM documents)
SELECT doc_id, CASE WHEN a = b THEN 'p' || a ELSE 'p' || a || '-' || b END AS label, CASE WHEN a = b THEN 'p. ' || a ELSE 'pp. ' || a || '–' || b END AS apa FROM p""")
def page_labels(spark, sf_dir):
    a, b = F.col("n_chars") % 50, F.col("n_chars") % 50 + F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", answers.pages_label(a, b).alias("label"), answers.apa_pages(a, b).alias("apa"))


@query("SELECT item_id, 'query: ' || text AS asked, 'passage: ' || text AS passage FROM benchmark")
def encoder_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", encoding.asked(F.col("text")).alias("asked"), encoding.passage(F.col("text")).alias("passage"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query("SELECT doc_id AS chunk_id, vec_id IS NULL AS missing, label FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def chunk_vectors(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    rows = encoding.with_vectors(chunks, _vectors(spark, sf_dir).withColumnRenamed("id", "chunk_id"))
    return rows.join(_vectors(spark, sf_dir).select(F.col("id").alias("chunk_id"), "label"), "chunk_id", "left").select("chunk_id", "missing", "label")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS place, turn, text FROM conversations")
def zipped_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return encoding.zipped(rows.select("conv_id", F.col("x.turn").alias("turn"), F.col("x.text").alias("text")), "turn", "text")


@query("SELECT DISTINCT CAST(doc_id % 50 AS BIGINT) AS folder FROM documents EXCEPT SELECT CAST(vec_id % 37 AS BIGINT) FROM embeddings")
def orphan_folders(spark, sf_dir):
    embedded = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("folder"))
    return encoding.orphans(embedded, table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 37).alias("folder")), "folder")


@query("""WITH c AS (SELECT doc_id, source, substr(sha1(text), 1, 20) AS h FROM documents) SELECT doc_id AS chunk_id, h AS text_hash, coalesce(bool_or(doc_id % 2 = 0) OVER (PARTITION BY source, h), false) AS reused, true AS same FROM c""")
def incremental_vectors(spark, sf_dir):
    """Vectors of even ids are there; the others are reused by text or made; each equals the vector that encoding all anew gives."""
    load = encoding.hashing_encoder(16)
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("embed_text"))
    every = encoding.encoded(chunks, "embed_text", load)
    cache = every.where("chunk_id % 2 = 0").select("source", T.text_hash(F.col("embed_text")).alias("text_hash"), "chunk_id", "vector")
    found = encoding.incremental(chunks, cache, load, "source").join(every.select("chunk_id", F.col("vector").alias("again")), "chunk_id")
    return found.select("chunk_id", "text_hash", "reused", (F.col("vector") == F.col("again")).alias("same"))


def _joined(blocks: Column) -> Column:
    return F.md5(F.concat_ws("|", blocks["role"], blocks["content"]))


_RULE = answers.LAST_RULE.replace("'", "''")


@query(f"""WITH b AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS blocks FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('system|user|' || '{answers.SYSTEM_PROMPT.replace("'", "''")}' || '|' || 'Sources:' || chr(10) || chr(10) || blocks || chr(10) || chr(10) || 'Question: Why?' || chr(10) || chr(10) || '{_RULE}') AS messages FROM b""")
def chat_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return rows.select("conv_id", _joined(answers.messages(F.lit("Why?"), F.col("x.text"))).alias("messages"))


@query("""WITH c AS (SELECT conv_id, string_agg('[' || conv_id || ' p.' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) FILTER (role = 'user') AS context,
string_agg('- ' || text, chr(10) ORDER BY turn, text) FILTER (role = 'user') AS refs FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(context, 'No relevant documents found.') AS context, '# Why?' || chr(10) || chr(10) || 'Because.' || CASE WHEN refs IS NULL THEN '' ELSE chr(10) || chr(10) || '## References' || chr(10) || chr(10) || refs END AS markdown FROM c""")
def contexts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    hit = F.struct("turn", "text", F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").alias("page"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", hit))).alias("x"))
    return rows.select("conv_id", answers.context(F.col("x")).alias("context"), answers.markdown(F.lit("Why?"), F.lit("Because."), F.col("x.text")).alias("markdown"))


@query("SELECT doc_id, source AS reason, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents WHERE source = (SELECT max(source) FROM documents)")
def labelled_category(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("reason"))
    most = docs.agg(F.max("reason")).first()[0]
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    return catalogue.with_right_columns(docs.where(retrieval.contains_tag("reason", most)), known, "doc_id").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


@query("SELECT count(*) FILTER (NOT isfinite(x)) AS not_finite, count(*) AS n_values FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def checked_vectors(spark, sf_dir):
    rows = noise.checked(_vectors(spark, sf_dir), tolerance=10.0)
    bad = F.size(F.filter("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.agg(F.sum(bad).cast("long").alias("not_finite"), F.sum(F.size("vector")).cast("long").alias("n_values"))
