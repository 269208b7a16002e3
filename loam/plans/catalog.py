"""All queries of the engine's own operators, with SQL that gives the same rows.

Operators whose cases the tables don't have (years, citations, headings, scripts) run on small inline tables, which both
sides are given in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions.vocabulary import DISTRICTS, RIVER_BASINS, THEME_KEYWORDS
from loam.operators import answers, catalogue, chunking, noise, retrieval, structure
from loam.operators.index import SearchIndex
from loam.plans import corpus, registry
from loam.plans.registry import _value, query, scratch_folder, table, values
from loam.sources import files

# --- Texts: windows, dedupe, tags, cleaning, estimates --------------------------------------------------------------

_WINDOWS = """SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, substr(text, CAST(i * 1800 + 1 AS BIGINT), 2000) AS chunk
FROM documents, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 2000) / 1800.0) AS BIGINT) + 1 END)) AS u(i)"""


@query(_WINDOWS)
def char_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(structure.char_windows(F.col("text"))).alias("i", "chunk")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), "chunk")


_NORMAL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5({_NORMAL}) ORDER BY doc_id) = 1")
def dedupe_keep_first(spark, sf_dir):
    return catalogue.keep_first(table(spark, sf_dir, "documents"), T.dedupe_key(F.col("text")), "doc_id").select("doc_id", "lang", "source")


@query(f"SELECT count(*) AS dup_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_copies FROM (SELECT count(*) AS n FROM documents GROUP BY md5({_NORMAL}) HAVING count(*) > 1)")
def dup_groups_extra(spark, sf_dir):
    return catalogue.duplicate_summary(table(spark, sf_dir, "documents"), T.dedupe_key(F.col("text")))


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join(map(_value, words)) + "]"


@query(
    "SELECT doc_id, array_to_string(list_filter(" + _list_sql([*RIVER_BASINS, *DISTRICTS]) + ", lambda t: contains(lower(text), t)), ',') AS places, concat_ws(',', "
    + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {_value(k)})' for k in ks)} THEN {_value(n)} END" for n, ks in THEME_KEYWORDS.items())
    + ") AS themes FROM documents"
)
def vocab_tags(spark, sf_dir):
    low = F.lower("text")
    places = F.array_join(T.present(low, [*RIVER_BASINS, *DISTRICTS]), ",")
    return table(spark, sf_dir, "documents").select("doc_id", places.alias("places"), F.array_join(T.themes(low, THEME_KEYWORDS), ",").alias("themes"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '\\s*\\n\\s*', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS cleaned FROM documents""")
def hyphen_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.join_lines(F.col("text")).alias("cleaned"))


# SQL has the canonical form only; the tables have no characters that the compatibility form changes, which a test adds.
@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '\\s*\\n\\s*', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS cleaned FROM documents""")
def nfkc_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_block(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?।])\\s+([''"(\\[]?[A-Z0-9\\x{0900}-\\x{097F}])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS BIGINT) AS sentences FROM documents""")
def sentence_split_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunking.raw_sentences(F.col("text"))).cast("long").alias("sentences"))


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
keyed AS (SELECT doc_id, page, substr(trim(regexp_replace(lower(line), '[0-9]+', '#', 'g')), 1, 80) AS edge FROM lines),
pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM keyed GROUP BY doc_id),
n AS (SELECT doc_id, edge, count(*) AS n FROM (SELECT DISTINCT doc_id, page, edge FROM keyed) GROUP BY ALL)
SELECT doc_id AS doc, edge, n FROM n JOIN pages USING (doc_id) WHERE edge <> '' AND pages >= 4 AND n >= greatest(3.0, 0.5 * pages)""")
def edge_key_repeat(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\\n")).alias("page", "text"))
    blocks = lines.select("doc", "page", F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"), "text")
    return structure.repeated_edges(blocks, T.edge_key(F.col("text")))


_SCRIPTS = [(1, "नेपाल 2015"), (2, "Flood in Nepal"), (3, "日本語の文書"), (4, "    "), (5, "नेपाल and a long English sentence"), (6, "g]kfn k|b]z")]
_SEEN = "regexp_replace(body, '[\\s\\x{00A0}]', '', 'g')"


@query(
    f"""SELECT id, CASE WHEN length({_SEEN}) = 0 THEN '' WHEN len(regexp_extract_all(body, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]')) / length({_SEEN}) >= 0.2 THEN 'other'
WHEN len(regexp_extract_all(body, '[\\x{{0900}}-\\x{{097F}}]')) / length({_SEEN}) >= 0.3 THEN 'ne' ELSE 'en' END AS lang, CAST(length({_SEEN}) AS BIGINT) AS visible FROM {values(_SCRIPTS, "id, body")}"""
)
def script_share(spark, sf_dir):
    rows = spark.createDataFrame(_SCRIPTS, "id int, body string")
    return rows.select("id", T.page_language(F.col("body")).alias("lang"), T.visible_length(F.col("body")).cast("long").alias("visible"))


@query("SELECT doc_id, substr(sha1(text), 1, 20) AS hash, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) // 128 AS shard FROM documents")
def text_hash_shards(spark, sf_dir):
    # Row numbers without one task for all rows: each range's size first, then places within the range.
    docs = table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))
    bucket = docs.withColumn("_b", F.floor(F.col("doc_id") / 4096))
    sizes = bucket.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"]).drop("_n")
    place = F.row_number().over(Window.partitionBy("_b").orderBy("doc_id")) - 1 + F.col("_before")
    return bucket.join(before, "_b").select("doc_id", "hash", F.floor(place / 128).cast("long").alias("shard"))


@query("""WITH d AS (SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, source FROM d WHERE n = 1 OR used <= 14000""")
def budget_prefix(spark, sf_dir):
    return structure.within_budget(table(spark, sf_dir, "documents"), "source", "doc_id", F.col("n_chars"), 14_000).select("doc_id", "source")


@query("""WITH t AS (SELECT greatest(1, length(text) // 4) AS v FROM documents), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM t)
SELECT count(*) AS chunks, round(avg(v), 6) AS mean_tokens, CAST(min(CASE WHEN i = n // 2 THEN v END) AS BIGINT) AS median_tokens,
CAST(min(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN v END) AS BIGINT) AS p95_tokens, CAST(max(v) AS BIGINT) AS max_tokens FROM o""")
def token_stats_upper_median(spark, sf_dir):
    return structure.upper_median(table(spark, sf_dir, "documents").select(T.token_estimate(F.col("text")).alias("tokens")), "tokens")


@query("""SELECT doc_id, CASE WHEN length(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '', '')) > 600 THEN
replace(replace(replace(replace(replace(regexp_replace(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 600), '\\s\\S*$', '') || '…', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
ELSE replace(replace(replace(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') END AS snippet FROM documents""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def page_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:10] AS ls FROM documents)
SELECT doc_id, coalesce(substr(list_filter(ls, lambda x: length(x) > 20 AND NOT regexp_matches(lower(x), '^(abstract|keywords|introduction)'))[1], 1, 200), 'untitled') AS title FROM l""")
def title_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.guess_title(F.col("text"), F.lit("untitled")).alias("title"))


_YEARS = [(1, "flood 1993 and 2015", "x"), (2, "", "1970_Marahatta_study"), (3, "in 1969 and 2031", "report 2001.pdf"), (4, "no year", "none"), (5, "2029 2030a", "y")]


@query(f"""SELECT id, CAST(list_max(list_filter(list_transform(regexp_extract_all(substr(body, 1, 2000) || ' ' || name, '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1970 AND 2030)) AS INTEGER) AS year FROM {values(_YEARS, "id, body, name")}""")
def year_guess(spark, sf_dir):
    return spark.createDataFrame(_YEARS, "id int, body string, name string").select("id", T.guess_year(F.col("body"), F.col("name")).alias("year"))


# --- Catalogue ------------------------------------------------------------------------------------------------------

_FILES = [
    ("1", "/papers/01_Floods/2019_Bastola_Assessment_of_Soil_W2994851782.pdf", "2019_Bastola_Assessment_of_Soil_W2994851782.pdf"),
    ("2", "/papers/_wrong_pdf/notes.pdf", "notes.pdf"),
    ("3", "/x.pdf", "x.pdf"),
    ("4", "/reports/ICIMOD/2001_Some_Report_w12.PDF", "2001_Some_Report_w12.PDF"),
    ("5", "/papers/2010_A_B_W1.pdf", "2010_A_B_W1.pdf"),
]
_RE = "'(?i)^(\\d{4})_([^_]+)_(.+)_(W\\d+)\\.pdf$'"


@query(f"""WITH p AS (SELECT *, string_split(trim(path, '/'), '/') AS parts FROM {values(_FILES, "id, path, name")}),
c AS (SELECT *, CASE WHEN len(parts) > 1 THEN parts[1] ELSE '' END AS collection, CASE WHEN len(parts) > 2 THEN parts[2] ELSE '' END AS category FROM p)
SELECT id, collection, category, CASE WHEN collection = 'papers' THEN regexp_extract(name, {_RE}, 1) ELSE '' END AS year, CASE WHEN collection = 'papers' THEN regexp_extract(name, {_RE}, 2) ELSE '' END AS author,
CASE WHEN collection = 'papers' THEN replace(regexp_extract(name, {_RE}, 3), '_', ' ') ELSE '' END AS title, CASE WHEN collection = 'papers' THEN upper(regexp_extract(name, {_RE}, 4)) ELSE '' END AS openalex_id,
list_contains(parts[1:len(parts) - 1], '_wrong_pdf') AS skip FROM c""")
def manifest_parse(spark, sf_dir):
    return catalogue.manifest(spark.createDataFrame(_FILES, "id string, path string, name string")).drop("path", "name")


_SITE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"SELECT {_SITE} AS folder, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, CAST(count(*) FILTER (WHERE regexp_matches(url, '(?i)\\.pdf$')) AS BIGINT) AS pdfs FROM pages GROUP BY 1")
def folder_rollup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.octet_length("html").alias("size"), F.col("url").alias("name"), "url")
    return catalogue.folder_summary(pages, F.regexp_extract("url", "^https?://([^/?#]+)", 1))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = catalogue.classify(F.col("n_chars") % 7, F.col("n_chars"), F.col("n_chars") * 20)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", status.alias("status"))


_STATUS = "CASE WHEN n_chars % 7 = 0 THEN 'broken' WHEN n_chars < 200 THEN 'needs_ocr' WHEN n_chars * 20 < 20000 THEN 'stub' WHEN n_chars < 800 THEN 'low_text' ELSE 'ok' END"


@query(f"SELECT doc_id, lang, {_STATUS} AS status FROM documents")
def quality_classify(spark, sf_dir):
    return _report(spark, sf_dir)


@query(f"WITH r AS (SELECT lang, {_STATUS} AS status FROM documents) SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in catalogue.STATUSES) + " FROM r GROUP BY lang")
def status_pivot(spark, sf_dir):
    return catalogue.status_table(_report(spark, sf_dir), "lang")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM documents""")
def report_upsert(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return catalogue.upsert(ids.withColumn("version", F.lit("old")), ids.where("doc_id % 3 = 0").withColumn("version", F.lit("new")), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return catalogue.pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_left_join(spark, sf_dir):
    return catalogue.with_right_columns(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


_SIZES = [(1, 5), (2, 2048), (3, 5 * 1024**3), (4, 1023), (5, 3 * 1024**5)]


@query(f"SELECT id, CASE WHEN n < 1024 THEN format('{{:.1f}} B', n * 1.0) WHEN n < 1048576 THEN format('{{:.1f}} KB', n / 1024.0) WHEN n < 1073741824 THEN format('{{:.1f}} MB', n / 1048576.0) WHEN n < 1099511627776 THEN format('{{:.1f}} GB', n / 1073741824.0) WHEN n < 1125899906842624 THEN format('{{:.1f}} TB', n / 1099511627776.0) ELSE format('{{:.1f}} PB', n / 1125899906842624.0) END AS size FROM {values(_SIZES, 'id, n')}")
def human_sizes(spark, sf_dir):
    return spark.createDataFrame(_SIZES, "id int, n long").select("id", T.human_size(F.col("n").cast("double")).alias("size"))


# --- Structure ------------------------------------------------------------------------------------------------------

_PARAGRAPHS = [
    ("a", 1, "1 Intro"), ("a", 2, "Some text of the introduction."), ("a", 3, "1.1 Scope"), ("a", 4, "Scope text here."), ("a", 5, "2 Data"), ("a", 6, "Data text."),
    ("b", 1, "Acknowledgements"), ("b", 2, "x" * 3000), ("b", 3, "y" * 2000), ("b", 4, "short one."), ("b", 5, "RESULTS"), ("b", 6, "Rivers rose ..... 5"), ("b", 7, "Rivers rose."),
    ("c", 1, "No heading."), ("c", 2, "CHAPTER ONE"), ("c", 3, "Introduction"), ("c", 4, "Text under it."), ("c", 5, "Contents"), ("c", 6, "A line"), ("c", 7, "METHODS"), ("c", 8, "More."),
]


def _pattern(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _level_sql(k: int) -> str:
    last = lambda value, when: f"last_value(CASE WHEN {when} THEN {value} END IGNORE NULLS) OVER w"
    return f"{last('seq', f'level = {k}')} AS a{k}, {last('seq', f'level < {k}')} AS b{k}, {last('text', f'level = {k}')} AS t{k}"


_SECTIONS = f"""WITH p AS (SELECT *, length(text) <= 100 AND regexp_matches(text, {_pattern(structure.SKIP_SECTION)}) AS skip FROM {values(_PARAGRAPHS, "doc, seq, text")}),
h AS (SELECT *, NOT skip AND length(text) <= 100 AND len(regexp_split_to_array(trim(text), '\\s+')) <= 12 AND NOT regexp_matches(rtrim(text), '[.,;]$') AND regexp_matches(trim(text), {_pattern(structure.HEADING)}) AS head FROM p),
l AS (SELECT *, CASE WHEN NOT head THEN NULL WHEN regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s', 1) <> '' THEN length(regexp_replace(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s', 1), '[^.]', '', 'g')) + 1
WHEN regexp_matches(text, {_pattern(structure.TOP_LEVEL)}) THEN 1 ELSE 2 END AS level FROM h),
g AS (SELECT *, {", ".join(map(_level_sql, range(1, 5)))}, CAST(sum(CAST(head AS INTEGER)) OVER w AS BIGINT) AS segment, sum(CAST(skip OR head AS INTEGER)) OVER w AS grp FROM l WINDOW w AS (PARTITION BY doc ORDER BY seq)),
d AS (SELECT *, bool_or(skip) OVER (PARTITION BY doc, grp) AND sum(CASE WHEN skip OR head THEN 0 ELSE length(text) END) OVER (PARTITION BY doc, grp ORDER BY seq) <= 4000 AS gone FROM g)
SELECT doc, seq, md5(text) AS text, concat_ws(' > ', {", ".join(f"CASE WHEN a{k} IS NOT NULL AND (b{k} IS NULL OR a{k} > b{k}) THEN t{k} END" for k in range(1, 5))}) AS section, segment
FROM d WHERE NOT skip AND NOT head AND NOT gone AND NOT (regexp_matches(text, {_pattern(structure.TOC_ENTRY)}) AND length(text) < 400)"""


@query(_SECTIONS)
def section_path(spark, sf_dir):
    rows = structure.sections(spark.createDataFrame(_PARAGRAPHS, "doc string, seq int, text string"))
    return rows.select("doc", "seq", F.md5("text").alias("text"), "section", "segment")


_BLOCKS = [
    ("a", 1, 1, "Body text."), ("a", 1, 2, "References"), ("a", 2, 3, "Smith et al 2010."), ("a", 2, 4, "p" * 320), ("a", 2, 5, "q" * 330), ("a", 3, 6, "r" * 340), ("a", 3, 7, "Tail."),
    ("b", 1, 1, "References"), ("b", 1, 2, "Jones 1999"), ("b", 2, 3, "s" * 400), ("b", 3, 4, "ANNEX ONE"), ("b", 3, 5, "End."),
    ("c", 1, 1, "Bibliography:"), ("c", 1, 2, "t" * 400), ("c", 2, 3, "doi:10.1"), ("d", 1, 1, "Only text."),
]


_LINE = "split_part(trim(text), chr(10), 1)"
_REFERENCES = f"""WITH k AS (SELECT *, CASE WHEN regexp_matches({_LINE}, {_pattern(structure.REFERENCE_HEADING)}) THEN 'R'
WHEN length(trim({_LINE})) <= 100 AND NOT regexp_matches(trim({_LINE}), {_pattern(structure.CITATION_HINT)}) AND regexp_matches(trim({_LINE}), {_pattern(structure.SECTION_HEADING)}) THEN 'S'
WHEN length(text) >= 300 AND NOT regexp_matches(text, {_pattern(structure.CITATION_HINT)}) THEN 'P' ELSE 'C' END AS kind FROM {values(_BLOCKS, "doc, page, seq, text")}),
r AS (SELECT *, sum(CAST(kind = 'R' AS INTEGER)) OVER (PARTITION BY doc ORDER BY seq) AS region FROM k),
n AS (SELECT *, kind = 'P' AND lag(kind, 1) OVER w = 'P' AND lag(kind, 2) OVER w = 'P' AS third FROM r WINDOW w AS (PARTITION BY doc, region ORDER BY seq)),
e AS (SELECT doc, region, min(CASE WHEN kind = 'S' THEN seq WHEN third THEN seq END) AS stop FROM n GROUP BY ALL),
j AS (SELECT n.*, stop FROM n JOIN e USING (doc, region)),
b AS (SELECT j.*, (SELECT max(o.seq) FROM j o WHERE o.doc = j.doc AND o.region = j.region AND o.seq < j.stop AND o.kind <> 'P') AS last_other, (SELECT max(o.page) FROM j o WHERE o.doc = j.doc AND o.seq = j.stop) AS stop_page FROM j)
SELECT doc, CASE WHEN region > 0 AND seq < stop THEN stop_page ELSE page END AS page, seq, md5(text) AS text FROM b
WHERE region = 0 OR seq >= stop OR (kind = 'P' AND seq < stop AND seq > last_other)"""


@query(_REFERENCES)
def reference_list_strip(spark, sf_dir):
    rows = structure.strip_references(spark.createDataFrame(_BLOCKS, "doc string, page int, seq int, text string"))
    return rows.select("doc", "page", "seq", F.md5("text").alias("text"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\\n")).alias("seq", "text"))
    return structure.sections(rows.where(F.trim("text") != "")).withColumn("page", F.lit(1))


@query()
def segment_pack(spark, sf_dir):
    return chunking.chunk(_paragraphs(spark, sf_dir))


@query()
def chunk_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("reports").alias("collection"), F.col("source").alias("category"), F.lit("").alias("title"), F.lit("").alias("year"), F.concat(F.lit("/reports/"), "source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("path"))
    return chunking.records(chunking.chunk(_paragraphs(spark, sf_dir)), docs).select("chunk_id", "section", "title", "lang", "tokens", "embed_tokens", F.md5("embed_text").alias("embed_hash"))


# --- Search ---------------------------------------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")


_SPLIT = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
_BM25 = f"""listed AS (SELECT doc_id AS id, {_SPLIT.format("text")} AS w FROM documents), corpus AS (SELECT CAST(count(*) AS DOUBLE) AS docs, avg(len(w)) AS avgdl FROM listed),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM listed) GROUP BY ALL),
idf0 AS (SELECT term, ln(docs - n + 0.5) - ln(n + 0.5) AS idf FROM (SELECT term, count(*) AS n FROM tf GROUP BY term), corpus), floor AS (SELECT 0.25 * avg(idf) AS floor FROM idf0),
idf AS (SELECT term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM idf0, floor),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT CAST(item_id AS BIGINT) AS query_id, unnest({_SPLIT.format("text")}) AS term FROM benchmark) GROUP BY ALL),
hit AS (SELECT query_id, tf.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN listed ON listed.id = tf.id, corpus GROUP BY ALL),
scored AS (SELECT b.query_id, d.id, coalesce(score, 0.0) AS score FROM (SELECT CAST(item_id AS BIGINT) AS query_id FROM benchmark) b CROSS JOIN (SELECT id FROM listed) d LEFT JOIN hit ON hit.query_id = b.query_id AND hit.id = d.id),
keyword AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM scored QUALIFY rank <= 30)"""


@query(f"WITH {_BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM keyword")
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir), 30)
    return found.withColumn("score", F.round("score", 6))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_DOT = "round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6)"


def _vector_sql(asked: str, items: str, k: int) -> str:
    return f"SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank, e.vec_id AS id, {_DOT} AS score FROM embeddings q, embeddings e WHERE {asked} AND {items} QUALIFY rank <= {k}"


@query(_vector_sql("q.vec_id % 100 = 0", "true", 30))
def vector_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return retrieval.vector_topk(rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 30)


@query(_vector_sql("q.vec_id % 100 = 0", "e.label = 2", 10))
def vector_topk_prefilter(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return retrieval.vector_topk(rows.where("label = 2"), rows.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10)


def _asked_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those of the questions: a question's vector is the one of its id."""
    rows = _vectors(spark, sf_dir)
    return rows, rows.withColumnRenamed("id", "query_id").join(_questions(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both lists of each question."""
    rows, asked = _asked_vectors(spark, sf_dir)
    return retrieval.vector_topk(rows, asked, 30), retrieval.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir), 30)


_VECTOR = f"vector AS ({_vector_sql('q.vec_id IN (SELECT item_id FROM benchmark)', 'true', 30)})"


def _rrf_sql(lists: str, k: int) -> str:
    return f"""(SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, l, r) AS rank, id, round(s, 5) AS score
FROM (SELECT query_id, id, sum(1.0 / (60 + rank)) AS s, min(list) AS l, min_by(rank, list) AS r FROM ({lists}) GROUP BY ALL) QUALIFY rank <= {k})"""


_BOTH = "SELECT query_id, id, rank, 0 AS list FROM vector UNION ALL SELECT query_id, id, rank, 1 AS list FROM keyword"


@query(f"WITH {_BM25}, {_VECTOR} SELECT * FROM {_rrf_sql(_BOTH, 8)}")
def rrf_hybrid(spark, sf_dir):
    return retrieval.rrf([*_lists(spark, sf_dir)], 8)


@query(
    f"WITH {_BM25}, {_VECTOR} SELECT 'hybrid' AS mode, * FROM {_rrf_sql(_BOTH, 8)} UNION ALL SELECT 'vector' AS mode, * FROM {_rrf_sql('SELECT query_id, id, rank, 0 AS list FROM vector', 8)} "
    f"UNION ALL SELECT 'keyword' AS mode, * FROM {_rrf_sql('SELECT query_id, id, rank, 1 AS list FROM keyword', 8)}"
)
def search_modes(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    parts = [retrieval.search(m, a, b).select(F.lit(m).alias("mode"), "query_id", "rank", "id", "score") for m in ("hybrid", "vector", "keyword")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_BM25}, {_VECTOR} SELECT f.query_id, f.rank, f.id, f.score FROM {_rrf_sql(_BOTH, 60)} f JOIN documents ON doc_id = f.id WHERE contains(source, 'src1')")
def postfilter_substring(spark, sf_dir):
    fused = retrieval.rrf([*_lists(spark, sf_dir)], 60)
    return fused.join(_docs(spark, sf_dir).select("id", "source"), "id").where(retrieval.contains_tag("source", "src1")).select("query_id", "rank", "id", "score")


_WHERE = "source = (SELECT min(source) FROM documents)"
_NEAR = f"vector AS ({_vector_sql('q.vec_id IN (SELECT item_id FROM benchmark)', f'e.vec_id IN (SELECT doc_id FROM documents WHERE {_WHERE})', 30)})"


@query(f"WITH {_BM25}, {_NEAR}, f AS (SELECT f.*, md5(text) AS text FROM {_rrf_sql(_BOTH, 60)} f JOIN documents ON doc_id = f.id WHERE {_WHERE}) SELECT query_id, rank, id, score, text FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6")
def retrieve_filtered(spark, sf_dir):
    """The vector list is limited to a category beforehand; both lists are afterwards."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("category"))
    vectors, asked = _asked_vectors(spark, sf_dir)
    found = retrieval.retrieve(chunks, _questions(spark, sf_dir), vectors, asked, category=docs.agg(F.min("source")).first()[0])
    return found.withColumn("text", F.md5("text"))


@query(f"WITH {_BM25}, {_VECTOR}, f AS (SELECT f.*, md5(text) AS text FROM {_rrf_sql(_BOTH, 60)} f JOIN documents ON doc_id = f.id) SELECT query_id, rank, id, score, text FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6")
def batch_questions(spark, sf_dir):
    """All questions at once, the first six hits that are documents each."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("category"))
    vectors, asked = _asked_vectors(spark, sf_dir)
    return retrieval.retrieve(chunks, _questions(spark, sf_dir), vectors, asked).withColumn("text", F.md5("text"))


def _index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """An index created of half the rows, appended to with the rest, compacted and opened anew."""
    folder = scratch_folder(spark, "index")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    vectors = _vectors(spark, sf_dir).select("id", "vector")
    index = SearchIndex.create(chunks.where("id % 2 = 0"), vectors.where("id % 2 = 0"), folder)
    index.append(chunks.where("id % 2 = 1"), vectors.where("id % 2 = 1"))
    index.compact()
    return SearchIndex(spark, folder)


@query(f"WITH {_BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM keyword WHERE score > 0")
def index_keyword(spark, sf_dir):
    """Hits alone: the index doesn't fill lists up."""
    return _index(spark, sf_dir).keyword(_questions(spark, sf_dir), 30).withColumn("score", F.round("score", 6))


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))"


@query(f"""WITH u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings) SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, e.v), 6) DESC, e.vec_id) AS rank, e.vec_id AS id,
round(list_inner_product(q.v, e.v), 6) AS score FROM u q, u e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""")
def index_vector(spark, sf_dir):
    return _index(spark, sf_dir).vector(_vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def clustered_recall(spark, sf_dir):
    """Search by lists, with its defaults, finds nine tenths of the ten exact neighbours or more."""
    rows = _vectors(spark, sf_dir).select("id", "vector")
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    near = retrieval.ClusteredVectors(rows, least_rows=100).search_all(asked, 10)
    exact = retrieval.ClusteredVectors(rows).search_all(asked, 10)
    found = near.join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count("*").alias("found"))
    return asked.agg(F.count("*").alias("queries")).crossJoin(found).crossJoin(exact.agg(F.count("*").alias("n"))).select("queries", (F.col("found") >= 0.9 * F.col("n")).alias("reached"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE label = 3 AND vec_id >= 100 AND vec_id <= 400 AND vec_id > 0")
def metadata_filter(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", "label", F.col("label").cast("string").alias("category"), F.col("id").cast("int").alias("year_int"))
    return rows.where(retrieval.metadata_filter(category="3", year_min=100, year_max=400)).select("id", "label")


@query("SELECT DISTINCT source FROM documents")
def list_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct()


# --- Noise, vectors, verification -----------------------------------------------------------------------------------

_CHUNKS = [
    ("a", 0, "Interactive comment on the paper by Smith."), ("a", 1, "Plain prose about rivers and rain."), ("b", 0, "Plain prose."), ("b", 1, "L418: please comment. L465-470: unclear."), ("b", 2, "We thank the reviewer for this."),
    ("c", 0, "Smith et al 2010 said"), ("c", 1, "Rivers rose in 2015 and fell in 2016 across the whole wide valley, as people said."), ("d", 0, "P., J. Smith doi 10.1 vol. 3 pp. 12"), ("d", 1, "L418: only one."),
]
_DENSITY = """((len(regexp_extract_all(body, '(?i)\\bdoi\\b|https?://|\\[\\d{1,3}\\]|\\bpp?\\.\\s*\\d|\\bvol\\.|\\b\\d+\\s*\\(\\d+\\)\\s*[:,]|\\bet al\\b|\\b\\d+\\s*:\\s*\\d+\\s*[-–]\\s*\\d+'))
+ len(regexp_extract_all(regexp_replace(body, '[\\x{00C0}-\\x{024F}]', 'a', 'g'), '\\b[A-Z]\\.[\\s,]')) + 0.25 * len(regexp_extract_all(body, '\\b(?:19|20)\\d{2}[a-z]?\\b'))) / greatest(1, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> ''))))"""
_REVIEW = "(regexp_matches(body, '" + noise.REVIEW_MARKER.replace("'", "''") + "') OR len(regexp_extract_all(body, '\\bL\\d{2,4}(?:\\s*[-‐–]\\s*\\d{1,4})?\\s*:')) >= 2)"


def _inline_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CHUNKS, "doc_id string, chunk_index int, text string")


@query(f"SELECT doc_id, i AS chunk_index, round({_DENSITY}, 6) AS density FROM {values(_CHUNKS, 'doc_id, i, body')} UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, round({_DENSITY.replace('body', 'text')}, 6) FROM documents")
def citation_density(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "text")
    return _inline_chunks(spark).unionByName(docs).select("doc_id", "chunk_index", F.round(noise.citation_density(F.col("text")), 6).alias("density"))


_REVIEWED = f"SELECT doc_id FROM {values(_CHUNKS, 'doc_id, i, body')} GROUP BY doc_id HAVING count(*) FILTER (WHERE {_REVIEW}) >= 2 OR bool_or(i = 0 AND {_REVIEW})"


@query(_REVIEWED)
def review_docs(spark, sf_dir):
    return noise.review_docs(_inline_chunks(spark))


@query(f"SELECT doc_id, i AS chunk_index, CASE WHEN doc_id IN ({_REVIEWED}) THEN 'peer_review' WHEN {_DENSITY} > 0.12 THEN 'citation_dense' END AS reason FROM {values(_CHUNKS, 'doc_id, i, body')}")
def drop_reasons(spark, sf_dir):
    return noise.drop_reasons(_inline_chunks(spark)).select("doc_id", "chunk_index", "reason")


@query("SELECT doc_id, source AS reason, substr(text, 1, 500) AS text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100")
def drop_sample_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("reason"), "text")
    return noise.dropped_sample(rows, "doc_id")


_NORM = "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))"


@query(f"SELECT count(*) AS n_rows, 0 AS not_finite, count(*) FILTER (WHERE abs({_NORM} - 1) > 0.01) AS off_norm, round(min({_NORM}), 4) AS min_norm, round(max({_NORM}), 4) AS max_norm FROM embeddings".replace(" 0 AS", " CAST(0 AS BIGINT) AS"))
def norm_check(spark, sf_dir):
    return noise.vector_problems(_vectors(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id AS id, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings), s AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'old' ELSE h END AS g FROM e WHERE id % 7 <> 0 UNION ALL SELECT -id - 1, h FROM e WHERE id % 50 = 0)
SELECT count(*) FILTER (WHERE g IS NULL) AS missing, count(*) FILTER (WHERE h IS NULL) AS extra, count(*) FILTER (WHERE h <> g) AS stale, count(*) FILTER (WHERE h = g) AS matching FROM e FULL JOIN s USING (id)""")
def verify_alignment(spark, sf_dir):
    expected = _vectors(spark, sf_dir).select("id", F.md5(F.col("id").cast("string")).alias("hash"))
    saved = expected.where("id % 7 <> 0").withColumn("hash", F.when(F.col("id") % 11 == 0, "old").otherwise(F.col("hash")))
    more = expected.where("id % 50 = 0").select((-F.col("id") - 1).alias("id"), "hash")
    return noise.alignment(expected, saved.unionByName(more))


@query("""WITH c AS (SELECT source, substr(sha1(text), 1, 20) AS hash, doc_id FROM documents), k AS (SELECT source, hash, max(doc_id) AS cached FROM c WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT doc_id, cached FROM c LEFT JOIN k USING (source, hash)""")
def text_hash_reuse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.text_hash(F.col("text")).alias("hash"))
    cache = rows.where("doc_id % 2 = 0").select("source", "hash", F.col("doc_id").alias("id"), F.col("doc_id").alias("vector"))
    return noise.reuse(rows, cache, "source", "hash").select("doc_id", F.col("vector").alias("cached"))


@query("SELECT sha1(text) AS k FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def repeated_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha1(F.col("text").cast("binary")).alias("k"), "source")
    return noise.repeated_ids(rows, "k", "source")


# --- Answers --------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN before IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 8 THEN before || ' ' || text ELSE text END AS query FROM t WHERE role = 'user'""")
def followup_rewrite(spark, sf_dir):
    return answers.followup_query(table(spark, sf_dir, "conversations"))


_DRAFTS = [(1, "a [S1]. b (S9).", 2), (2, "no label here", 3), (3, "x [S2, S5] and S 3. y [S2]", 4), (4, "XS1 and S123 [S4]", 4)]


@query(f"""WITH c AS (SELECT id, n, list_sort(list_distinct(list_transform(regexp_extract_all(body, '\\bS\\s?(\\d{{1,2}})\\b', 1), lambda x: CAST(x AS INTEGER)))) AS l FROM {values(_DRAFTS, "id, body, n")})
SELECT id, array_to_string(list_filter(l, lambda x: x BETWEEN 1 AND n), ',') AS valid, array_to_string(list_filter(l, lambda x: NOT (x BETWEEN 1 AND n)), ',') AS invalid FROM c""")
def cite_labels_check(spark, sf_dir):
    valid, invalid = answers.citations(F.col("body"), F.col("n"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return spark.createDataFrame(_DRAFTS, "id int, body string, n int").select("id", joined(valid).alias("valid"), joined(invalid).alias("invalid"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each document: its first words, once with a label that lacks a number, and sentences of two other texts; its sources are the three texts."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("source"), F.substring("text", 1, 600).alias("text"))
    part = lambda k, m: docs.select((F.col("id") + k).alias("id"), F.col("text").alias(f"t{m}"), F.col("source").alias(f"s{m}"))
    rows = docs.join(part(1, 1), "id").join(part(2, 2), "id")
    sentence = lambda c: F.concat(F.initcap(F.array_join(F.slice(T.words(F.regexp_replace(c, "[.!?]", "")), 1, 9), " ")), F.lit("."))
    hit = lambda k, t, s: F.struct((F.col("id") - k).cast("string").alias("doc_id"), F.concat(F.col(t), F.lit(f" Level {k}{k}.5 was met.")).alias("text"), F.concat(F.lit("Title "), F.col(s)).alias("title"), F.when(F.col("id") % 2 == 0, "Bastola").otherwise("").alias("author"), F.lit("reports").alias("collection"), F.col(s).alias("category"), F.lit("2019").alias("year"), F.concat(F.lit("/reports/"), F.col(s)).alias("path"), F.lit(k + 1).alias("page_start"), F.lit(k + 2).alias("page_end"))
    text = F.concat_ws(" ", sentence(F.col("text")), F.lit("Level 11.5 was met [S1]. Level 77.7 was met [S2, S9]."), sentence(F.col("t2")))
    return rows.select("id", text.alias("answer"), F.array(hit(0, "text", "source"), hit(1, "t1", "s1"), hit(2, "t2", "s2")).alias("used"))


_PLAIN = "rtrim(replace({0}, ',', ''), '.')"
_GROUPS = "'[\\[(][^\\])]{0,40}?\\bS\\s?\\d{1,2}\\b[^\\])]{0,40}[\\])]'"


@query(f"""WITH d AS (SELECT doc_id, substr(text, 1, 600) AS text FROM documents WHERE text IS NOT NULL),
r AS (SELECT a.doc_id AS id, [a.text || ' Level 00.5 was met.', b.text || ' Level 11.5 was met.', c.text || ' Level 22.5 was met.'] AS used FROM d a JOIN d b ON b.doc_id = a.doc_id - 1 JOIN d c ON c.doc_id = a.doc_id - 2),
h AS (SELECT id, list_transform(used, lambda t: list_transform(regexp_extract_all(trim(regexp_replace(t, '\\s?\\[\\d{{1,3}}(?:\\s*[,–-]\\s*\\d{{1,3}})*\\]', '', 'g')), '\\d+(?:[.,]\\d+)*'), lambda x: {_PLAIN.format("x")})) AS held FROM r),
s AS (SELECT * FROM (VALUES ('Level 11.5 was met [S1].', 1), ('Level 77.7 was met [S2, S9].', 2)) AS t(sentence, label)),
n AS (SELECT id, sentence, label, held, unnest(regexp_extract_all(regexp_replace(sentence, {_GROUPS}, '', 'g'), '\\d+(?:[.,]\\d+)*')) AS number FROM h, s)
SELECT id, number, sentence FROM n WHERE NOT list_contains(held[label], {_PLAIN.format("number")})""")
def ungrounded_numbers(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    answer = F.lit("Level 11.5 was met [S1]. Level 77.7 was met [S2, S9].")
    bad = answers.ungrounded_numbers(answer, F.col("used")["text"])
    return rows.select("id", F.explode(bad).alias("x")).select("id", "x.number", "x.sentence")


@query()
def finished_answers(spark, sf_dir):
    rows = answers.finished(_answers(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("id", "cited", "final", text(F.col("valid")).alias("valid"), text(F.col("invalid")).alias("invalid"), F.size("ungrounded").alias("n_ungrounded"), "uncited", F.array_join("references", "\n").alias("references"))


@query(f"WITH {_BM25}, b AS (SELECT query_id, rank, '[S' || rank || '] Document ' || k.id || ' (n.d.), p1' || chr(10) || trim(regexp_replace(text, '\\s?\\[\\d{{1,3}}(?:\\s*[,–-]\\s*\\d{{1,3}})*\\]', '', 'g')) || chr(10) || '[end of S' || rank || ']' AS block FROM keyword k JOIN documents ON doc_id = k.id WHERE rank <= 8), s AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM b) SELECT query_id, rank, block FROM s WHERE rank = 1 OR spent <= 14000")
def source_blocks(spark, sf_dir):
    hits = retrieval.bm25(_docs(spark, sf_dir), _questions(spark, sf_dir), 8).join(_docs(spark, sf_dir).select("id", "text"), "id")
    rows = hits.select("query_id", "rank", F.concat(F.lit("Document "), "id").alias("title"), F.lit("").alias("year"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("").alias("section"), "text")
    return answers.source_blocks(rows)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top hits among document windows, copies dropped, for each benchmark question."""
    docs = table(spark, sf_dir, "documents")
    windows = docs.select("doc_id", F.posexplode(structure.char_windows(F.col("text"))).alias("i", "text")).withColumn("id", F.concat("doc_id", F.lit(":"), F.format_string("%04d", "i")))
    once = catalogue.keep_first(windows, T.dedupe_key(F.col("text")), "doc_id", "i", "id").select("id", "text")
    return retrieval.bm25(once, _questions(spark, sf_dir), 8)


queries, oracle_sql = registry.queries, registry.oracle_sql
MODULES = (corpus,)
