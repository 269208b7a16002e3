"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard, language_model, licenses, mixing, pii, substrings, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"), html=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_pii_surrogates, op3_toxicity, op4_decontamination, op5_license_scan, op6_lm_scoring, op7_ngram_jaccard, op8_substring_dedup, op9_warc, op10_mixing)}


_OP1 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20"""

_WORDS4 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = f"""WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents), b AS (SELECT item_id, {_WORDS4} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i + 1:i + 10] AS win FROM b, unnest(range(greatest(len(w) - 10, 0) + 1)) AS u(i) WHERE len(w) > 0),
place AS (SELECT doc_id, i AS start, size, w[i + 1:i + size] AS win FROM d, (SELECT DISTINCT len(win) AS size FROM win) s, unnest(range(greatest(len(w) - size + 1, 0))) AS u(i)),
hit AS (SELECT doc_id, start, size, item_id FROM place JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT start + j) AS n_hit FROM hit, unnest(range(size)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP8 = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
place AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 35], ' ')) AS win FROM d, unnest(range(greatest(len(w) - 34, 0))) AS u(i)),
again AS (SELECT doc_id, i FROM place QUALIFY count(*) OVER (PARTITION BY win) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM again, unnest(range(35)) AS u(j)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS text FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


_SPACED = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

# Classes of equal sets, links between classes, and all that links reach.
_OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s FROM d),
c AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) > 0 THEN md5(CAST(list_sort(list_transform(s, lambda x: md5(array_to_string(x, ' ')))) AS VARCHAR)) END AS class FROM s),
sh AS MATERIALIZED (SELECT class, n, unnest(s) AS x FROM (SELECT class, any_value(n) AS n, any_value(s) AS s FROM c WHERE n > 0 GROUP BY class)),
link AS MATERIALIZED (SELECT a.class AS a, b.class AS b FROM sh a JOIN sh b USING (x) WHERE a.class <> b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.class, b.class HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
own AS (SELECT class, min(doc_id) AS least FROM c WHERE n > 0 GROUP BY class),
named AS (SELECT o.class, least(o.least, min(x.least)) AS component FROM own o LEFT JOIN reach ON reach.a = o.class LEFT JOIN own x ON x.class = reach.b GROUP BY o.class, o.least)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM c LEFT JOIN named USING (class)"""

# Base32: four signs of five bits for each five hex digits.
_SIGN = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> {0}) & 31) + 1, 1)"
_OP9 = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages),
r AS (SELECT *, CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: {" || ".join(_SIGN.format(k) for k in (15, 10, 5, 0))}), '') AS payload_digest,
CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

# Sources that reach twice their size, in the order in which a rising share fills them; then the seeded order of documents.
_OP10 = f"""WITH d AS (SELECT doc_id, source, CAST(len({_SPACED.format("coalesce(text, '')")}) AS BIGINT) AS size, substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS place FROM documents),
s AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
f AS (SELECT *, (sum(n) OVER () * 150 / 100.0::DOUBLE - coalesce(sum(2 * n) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) * w > 2 * n AS filled FROM o WINDOW r AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, CAST(n AS BIGINT) AS n, CAST(CASE WHEN filled THEN 2 * n ELSE (sum(n) OVER () * 150 / 100.0::DOUBLE - coalesce(sum(2 * n) FILTER (filled) OVER (), 0)) / sum(w) FILTER (NOT filled) OVER () * w END AS DOUBLE) AS target FROM f),
g AS (SELECT *, least(2 * n, CAST(floor(target + 0.5) AS BIGINT)) AS given FROM t),
p AS (SELECT d.*, n, target, given // greatest(n, 1) AS times, given % greatest(n, 1) AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY place) - sum(size) OVER (PARTITION BY d.source, place) AS before, count(*) FILTER (size > 0) OVER (PARTITION BY d.source, place) AS same FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target, CAST(size * times + greatest(0, least(size, (rest - before) // greatest(same, 1))) AS BIGINT) AS taken FROM p"""


def oracle_sql() -> dict[str, str]:
    """The others hold a trained model or a keyed choice, which SQL can't express; they are tested against brute force."""
    return {"op1_exact_topk": _OP1, "op4_decontamination": _OP4, "op7_ngram_jaccard": _OP7, "op8_substring_dedup": _OP8, "op9_warc": _OP9, "op10_mixing": _OP10}
