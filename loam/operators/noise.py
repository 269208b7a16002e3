"""Noise filter of the index: citation-dense chunks, peer-review discussion, samples of what was dropped; vector checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import word_count

# Marks of reference lists and of peer review.
REF_STRONG = "(?i)\\bdoi\\b|https?://|\\[\\d{1,3}\\]|\\bpp?\\.\\s*\\d|\\bvol\\.|\\b\\d+\\s*\\(\\d+\\)\\s*[:,]|\\bet al\\b|\\b\\d+\\s*:\\s*\\d+\\s*[-–]\\s*\\d+"
REF_INITIAL = "\\b[A-Z]\\.(?=[\\s,])"
REF_YEAR = "\\b(?:19|20)\\d{2}[a-z]?\\b"
REVIEW_MARKER = (
    "(?i)interactive comment|printer-friendly version|anonymous referee|referee\\s*#\\s*\\d|reviewer\\s*#\\s*\\d|response to (?:the )?reviewers?"
    "|reply to (?:the )?referees?|authors?'? response to|response to the (?:general|specific) comments?|technical corrections|we thank the (?:anonymous )?(?:reviewer|referee)s?\\b"
)
LINE_REF = "\\bL\\d{2,4}(?:\\s*[-‐–]\\s*\\d{1,4})?\\s*:"


def citation_density(text: Column) -> Column:
    """Weighted marks per word: years count a quarter."""
    marks = F.regexp_count(text, F.lit(REF_STRONG)) + F.regexp_count(text, F.lit(REF_INITIAL)) + 0.25 * F.regexp_count(text, F.lit(REF_YEAR))
    return marks / F.greatest(word_count(text), F.lit(1))


def is_review(text: Column) -> Column:
    return text.rlike(REVIEW_MARKER) | (F.regexp_count(text, F.lit(LINE_REF)) >= 2)


def review_docs(chunks: DataFrame, *within: str) -> DataFrame:
    """Documents with two review chunks, or whose first chunk is one, within each value of `within` and doc_id."""
    hit = is_review(F.col("text"))
    found = chunks.groupBy(*within, "doc_id").agg(F.count_if(hit).alias("n"), F.max((F.col("chunk_index") == 0) & hit).alias("first"))
    return found.where("n >= 2 OR first").select(*within, "doc_id")


def drop_reasons(chunks: DataFrame, *within: str, most: float = 0.12) -> DataFrame:
    """chunks with reason: peer_review, citation_dense or null. Review documents are found by a semi-join on their ids."""
    marked = review_docs(chunks, *within).withColumn("_review", F.lit(True))
    joined = chunks.join(marked, [*within, "doc_id"], "left")
    return joined.withColumn("reason", F.when(F.col("_review"), "peer_review").when(citation_density(F.col("text")) > most, "citation_dense")).drop("_review")


def dropped_sample(rows: DataFrame, *order: str, each: int = 100, chars: int = 500) -> DataFrame:
    """The first `each` dropped rows of every reason, with texts cut."""
    place = F.row_number().over(Window.partitionBy("reason").orderBy(*order))
    return rows.where("reason is not null").withColumn("_n", place).where(F.col("_n") <= each).drop("_n").withColumn("text", F.substring("text", 1, chars))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vector_problems(vectors: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """rows, not_finite, off_norm, min_norm, max_norm of a column `vector`."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.coalesce(bad, F.lit(True)).alias("bad"), norm(F.col("vector")).alias("n"))
    fine = F.when(~F.col("bad"), F.col("n"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("not_finite"), F.count_if(F.abs(fine - 1) > tolerance).alias("off_norm"), F.round(F.min(fine), 4).alias("min_norm"), F.round(F.max(fine), 4).alias("max_norm"))


def checked(vectors: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """vectors, or an error at the first one that isn't finite or not of length 1."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.abs(norm(F.col("vector")) - 1) <= tolerance)
    return vectors.where(F.when(good, True).otherwise(F.raise_error(F.lit("a vector isn't finite or not of length 1")).cast("boolean")))


def reuse(chunks: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """chunks with the cached vector of the same keys (a category and a text hash, say); null where it must be made."""
    once = cache.groupBy(*keys).agg(F.max_by("vector", "id").alias("vector"))
    return chunks.join(once, list(keys), "left")


def alignment(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """missing, extra, stale and matching ids between expected and saved (both id, hash)."""
    both = expected.select("id", F.col("hash").alias("a")).join(saved.select("id", F.col("hash").alias("b")), "id", "full_outer")
    a, b = F.col("a"), F.col("b")
    return both.agg(F.count_if(b.isNull()).alias("missing"), F.count_if(a.isNull()).alias("extra"), F.count_if(a != b).alias("stale"), F.count_if(a == b).alias("matching"))


def repeated_ids(rows: DataFrame, id_: str, file: str) -> DataFrame:
    """Ids that stand in more than one file."""
    return rows.groupBy(id_).agg(F.min(file).alias("a"), F.max(file).alias("b")).where("a <> b").select(id_)
