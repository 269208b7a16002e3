"""Summaries of files, reports and chunks: each one grouped aggregation, partial in every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PDF = "application/pdf"


def type_totals(files: DataFrame) -> DataFrame:
    """files, bytes, pdfs, google_native, other of files (mime_type, size_bytes)."""
    pdf, google = F.col("mime_type") == PDF, F.col("mime_type").startswith("application/vnd.google-apps")
    other = ~F.coalesce(pdf | google, F.lit(False))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_if(pdf).alias("pdfs"), F.count_if(google).alias("google_native"), F.count_if(other).alias("other"))


def manifest_summary(manifest: DataFrame, tiny: int = 20_000) -> DataFrame:
    """One row: files to keep and skipped, bytes, papers and how many of their names were parsed, other types, repeated contents, tiny files."""
    keep, papers = ~F.col("skip"), ~F.col("skip") & (F.col("collection") == "papers")
    counted = manifest.agg(
        F.count_if(keep).alias("kept"), F.count_if("skip").alias("skipped"), F.coalesce(F.sum(F.when(keep, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(papers).alias("papers"), F.count_if(papers & (F.coalesce("openalex_id", F.lit("")) != "")).alias("parsed"),
        F.count_if(keep & (F.coalesce("mime_type", F.lit("")) != PDF)).alias("not_pdf"), F.count_if(keep & (F.col("size_bytes") > 0) & (F.col("size_bytes") < tiny)).alias("tiny"),
    )
    same = manifest.where(keep & (F.coalesce("md5", F.lit("")) != "")).groupBy("md5").agg(F.count("*").alias("n")).where("n > 1")
    extra = same.agg(F.count("*").alias("repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_copies"))
    rate = F.when(F.col("papers") > 0, F.round(100 * F.col("parsed") / F.col("papers"), 1))
    return counted.crossJoin(F.broadcast(extra)).withColumn("parsed_percent", rate)


def most_common(rows: DataFrame, *by: str, first: str) -> DataFrame:
    """place, by, n: the values by falling count; equal counts in the order in which they are met first."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_first")).cast("long")).select("place", *by, "n")


def mostly_nepali(report: DataFrame, least: float = 0.3) -> DataFrame:
    """documents and those of a Devanagari share of `least` or more."""
    return report.agg(F.count("*").alias("documents"), F.count_if(F.col("devanagari_ratio") >= least).alias("nepali"))


def extraction_totals(report: DataFrame) -> DataFrame:
    """Totals over an extraction report: documents by status, and of those that are ok pages, reference lists and text size."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
    pages = ["text_pages", "empty_pages", "emptied_pages", "nepali_pages", "other_lang_pages", "reference_sections", "reference_blocks_removed", "chars"]
    return report.agg(
        F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), *map(total, pages), F.count_if(ok & (F.col("legacy_font_pages") > 0)).alias("legacy_font_docs"),
        F.count_if(ok & (F.col("references_start_page") > 0)).alias("docs_without_references"), F.count_if(ok & (F.col("reference_sections") > 1)).alias("docs_with_several_lists"),
    )


def reason_totals(chunks: DataFrame) -> DataFrame:
    """reason (kept, if null) and number of chunks."""
    return chunks.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("chunks"))


def work_totals(chunks: DataFrame, longest: int = 1024) -> DataFrame:
    """chunks, tokens, too_long of chunks (embed_tokens); no other column is read."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("embed_tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("embed_tokens") > longest).alias("too_long"))


def per_category(documents: DataFrame, ok: Column) -> DataFrame:
    """category, documents that are ok, and all that were seen."""
    return documents.groupBy("category").agg(F.count_if(ok).alias("documents"), F.count("*").alias("seen"))


def download_progress(log: DataFrame) -> DataFrame:
    """ok, failed, bytes of a download log (status, size_bytes)."""
    ok = F.col("status") == "ok"
    return log.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)).alias("bytes"))


def smallest_pdf(files: DataFrame) -> DataFrame:
    """path and size of the smallest PDF with a size; the first path of several."""
    sized = files.where((F.col("mime_type") == PDF) & (F.col("size_bytes") > 0))
    return sized.agg(F.min(F.struct("size_bytes", "path")).alias("x")).where("x is not null").select("x.path", "x.size_bytes")


def selected(report: DataFrame, statuses: list[str], category: str | None = None, limit: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """Rows of a status, and a category, that aren't done yet (done: file_id), the first `limit` by path."""
    rows = report.where(F.col("status").isin(*statuses))
    rows = rows.where(F.col("category") == category) if category else rows
    rows = rows.join(done.select("file_id"), "file_id", "left_anti") if done is not None else rows
    return rows.orderBy("path", "file_id").limit(limit) if limit else rows
