"""Document structure: running headers, reference lists, headings, skipped sections, windows and budgets.

All of it is window functions over (document, position), so that Spark plans it and no Python worker is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of headings and citations.
HEADING = (
    "^((?i:(chapter|section|part|annex(ure)?|appendix)\\s+[\\divxlc]+\\b.*)|\\d+(\\.\\d+){0,3}\\.?\\s+[A-Z][^.!?]{2,80}|[A-Z][A-Z0-9 ,&:()'/\\-]{3,80}"
    "|(?i:abstract|introduction|background|methods?|methodology|materials\\s+and\\s+methods|study\\s+area|results?|discussion|results\\s+and\\s+discussion"
    "|conclusions?|recommendations?|summary|executive\\s+summary|key\\s+findings))\\s*:?$"
)
SKIP_SECTION = (
    "^(\\d+(\\.\\d+)*\\.?\\s*)?(?i:acknowledge?ments?|table\\s+of\\s+contents|contents|list\\s+of\\s+(tables|figures|maps|boxes|abbreviations|acronyms)"
    "|abbreviations(\\s+and\\s+acronyms)?|acronyms(\\s+and\\s+abbreviations)?)\\s*:?\\s*$"
)
TOP_LEVEL = "^(?i:chapter|part|annex|appendix)|^[A-Z0-9 ,&:()'/\\-]+$"
TOC_ENTRY = "(?i)\\.{4,}\\s*[\\divxlc]+\\b"
PAGE_NUMBER = "(?i)^\\s*(page\\s*)?(\\d+|[ivxlc]{1,6})(\\s*(of|/)\\s*\\d+)?\\s*$"
REFERENCE_HEADING = "(?i)^\\s*(\\d+\\.?\\s*)?(references?( cited)?|bibliography|literature cited|works cited|reference list|citations)\\s*:?\\s*$"
CITATION_HINT = "(?i)\\b(19|20)\\d{2}[a-z]?\\b|\\bet al\\b|doi\\.org|\\bdoi:|https?://|\\bvol\\.|\\bpp?\\.\\s*\\d"
SECTION_HEADING = "^\\s*((?i:(chapter|section|part)\\s+[\\divxlc]+\\b.*)|(?i:(annex(ure)?|appendix|appendices)\\b.*)|\\d+(\\.\\d+)*\\.?\\s+[A-Z][^.]{2,80}|[A-Z][A-Z0-9 ,&:()\\-]{4,80})\\s*$"


def is_heading(p: Column) -> Column:
    short = (F.length(p) <= 100) & (F.size(F.split(F.trim(p), "\\s+")) <= 12)
    return short & ~F.rtrim(p).rlike("[.,;]$") & F.trim(p).rlike(HEADING)


def heading_level(h: Column) -> Column:
    number = F.regexp_extract(h, "^(\\d+(?:\\.\\d+)*)\\.?\\s", 1)
    return F.when(number != "", F.length(F.regexp_replace(number, "[^.]", "")) + 1).when(h.rlike(TOP_LEVEL), 1).otherwise(2)


def first_line(b: Column) -> Column:
    return F.get(F.split(F.trim(b), "\\n"), F.lit(0))


def is_section_heading(b: Column) -> Column:
    line = F.trim(first_line(b))
    return (F.length(line) <= 100) & ~line.rlike(CITATION_HINT) & line.rlike(SECTION_HEADING)


def is_prose(b: Column) -> Column:
    return (F.length(b) >= 300) & ~b.rlike(CITATION_HINT)


def page_skip_reason(needs_ocr: Column, emptied: Column, text: Column, lang: Column, legacy_font: Column) -> Column:
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(no(needs_ocr), "needs_ocr").when(no(emptied) | (F.coalesce(text, F.lit("")) == ""), "empty").when(lang == "other", "other_language").when(no(legacy_font), "legacy_font")


def repeated_edges(blocks: DataFrame, key: Column, least_pages: int = 4, part: float = 0.5) -> DataFrame:
    """doc, edge, n: keys of top and bottom blocks on at least 3 pages and `part` of a document's. blocks: doc, page, y0, y1, text."""
    keyed = blocks.withColumn("_key", key)
    edges = keyed.groupBy("doc", "page").agg(F.array_distinct(F.array(F.min_by("_key", "y0"), F.max_by("_key", "y1"))).alias("edges"))
    pages = edges.groupBy("doc").agg(F.count("*").alias("pages"))
    counted = edges.select("doc", F.explode("edges").alias("edge")).groupBy("doc", "edge").agg(F.count("*").alias("n"))
    enough = (F.col("pages") >= least_pages) & (F.col("n") >= F.greatest(F.lit(3.0), part * F.col("pages"))) & (F.col("edge") != "")
    return counted.join(pages, "doc").where(enough).select("doc", "edge", "n")


def without_edges(blocks: DataFrame, edges: DataFrame, key: Column) -> DataFrame:
    """Blocks that are neither a page number nor, wherever they stand, equal to a repeated edge."""
    kept = blocks.where(~F.col("text").rlike(PAGE_NUMBER)).withColumn("_key", key)
    return kept.join(edges.select("doc", F.col("edge").alias("_key")), ["doc", "_key"], "left_anti").drop("_key")


def strip_references(blocks: DataFrame) -> DataFrame:
    """Blocks outside reference lists. blocks: doc, page, seq, text; seq rises through the document.

    A list runs from a reference heading to the next section heading, or to the first of three prose blocks in a row;
    prose just before the end comes back, on the page of the block that ends the list.
    """
    doc = Window.partitionBy("doc").orderBy("seq")
    rows = blocks.withColumns({"_ref": first_line(F.col("text")).rlike(REFERENCE_HEADING), "_sec": is_section_heading(F.col("text")), "_prose": is_prose(F.col("text"))})
    rows = rows.withColumn("_kind", F.when(F.col("_ref"), "R").when(F.col("_sec"), "S").when(F.col("_prose"), "P").otherwise("C"))
    rows = rows.withColumn("_region", F.sum(F.when(F.col("_kind") == "R", 1).otherwise(0)).over(doc))
    inside = Window.partitionBy("doc", "_region").orderBy("seq")
    # Prose runs: numbered by the other blocks before them.
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_kind") != "P", 1).otherwise(0)).over(inside))
    run = Window.partitionBy("doc", "_region", "_run").orderBy("seq")
    rows = rows.withColumn("_nth", F.when(F.col("_kind") == "P", F.sum(F.when(F.col("_kind") == "P", 1).otherwise(0)).over(run)))
    stop = F.when((F.col("_kind") == "S") | (F.col("_nth") == 3), F.col("seq"))
    region = Window.partitionBy("doc", "_region")
    rows = rows.withColumn("_exit", F.min(stop).over(region))
    rows = rows.withColumn("_exit_page", F.min(F.when(F.col("seq") == F.col("_exit"), F.col("page"))).over(region))
    rows = rows.withColumn("_exit_run", F.max(F.when(F.col("seq") == F.col("_exit"), F.col("_run") - F.when(F.col("_kind") == "P", 0).otherwise(1))).over(region))
    free = (F.col("_region") == 0) | (F.col("seq") >= F.col("_exit"))
    back = (F.col("_kind") == "P") & (F.col("seq") < F.col("_exit")) & (F.col("_run") == F.col("_exit_run"))
    kept = rows.where(F.coalesce(free | back, F.lit(False)))
    page = F.when((F.col("_region") > 0) & (F.col("seq") < F.col("_exit")), F.col("_exit_page")).otherwise(F.col("page"))
    return kept.select("doc", page.alias("page"), "seq", "text")


def sections(paragraphs: DataFrame, cap: int = 4000) -> DataFrame:
    """doc, seq, text, section, segment of the paragraphs to keep. paragraphs: doc, seq, text.

    A heading of level L ends the headings of level L and below; the path joins those in force. A skip heading drops
    what follows until the next heading, or until more than `cap` characters were dropped: the paragraph that crosses
    the cap is kept. Table-of-contents lines go as well.
    """
    doc = Window.partitionBy("doc").orderBy("seq")
    text = F.col("text")
    skip = (F.length(text) <= 100) & text.rlike(SKIP_SECTION)
    rows = paragraphs.withColumn("_skip", skip).withColumn("_head", ~skip & is_heading(text))
    rows = rows.withColumn("_level", F.when(F.col("_head"), heading_level(text)))
    path = []
    for k in range(1, 5):
        at = F.last(F.when(F.col("_level") == k, F.col("seq")), ignorenulls=True).over(doc)
        above = F.last(F.when(F.col("_level") < k, F.col("seq")), ignorenulls=True).over(doc)
        title = F.last(F.when(F.col("_level") == k, text), ignorenulls=True).over(doc)
        path.append(F.when(at.isNotNull() & (above.isNull() | (at > above)), title))
    rows = rows.withColumn("section", F.concat_ws(" > ", *path))
    rows = rows.withColumn("segment", F.sum(F.col("_head").cast("int")).over(doc).cast("long"))
    rows = rows.withColumn("_group", F.sum((F.col("_skip") | F.col("_head")).cast("int")).over(doc))
    group = Window.partitionBy("doc", "_group").orderBy("seq")
    dropped = F.max(F.col("_skip")).over(Window.partitionBy("doc", "_group"))
    size = F.when(F.col("_skip") | F.col("_head"), 0).otherwise(F.length(text))
    rows = rows.withColumn("_gone", dropped & (F.sum(size).over(group) <= cap))
    toc = text.rlike(TOC_ENTRY) & (F.length(text) < 400)
    return rows.where(~F.col("_skip") & ~F.col("_head") & ~F.col("_gone") & ~toc).select("doc", "seq", "text", "section", "segment")


def char_windows(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Overlapping pieces of `size` characters; none for empty text."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))


def within_budget(rows: DataFrame, by: str, rank: str, size: Column, budget: int, parts: int = 64) -> DataFrame:
    """Rows of each `by` in rank order until the first that would exceed the budget; the first row is always taken.

    A row that exceeds the budget among some of the rows before it does so among all of them. So a `by` is dealt into parts
    first, whose own running sums leave few rows, and those alone meet in one place.
    """
    part = F.pmod(F.xxhash64(rank), F.lit(parts))
    for w in (Window.partitionBy(by, "_part").orderBy(rank), Window.partitionBy(by).orderBy(rank)):
        used = F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))
        if "_part" not in rows.columns:
            rows = rows.withColumns({"_part": part, "_size": size})
        rows = rows.withColumns({"_used": used, "_n": F.row_number().over(w)}).where((F.col("_n") == 1) | (F.col("_used") <= budget)).drop("_used", "_n")
    return rows.drop("_part", "_size")


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """chunks, mean, median (place n // 2), p95 (place int(0.95 n)) and max of a column, places from 0 in rising order.

    Values are counted first, and places read off the running sum over distinct values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"_to": F.sum("n").over(w), "_all": F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    at = lambda place: F.min(F.when(F.col("_to") > place, F.col("v")))
    return placed.agg(
        F.sum("n").alias("chunks"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("mean_tokens"),
        at(F.floor(F.col("_all") / 2)).cast("long").alias("median_tokens"), at(F.floor(F.col("_all") * 0.95)).cast("long").alias("p95_tokens"), F.max("v").cast("long").alias("max_tokens"),
    )
