"""Benchmark decontamination: a prefix-filtered join of document shingles with benchmark windows, in DataFrame operations.

Each benchmark item gives its windows of `window` consecutive words (an item of fewer words is one window). A window's
shingles are its runs of three words (of all its words, if it has fewer than three). A document that holds the window
holds all of them, the rarest included; so that one, the window's necessary prefix, is enough to find candidates.
Rarity is the number of a shingle's places in all documents, counted in full.

Each place of a document is joined with the prefixes on the shingle's hash. The place and the shingle's offset in the
window fix where the window would have to begin: the positional bound says that this isn't before the text, the length
bound that the window ends within it. What is left is verified word by word, so hash collisions don't matter.

The prefix table is broadcast only if it has at most `broadcast_windows` rows; beyond that the join is a shuffle join,
where a hot shingle's rows can be split by Spark, and a place carries the words around it. Documents are never shuffled.

Nulls and edges: null texts and items have no words. Items with a null id are left out. Equal windows of several items
count for each of them, once. Rows that agree in doc_id and text get the same result each; rows with the same doc_id and
other texts are documents of their own. Without benchmark rows no document is hit. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_list(text: Column) -> Column:
    """Words of the text with A-Z lowered; none for null."""
    low = F.translate(text, _UPPER, _UPPER.lower())
    # Splitting takes a tenth of the time that collecting all matches of the words takes.
    return F.coalesce(F.array_remove(F.split(low, _BETWEEN, -1), ""), F.array().cast("array<string>"))


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from the place `at` (from 0)."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """win_id, win (its words) and item_id of each window of each item."""
    items = benchmark.where("item_id is not null").select("item_id", word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    cut = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    wins = cut.select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("win"))
    return wins.select(F.xxhash64("win").alias("win_id"), "win", "item_id").distinct()


def _places(docs: DataFrame, size: int) -> DataFrame:
    """key, words, pos, shingle of each place of each document where `size` words stand."""
    listed = docs.select("_key", word_list(F.col("text")).alias("words"))
    opened = listed.select("_key", "words", F.posexplode("words").alias("pos", "_word"))
    opened = opened.where(F.col("pos") + size <= F.size("words"))
    return opened.select("_key", "words", "pos", _shingle(F.col("words"), F.col("pos"), size).alias("shingle"))


def _small(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _counted(docs: DataFrame, shingles: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """shingle and its number of places in docs, for the shingles that have any."""
    wanted = F.broadcast(shingles) if _small(shingles, most) else shingles.hint("merge")
    parts = [_places(docs, s).select("shingle").join(wanted, "shingle") for s in sizes]
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.groupBy("shingle").agg(F.count("*").alias("places"))


def prefixes(docs: DataFrame, wins: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """shingle (the rarest of its window), candidates (array of off, win) in groups of 16 at most."""
    only = wins.select("win_id", "win").distinct()
    parts = []
    for s in sizes:
        fits = F.least(F.size("win"), F.lit(3)) == s
        at = only.where(fits).select("win_id", "win", F.explode(F.sequence(F.lit(0), F.size("win") - s)).alias("off"))
        parts.append(at.select("win_id", "win", "off", _shingle(F.col("win"), F.col("off"), s).alias("shingle")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    every = written(every, "decontamination-shingles")
    places = written(_counted(docs, every.select("shingle").distinct(), sizes, most), "decontamination-places")
    ranked = every.join(places, "shingle", "left").fillna(0, ["places"])
    rarest = ranked.groupBy("win_id", "win").agg(F.min(F.struct("places", "shingle", "off")).alias("best"))
    rows = rarest.where("best.places > 0").select("best.shingle", "best.off", "win_id", "win")
    part = (F.row_number().over(Window.partitionBy("shingle").orderBy("win_id", "off")) / 16).cast("int")
    return rows.withColumn("_part", part).groupBy("shingle", "_part").agg(F.collect_list(F.struct("off", "win")).alias("candidates")).drop("_part")


def hits(docs: DataFrame, wins: DataFrame, window: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """_key, start, size, win of each place of docs (with a column _key) where a window stands in full."""
    sizes = sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(3))).distinct().collect())
    if not sizes:
        empty = docs.select("_key").where("false")
        return empty.selectExpr("_key", "0 AS start", "0 AS size", "array('') AS win")
    table = written(prefixes(docs, wins, sizes, broadcast_windows), "decontamination-prefixes")
    small = _small(table, broadcast_windows)
    found = []
    for s in sizes:
        at = _places(docs, s)
        if small:  # the words stay where they are; only joined places look at them
            joined = at.withColumn("base", F.lit(0)).join(F.broadcast(table), "shingle")
        else:
            base = F.greatest(F.col("pos") - window, F.lit(0))
            near = at.withColumn("base", base).withColumn("words", F.slice("words", F.col("base") + 1, F.lit(2 * window)))
            joined = near.join(table.hint("merge"), "shingle")
        pos, base, own = F.col("pos"), F.col("base"), F.col("words")
        stands = F.filter("candidates", lambda c: (pos >= c.off) & F.when(pos >= c.off, F.slice(own, pos - c.off - base + 1, F.size(c.win)) == c.win))  # noqa: B023
        found.append(joined.select("_key", "pos", F.explode(stands).alias("c")).select("_key", (F.col("pos") - F.col("c.off")).alias("start"), F.size("c.win").alias("size"), "c.win"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def keyed(docs: DataFrame) -> DataFrame:
    """_key, text, doc_id; rows that agree in doc_id and text share a key."""
    return docs.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("h")).alias("_key"), "text", "doc_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    rows = keyed(docs)
    wins = written(windows_of(benchmark, window), "decontamination-windows")
    found = written(hits(rows, wins, window, broadcast_windows), "decontamination-hits")
    spans = found.groupBy("_key", "start").agg(F.max("size").alias("size"))
    reach = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("size") - F.greatest("start", F.coalesce(reach, F.lit(0)))
    covered = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("_key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = found.select("_key", "win").distinct().join(wins.select("win", F.col("item_id").cast("string").alias("item")), "win")
    items = items.groupBy("_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = items.select("_key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    result = covered.join(told, "_key")
    size = F.size(word_list(F.col("text"))).cast("long")
    joined = rows.select("_key", "doc_id", size.alias("n_words")).join(result, "_key", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_windows: int = 200_000) -> DataFrame:
    """The rows of docs, with all their columns, in which no window stands."""
    rows = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("h")))
    wins = written(windows_of(benchmark, window), "decontamination-windows")
    found = written(hits(rows, wins, window, broadcast_windows).select("_key").distinct(), "decontamination-hit-docs")
    return rows.join(found, rows["_key"].eqNullSafe(found["_key"]), "left_anti").drop("_key")
