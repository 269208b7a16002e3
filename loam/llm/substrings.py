"""Substring dedup: removal of words in windows that also stand elsewhere, by FM-indexes over shards.

Windows are routed so that equal ones meet: a window's anchor is the place of its least-hashed run of `gram` words, the
first of several. Neighbouring windows share their anchor, so a document's windows fall into runs, and the words of a run
make a region; each window lies in one region. Anchors are counted over all documents. Regions whose anchor occurs once
can have no equal window and stay at home; a filter of fixed size holds the rest.

Of the places of one region the one with the smallest hash is its owner, found by a minimum that is aggregated before it
is shuffled; owners alone send their words, so a passage that stands in every document travels once. Regions go to shards
by their anchor's hash. A shard builds a compressed FM-index of its regions, and streams them against it: backward search
over the wavelet matrix gives the matching statistic at each window's end, and those that reach the window's length with
two places or more are reported as intervals. Regions that have the same words count as such places too; their number is
summed before it is shuffled.

An anchor with more than `hot` places sends its windows singly, by their own hash, so that they spread over the shards,
and equal ones are one row there.

Documents with the same words are copies: all of their words go, if they have a window at all. A task streams one copy.
Sequences that a thousandth of all rows or more share are at most a thousand; they are told apart by a broadcast and
don't take part in the join that the others need.

Nulls and edges: a null or empty text has no words: none removed, and the hash is that of the empty string. Texts of
fewer words than a window lose nothing. Rows of one doc_id and other words are documents of their own. Rows with a
null doc_id count as places, and lose words only as copies. Words are
compared by 64-bit hashes. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .sketches import Filter
from .storage import scratch, shared, written
from .words import _DOWN, _UP, SPACED, U64, Words, chunks, give_back, mix, per_text, rolling, words


@dataclass(frozen=True)
class SubstringConfig:
    window: int = 35
    gram: int = 8
    hot: int = 20_000
    regions_a_shard: int = 4_000


def _spans(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word runs begin to end."""
    total = np.zeros(len(code) + 1, U64)
    np.cumsum(code * _UP.upto(len(code)), out=total[1:])
    return mix(mix((total[end] - total[begin]) * _DOWN.upto(len(code) + 1)[begin]) + (end - begin).astype(U64))


def sequences(found: Words) -> np.ndarray:
    """Hash of each text's whole word sequence, as signed numbers."""
    return _spans(found.hash, found.first[:-1], found.first[1:]).view(np.int64)


def first_least(order: np.ndarray, wide: int) -> np.ndarray:
    """Place of the first smallest of each `wide` consecutive numbers, from those of half as many."""
    value, at, size = order, np.arange(len(order)), 1

    def joined(by: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        later = value[by : by + n] < value[:n]
        return np.where(later, value[by : by + n], value[:n]), np.where(later, at[by : by + n], at[:n])

    while 2 * size <= wide:
        value, at = joined(size, len(value) - size)
        size *= 2
    return joined(wide - size, len(order) - wide + 1)[1]


def runs(found: Words, config: SubstringConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window's start in the buffer's words, number of windows, anchor) of each run of windows."""
    size, wide = config.window, config.window - config.gram + 1
    none = np.empty(0, np.int64)
    if len(found.hash) < size:
        return none, none, none, none
    order = rolling(found.hash, config.gram)
    text = per_text(found.first)
    start = np.flatnonzero(found.first[text[: len(text) - size + 1] + 1] - np.arange(len(text) - size + 1) >= size)
    if not len(start):
        return none, none, none, none
    at = first_least(order, wide)[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(start)))
    return text[start[head]], start[head], many, order[at[head]].view(np.int64)


class _Once:
    """Tells texts whose sequence this task hasn't met; it forgets them all after a million."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def new(self, names: np.ndarray) -> np.ndarray:
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        out = np.zeros(len(names), bool)
        for i, x in enumerate(names.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _ids(batch: pa.RecordBatch, at: slice) -> pa.Array:
    return batch.column("doc_id").slice(at.start, at.stop - at.start)


def sequences_of(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, seq (hash of the words), n_words, whole (SHA-256 of all words joined by a space), with texts also that text."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in chunks(batch, "text"):
                found = words(held, SPACED)
                plain = [b" ".join(x.split()) for x in held]
                columns = [_ids(batch, at), pa.array(sequences(found)), pa.array(np.diff(found.first)), pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string())]
                if texts:
                    columns.append(pa.array([x.decode() for x in plain], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seq", "n_words", "whole", "whole_text"][: len(columns)])

    return docs.mapInArrow(told, "doc_id long, seq long, n_words long, whole string" + ", whole_text string" * texts)


def anchors(docs: DataFrame, config: SubstringConfig) -> DataFrame:
    """anchor of each run of windows of each distinct document of a task."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                found = words(texts, SPACED)
                text, _, _, anchor = runs(found, config)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[once.new(sequences(found))[text]])], ["anchor"])

    return docs.mapInArrow(told, "anchor long")


def _names(region: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """A hash of a region at one of its places (the document's sequence)."""
    return mix(region.view(U64) ^ mix(seq.view(U64) + U64(0x9E3779B97F4A7C15))).view(np.int64)


def regions(docs: DataFrame, again: Filter, hot: Filter, config: SubstringConfig, owners: Filter | None = None) -> DataFrame:
    """Regions of repeated anchors: doc_id, seq, start, many, region, owner; or with owners: route, region, many, codes of those that own them."""
    known = shared(docs.sparkSession, (again, hot, owners))
    size = config.window

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, busy, own = known.value
        once, given = _Once(), _Once()
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                found = words(texts, SPACED)
                seq = sequences(found)
                text, start, many, anchor = runs(found, config)
                keep = once.new(seq)[text]
                keep &= repeated.has(anchor)
                text, start, many, anchor = text[keep], start[keep], many[keep], anchor[keep]
                if not len(text):
                    continue
                single = busy.has(anchor)
                if single.any():  # windows of hot anchors are regions of their own
                    times = np.where(single, many, 1)
                    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    text, start, many, anchor, single = (np.repeat(x, times) for x in (text, start, many, anchor, single))
                    start = start + inner
                    many = np.where(single, 1, many)
                end = start + many + size - 1
                region = _spans(found.hash, start, end).view(np.int64)
                owner = _names(region, seq[text])
                if own is not None:
                    mine = np.flatnonzero(own.has(owner))
                    fresh = mine[given.new(region[mine])]
                    if not len(fresh):
                        continue
                    codes = [found.hash[start[i] : end[i]].tobytes() for i in fresh]
                    route = np.where(single, region, anchor)[fresh]
                    columns = [pa.array(route), pa.array(region[fresh]), pa.array(many[fresh].astype(np.int32)), pa.array(codes, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["route", "region", "many", "codes"])
                else:
                    ids = _ids(batch, at).take(pa.array(text))
                    local = (start - found.first[text]).astype(np.int32)
                    columns = [ids, pa.array(seq[text]), pa.array(local), pa.array(many.astype(np.int32)), pa.array(region), pa.array(owner)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seq", "start", "many", "region", "owner"])

    return docs.mapInArrow(told, "route long, region long, many int, codes binary" if owners is not None else "doc_id long, seq long, start int, many int, region long, owner long")


def _reported(table: pa.Table, size: int) -> pa.Table:
    """region, mask: a shard's regions and their windows (bit i: the i-th) that have another place in the shard."""
    names, at = np.unique(table["region"].to_numpy(), return_index=True)
    many = table["many"].to_numpy()[at]
    codes = [np.frombuffer(table["codes"][int(i)].as_py(), U64) for i in at]
    flat = np.concatenate(codes)
    alphabet, dense = np.unique(flat, return_inverse=True)
    length = np.array([len(x) for x in codes])
    first = np.cumsum(length) - length
    index = FMIndex([dense[a : a + n] for a, n in zip(first, length, strict=True)], len(alphabet))
    owner = np.repeat(np.arange(len(names)), many)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    # What all windows of a region share must have two places before any window of it is looked up.
    core = index.statistics(dense, first + size, size, 2)
    overlap = size - many + 1
    asked = np.flatnonzero((core >= overlap)[owner])
    found = index.statistics(dense, first[owner[asked]] + inner[asked] + size, size, 2) >= size
    mask = np.zeros(len(names), np.int64)
    np.bitwise_or.at(mask, owner[asked[found]], np.int64(1) << inner[asked[found]])
    some = np.flatnonzero(mask)
    give_back()
    return pa.table({"region": names[some], "mask": mask[some]})


def _kept(text: bytes, starts: list[int], size: int) -> tuple[int, bytes]:
    """Number of words that the windows from starts cover, and the others joined by a space."""
    own = text.split()
    step = np.zeros(len(own) + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    step[at] += 1
    np.subtract.at(step, np.minimum(at + size, len(own)), 1)
    gone = np.cumsum(step)[:-1] > 0
    return int(gone.sum()), b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g)


def repeated_windows(docs: DataFrame, config: SubstringConfig) -> DataFrame:
    """doc_id, seq, starts (array of struct start, mask): windows of a document that stand elsewhere, copies apart."""
    counted = written(anchors(docs, config).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "substrings-anchors")
    again, hot = Filter.of(counted, "anchor"), Filter.of(counted.where(F.col("n") > config.hot), "anchor")
    places = written(regions(docs, again, hot, config), "substrings-places")
    listed = written(places.groupBy("region").agg(F.min("owner").alias("owner"), F.count("*").alias("n")), "substrings-regions")
    bodies = regions(docs, again, hot, config, Filter.of(listed, "owner"))
    shards = max(1, -(-listed.count() // config.regions_a_shard))
    size = config.window
    sharded = bodies.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    reports = sharded.groupBy("shard").applyInArrow(lambda t: _reported(t, size), "region long, mask long")
    reports = written(reports, "substrings-reports")
    same = listed.where("n > 1").select("region", F.lit(True).alias("same"))
    hits = written(same.join(reports, "region", "full_outer"), "substrings-hits")
    every = F.expr("shiftleft(1L, many) - 1")
    hit = places.join(hits, "region").select("doc_id", "seq", "start", F.when(F.col("same"), every).otherwise(F.col("mask")).alias("mask"))
    return hit.groupBy("doc_id", "seq").agg(F.collect_list(F.struct("start", "mask")).alias("starts"))


def dedupe(docs: DataFrame, config: SubstringConfig | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document; with texts also kept_text, the words that stay joined by a space."""
    config = config or SubstringConfig()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with scratch(docs.sparkSession) as own:
        with scratch(docs.sparkSession) as inner:
            hits = written(repeated_windows(docs, config), "substrings-windows")
            inner.keep(hits)
        done = written(_cut(docs, hits, config.window, texts), "substrings-cut")
        listed = written(sequences_of(docs, texts), "substrings-sequences")
        counted = listed.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1")
        copies = written(counted.select("seq", "n", F.lit(True).alias("copied")), "substrings-copies")
        own.keep(done, listed, copies)
    # Sequences of a thousandth of all rows: a thousand at most.
    hot = copies.where(F.col("n") * 1000 >= listed.count())
    busy = listed.join(F.broadcast(hot.select("seq", "copied")), "seq")
    rest = listed.join(F.broadcast(hot.select("seq")), "seq", "left_anti").join(copies.select("seq", "copied"), "seq", "left")
    joined = busy.unionByName(rest).join(done, ["doc_id", "seq"], "left")
    copied = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= config.window)
    removed = F.when(copied, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    kept = F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole"))
    more = [F.when(copied, "").otherwise(F.coalesce("kept_text", "whole_text")).alias("kept_text")] * texts
    return joined.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"), *more)


def _cut(docs: DataFrame, hits: DataFrame, size: int, with_text: bool) -> DataFrame:
    """doc_id, seq, removed (words), kept (SHA-256 of the others), with_text also those, of the documents with windows that stand elsewhere."""
    only = shared(docs.sparkSession, Filter.of(hits, "seq"))

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                seq = sequences(words(texts, SPACED))
                keep = np.flatnonzero(only.value.has(seq))
                yield pa.RecordBatch.from_arrays([_ids(batch, at).take(pa.array(keep)), pa.array(seq[keep]), pa.array([texts[i] for i in keep], pa.binary())], ["doc_id", "seq", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                rows.append(_kept(text, [x["start"] + i for x in starts for i in range(x["mask"].bit_length()) if x["mask"] >> i & 1], size))
            columns = [batch.column("doc_id"), batch.column("seq"), pa.array([x for x, _ in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, x in rows], pa.string())]
            if with_text:
                columns.append(pa.array([x.decode() for _, x in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seq", "removed", "kept", "kept_text"][: len(columns)])

    texts = docs.mapInArrow(texts_of, "doc_id long, seq long, text binary")
    return texts.join(hits, ["doc_id", "seq"]).mapInArrow(cut, "doc_id long, seq long, removed long, kept string" + ", kept_text string" * with_text).dropDuplicates(["doc_id", "seq"])
