"""Exact top-k search by inner product over integer vectors.

Vectors are turned by an orthogonal matrix, the eigenvectors of the sum of all outer products, so that the first few
components hold most of each vector's length. Candidates are dealt into bands by length, bounds of which are quantiles
of all lengths, and bands into blocks of bounded size. The longest band comes first: each query meets its blocks, and its
k-th best score there is a floor. Of the other bands a query visits only those whose longest vector can still reach that
floor, and only blocks and queries that visit each other travel.

Within a block a query looks at vectors by descending length and stops where |q| |x| can't reach its k-th best score.
Before that, the partial sum over the first turned components plus |rest of q| |rest of x| (Cauchy-Schwarz) bounds each
product; only products whose bound can reach the k-th best are made in full, from the integers themselves.

A task holds one block of candidates and one of queries, both of bounded size. The queries are a stated set, so blocks
of them meet blocks of all vectors; what leaves a task is at most k rows of each query.

Nulls and edges: vectors that are null, or hold a null or a component that isn't finite, take no part, nor do rows with
a null id. Shorter vectors count as if filled up with zeros; an empty vector is the zero vector. Ties go to the smaller
id. Rows of one id are candidates each; none of them is a candidate of a query of that id, and a query id with several
vectors gives no more than k ranks, over all its vectors. Where sums of products may pass 2 ** 53 they are made of Python
integers; a score beyond a long becomes the nearest long. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch, written

#: Up to this size sums of products are exact in doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def as_integers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, vector (floor(scale * x) of each component, as double), dim, norm2 of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.lit(scale) * x.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    # floor() of a double is a long in Spark; beyond its range the double is whole already
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("vec_id", "vector", F.size("vector").alias("dim"), norm2.alias("norm2"))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products of all vectors, the largest first. Each task sends dim * dim sums."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    rows = vectors.select("vector").mapInArrow(summed, "i long, sums array<double>")
    cells = rows.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dim, dim))
    for r in cells:
        gram[r.i, r.j] = r.x
    size = np.abs(gram).max(initial=0.0)
    if not 0 < size < np.inf:
        return np.eye(dim)
    return np.linalg.eigh((gram + gram.T) / (2 * size))[1][:, ::-1]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out, row = np.zeros((len(size), dim)), np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether doubles hold all sums of products of rows of q and x."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < _EXACT


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products of whole numbers, exact; object numbers if doubles can't hold them."""
    if _fits(q, x):
        return np.einsum("ij,ij->i", q, x)
    return np.array([max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], object)


def block_top(queries: np.ndarray, qid: np.ndarray, items: np.ndarray, iid: np.ndarray, turn: np.ndarray, k: int, head: int, step: int = 1024, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, item id, score) of at least those of each query's k best items of this block that reach its floor."""
    order = np.argsort(-np.einsum("ij,ij->i", items, items), kind="stable")
    items, iid = items[order], iid[order]
    q_turned, x_turned = queries @ turn, items @ turn
    q_len, x_len = np.sqrt((queries**2).sum(1)), np.sqrt((items**2).sum(1))
    q_rest = np.sqrt((q_turned[:, head:] ** 2).sum(1))
    x_rest = np.sqrt((x_turned[:, head:] ** 2).sum(1))
    slack = 1e-9 * (1 + q_len)
    least = np.full(len(queries), -np.inf) if floor is None else floor.copy()
    small = _fits(queries, items)
    held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for begin in range(0, len(items), step):
        part = slice(begin, begin + step)
        live = np.flatnonzero(q_len * x_len[begin] + slack * (1 + x_len[begin]) >= least)
        if not len(live):
            break
        bound = q_turned[live, :head] @ x_turned[part, :head].T + np.outer(q_rest[live], x_rest[part])
        bound += np.outer(slack[live], 1 + x_len[part])
        may = (bound >= least[live][:, None]) & (qid[live][:, None] != iid[part][None, :])
        if small and may.mean() > 0.02:  # so many that one matrix product is cheaper; doubles hold it exactly
            full = np.where(may, queries[live] @ items[part].T, -np.inf)
            if full.shape[1] > k:
                kth = np.partition(full, -k, axis=1)[:, -k]
                may &= full >= kth[:, None]
            a, b = np.nonzero(may)
            score = full[a, b]
        else:
            a, b = np.nonzero(may)
            score = np.concatenate([np.empty(0), *(_products(queries[live[a[i : i + 65536]]], items[begin + b[i : i + 65536]]) for i in range(0, len(a), 65536))])
        if not len(a):
            continue
        number, item = live[a], begin + b
        number, ids, score = np.append(held[0], number), np.append(held[1], iid[item]), np.append(held[2], score)
        rank = np.lexsort((ids, -score, number))
        number, ids, score = number[rank], ids[rank], score[rank]
        place = np.arange(len(number)) - np.searchsorted(number, number)
        keep = place < k
        held = number[keep], ids[keep], score[keep]
        last = place == k - 1
        least[number[last]] = np.maximum(least[number[last]], score[last].astype(float))
    return held


def bands(rows: DataFrame, n: int, items_a_block: int, most: int = 64) -> DataFrame:
    """band (from 0, the longest), longest (its largest squared length), n, blocks; at most `most` rows."""
    many = min(most, -(-n // items_a_block))
    marks = rows.agg(F.percentile_approx("norm2", [1 - (i + 1) / many for i in range(many - 1)], 10_000).alias("marks")).first().marks if many > 1 else []
    marks = [x for x in dict.fromkeys(marks or []) if x is not None]
    number = sum((F.when(F.col("norm2") < x, 1).otherwise(0) for x in marks), F.lit(0)).cast("int")
    counted = rows.withColumn("band", number).groupBy("band").agg(F.max("norm2").alias("longest"), F.count("*").alias("n"), F.min("norm2").alias("shortest"))
    return counted.withColumn("blocks", F.ceil(F.col("n") / items_a_block).cast("int"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, head: int = 16, items_a_block: int = 16384, queries_a_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products."""
    spark = vectors.sparkSession
    with scratch(spark) as own:
        rows = written(as_integers(vectors, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False))), "topk-vectors")
        told = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max("dim").alias("dim")).first()
        dim = max(told.dim or 1, 1)
        turn = rotation(rows, dim)
        across = -(-told.q // queries_a_block) or 1
        band = written(bands(rows, told.n, items_a_block), "topk-bands")
        # A vector's band is the one whose lengths hold its own; its block there is dealt by its id.
        inside = (F.col("norm2") <= F.col("longest")) & (F.col("norm2") >= F.col("shortest"))
        items = rows.join(F.broadcast(band), inside).select("band", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "vector")
        asked = rows.where("is_query").select("vec_id", "vector", "norm2", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int").alias("h"))

        def top(left: pa.Table, right: pa.Table) -> pa.Table:
            q, x = _matrix(left["vector"].combine_chunks(), dim), _matrix(right["item"].combine_chunks(), dim)
            qid, iid = left["vec_id"].to_numpy(), right["item_id"].to_numpy()
            number, ids, score = block_top(q, qid, x, iid, turn, k, min(head, dim), floor=left["floor"].to_numpy())
            return pa.table({"query_id": qid[number], "vec_id": ids.astype(np.int64), "score": score.astype(np.int64)})

        cell = F.concat_ws("/", "band", "block", "h")

        def met(queries: DataFrame, blocks: DataFrame, reaches: Column, name: str) -> DataFrame:
            """query_id, vec_id, score of the blocks that queries (vec_id, vector, norm2, h, floor) visit."""
            seen = queries.join(F.broadcast(blocks), reaches)
            cells = written(seen.select("band", "h").distinct(), "topk-cells")
            visits = seen.select("vec_id", "vector", "h", "floor", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            visits = visits.select(cell.alias("cell"), "vec_id", "vector", "floor")
            there = items.join(cells, "band").select(cell.alias("cell"), F.col("vec_id").alias("item_id"), F.col("vector").alias("item"))
            pairs = visits.groupBy("cell").cogroup(there.groupBy("cell"))
            return written(pairs.applyInArrow(top, "query_id long, vec_id long, score long"), name)

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        first = met(asked.withColumn("floor", F.lit(float("-inf"))), band.where("band = 0"), F.lit(True), "topk-first")
        if band.where("band > 0").isEmpty():
            found = first
        else:
            kth = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
            known = asked.join(kth, "vec_id", "left").fillna(float("-inf"), ["floor"])
            # Lengths are rounded; a part in 10 ** 9 more is let through.
            reaches = F.sqrt(F.col("norm2")) * F.sqrt(F.col("longest")) * (1 + 1e-9) + 1e-9 >= F.col("floor")
            found = first.unionByName(met(known, band.where("band > 0"), reaches, "topk-rest"))
        best = written(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk-best")
        own.keep(best)
    return best
