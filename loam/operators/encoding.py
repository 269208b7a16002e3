"""Vectors of texts: an encoder as an Arrow function, loaded once for each worker, and incremental runs over chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import text_hash

#: Makes an encoder: a function from a list of texts to a matrix with a row for each.
Loader = Callable[[], Callable[[list[str]], np.ndarray]]


def passage(text: Column) -> Column:
    """A text as models of the E5 family want it indexed."""
    return F.concat(F.lit("passage: "), text)


def asked(text: Column) -> Column:
    """A question as models of the E5 family want it."""
    return F.concat(F.lit("query: "), text)


def hashing_encoder(dim: int = 64) -> Loader:
    """A deterministic encoder without a model, for tests: signed counts of hashed words."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                    out[i, code % dim] += 1 if code >> 63 else -1
            return out

        return encode

    return load


def halving(encode: Callable[[list[str]], np.ndarray], texts: list[str], batch: int) -> np.ndarray:
    """Vectors in batches; a batch for which memory lacks is tried again in halves, down to one text."""
    out, at = [], 0
    while at < len(texts):
        try:
            out.append(np.asarray(encode(texts[at : at + batch]), float))
            at += batch
        except MemoryError:
            if batch == 1:
                raise
            batch = max(1, batch // 2)
    return np.concatenate(out) if out else np.zeros((0, 0))


def encoded(rows: DataFrame, text: str, loader: Loader, batch: int = 16, as_: str = "vector") -> DataFrame:
    """rows with a column of vectors of length 1; null texts are empty. The encoder is loaded once for each task."""
    kind = "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loader()
        for b in batches:
            found = halving(encode, [x or "" for x in b.column(text).to_pylist()], batch)
            norm = np.linalg.norm(found, axis=1, keepdims=True) if len(found) else np.ones((0, 1))
            vectors = pa.array(list(found / np.where(norm > 0, norm, 1)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], [*b.schema.names, as_])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{as_}` {kind}"])
    return rows.mapInArrow(run, schema)


def incremental(chunks: DataFrame, cache: DataFrame | None, loader: Loader, *within: str) -> DataFrame:
    """chunk_id, within, text_hash, vector, reused of chunks (chunk_id, embed_text, within): vectors of equal texts are taken
    from the cache (within, text_hash, chunk_id, vector), the other distinct texts are encoded, each once."""
    keys = [*within, "text_hash"]
    rows = chunks.select("chunk_id", *within, text_hash(F.col("embed_text")).alias("text_hash"), "embed_text")
    if cache is not None:
        rows = rows.join(cache.groupBy(*keys).agg(F.max_by("vector", "chunk_id").alias("vector")), keys, "left")
    else:
        rows = rows.withColumn("vector", F.lit(None).cast("array<double>"))
    known = rows.where("vector is not null").drop("embed_text").withColumn("reused", F.lit(True))
    missing = rows.where("vector is null").drop("vector")
    once = missing.groupBy(*keys).agg(F.min("embed_text").alias("embed_text"))
    made = encoded(once, "embed_text", loader).drop("embed_text")
    return known.unionByName(missing.drop("embed_text").join(made, keys).withColumn("reused", F.lit(False))).select("chunk_id", *within, "text_hash", "vector", "reused")


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with their vector and whether it is missing."""
    joined = chunks.join(vectors.select(key, "vector"), key, "left")
    return joined.withColumn("missing", F.col("vector").isNull())


def zipped(shards: DataFrame, *columns: str) -> DataFrame:
    """A row for each place of a shard's parallel arrays; an error if their lengths differ."""
    sizes = [F.size(c) for c in columns]
    equal = F.greatest(*sizes) == F.least(*sizes) if len(sizes) > 1 else F.lit(True)
    checked = F.when(equal, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("parallel arrays of a shard differ in length")))
    rest = [c for c in shards.columns if c not in columns]
    return shards.select(*rest, F.posexplode(checked).alias("place", "_z")).select(*rest, "place", *(F.col("_z")[c].alias(c) for c in columns))


def orphans(embedded: DataFrame, chunked: DataFrame, key: str) -> DataFrame:
    """Folders with vectors for which there are no chunks."""
    return embedded.select(key).distinct().join(chunked.select(key), key, "left_anti")


def exact_tokens(rows: DataFrame, text: str, path: str, as_: str = "tokens") -> DataFrame:
    """rows with the number of tokens of a text, by the tokenizer file (tokenizers' JSON) at path, loaded once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for b in batches:
            found = tokenizer.encode_batch([x or "" for x in b.column(text).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x.ids) for x in found], pa.int64())], [*b.schema.names, as_])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{as_}` long"])
    return rows.mapInArrow(run, schema)
