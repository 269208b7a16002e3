"""Toxicity: a factorization machine over hashed terms.

The score of a text is sigmoid(b + sum w[t] + sum over pairs of its terms <v[t], v[u]>), so that a pair such as an
insult with the mention of a group has a weight of its own, which no sum of single weights can give. A text's terms
are its distinct words (A-Z lowered), hashed into 2 ** bits buckets.

The model is fitted on a bounded sample: at most `per_class` labelled texts of each class, the first in the order of a
hash of their ids, and of an id's texts the one with the smallest hash. Each class is counted over all training labels, and a sampled text weighs as much in the loss as the
labels of its class that it stands for, so the threshold means the same at every size. The model's terms are those that
stand in at least `least_docs` texts of that sample. Everything else covers all rows: the sample is drawn from the
documents by all tasks and written, and only the fitting, on that small table, is one task's work.

Nulls and edges: a null text is empty; an empty text's score is sigmoid(b). Rows without an id or with a null label are
not learnt from; where an id has several labels, the largest counts. Repeated documents are scored each for itself.
Without any label, or with labels of one class only, each score is the rate of that class (0 without labels). Other
columns are ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import scratch, shared, written
from .words import ALNUM_LOWER, U64, chunks, per_text, words


@dataclass(frozen=True)
class ToxicityConfig:
    bits: int = 20
    factors: int = 4
    per_class: int = 6000
    least_docs: int = 4
    epochs: int = 8
    least_steps: int = 800
    batch: int = 128
    rate: float = 0.08
    l1: float = 2e-4
    l2: float = 2e-4
    seed: int = 11


@dataclass
class Machine:
    """bias, weights and factors of the terms `known` (sorted bucket numbers)."""

    bias: float
    known: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Log-odds of `rows` texts; text row[i] has the known term number term[i]."""
        total = np.bincount(row, self.weight[term], rows) + self.bias
        for v in self.factor.T:
            own = v[term]
            total += 0.5 * (np.bincount(row, own, rows) ** 2 - np.bincount(row, own * own, rows))
        return total

    def scores(self, texts: list[bytes], bits: int) -> np.ndarray:
        row, bucket = distinct_terms(texts, bits)
        at = np.searchsorted(self.known, bucket)
        hit = np.flatnonzero(np.append(self.known, -1)[at] == bucket)
        return sigmoid(self.margins(row[hit], at[hit], len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def distinct_terms(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each text's distinct hashed terms, sorted."""
    found = words(texts, ALNUM_LOWER)
    bucket = (found.hash >> U64(64 - bits)).astype(np.int64)
    both = np.unique((per_text(found.first) << bits) | bucket)
    return both >> bits, both & ((1 << bits) - 1)


def fit(terms: list[np.ndarray], label: np.ndarray, config: ToxicityConfig, stands_for: np.ndarray | None = None) -> Machine:
    """AdaGrad on the log loss over mini-batches; weights shrink by l1 and l2, factors by l2.

    stands_for: the number of labels that each text stands for in the loss; 1 by default.
    """
    none = np.empty(0, np.int64)
    share = np.ones(len(label)) if stands_for is None or not len(label) else stands_for / stands_for.mean()
    rate = float((share * label).mean()) if len(label) else 0.0
    base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    seen, count = np.unique(np.concatenate([none, *terms]), return_counts=True)
    known = seen[count >= config.least_docs]
    k = config.factors
    rng = np.random.default_rng(config.seed)
    model = Machine(base, known, np.zeros(len(known)), rng.normal(0, 0.01, (len(known), k)))
    if not len(known) or not 0 < rate < 1:
        return model
    kept = [np.flatnonzero(np.isin(known, x, assume_unique=True)) for x in terms]
    past_b, past_w, past_v = 1e-8, np.full(len(known), 1e-2), np.full((len(known), k), 1e-2)
    steps = -(-len(label) // config.batch)
    for _ in range(max(config.epochs, -(-config.least_steps // steps))):
        order = rng.permutation(len(label))
        for begin in range(0, len(order), config.batch):
            part = order[begin : begin + config.batch]
            length = np.fromiter((len(kept[i]) for i in part), np.int64, len(part))
            term, row = np.concatenate([kept[i] for i in part]), np.repeat(np.arange(len(part)), length)
            own = model.factor[term]
            sums = np.stack([np.bincount(row, own[:, f], len(part)) for f in range(k)], 1)
            margin = model.bias + np.bincount(row, model.weight[term], len(part))
            margin += 0.5 * ((sums**2).sum(1) - np.bincount(row, (own**2).sum(1), len(part)))
            slope = share[part] * (sigmoid(margin) - label[part]) / len(part)
            touched, local = np.unique(term, return_inverse=True)
            push = slope[row]
            down_w = np.bincount(local, push, len(touched)) + config.l2 * model.weight[touched]
            past_w[touched] += down_w**2
            step = config.rate / np.sqrt(past_w[touched])
            moved = model.weight[touched] - step * down_w
            model.weight[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * config.l1, 0)
            for f in range(k):
                down_v = np.bincount(local, push * (sums[row, f] - own[:, f]), len(touched)) + config.l2 * model.factor[touched, f]
                past_v[touched, f] += down_v**2
                model.factor[touched, f] -= 0.3 * config.rate * down_v / np.sqrt(past_v[touched, f])
            past_b += slope.sum() ** 2
            model.bias -= config.rate * slope.sum() / np.sqrt(past_b + 1e-2)
    return model


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_of(docs: DataFrame, marks: DataFrame, config: ToxicityConfig) -> DataFrame:
    """toxic, terms of at most per_class labelled ids of each class; the sampled ids, 2 * per_class at most, are broadcast."""
    first = [F.xxhash64("doc_id"), "doc_id"]
    drawn = [marks.where(F.col("_toxic") == x).orderBy(*first).limit(config.per_class) for x in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    bits = config.bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                row, bucket = distinct_terms(texts, bits)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                blobs = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                part = batch.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_toxic"), part.column("h"), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "h", "terms"])

    terms = rows.withColumn("h", F.xxhash64("text")).mapInArrow(hashed, "doc_id long, toxic int, h long, terms binary")
    return terms.groupBy("doc_id").agg(F.min(F.struct("h", "terms", "toxic")).alias("x")).select("doc_id", "x.toxic", "x.terms")


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None) -> Machine:
    """Fit on the bounded sample. Texts aren't shuffled."""
    config = config or ToxicityConfig()
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where("_toxic is not null")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    total = {r["_toxic"]: r["n"] for r in marks.where("_toxic in (0, 1)").groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    stands_for = {x: max(1.0, n / config.per_class) for x, n in total.items()}

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "toxic": [], "terms": []}), *frames])
        rows = rows.sort_values(["doc_id", "terms"], kind="stable")
        terms = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["terms"]]
        m = fit(terms, rows["toxic"].to_numpy(float), config, rows["toxic"].map(stands_for).to_numpy(float))
        yield pd.DataFrame({"bias": [m.bias], "known": [m.known.tobytes()], "weight": [m.weight.tobytes()], "factor": [m.factor.tobytes()]})

    with scratch(docs.sparkSession):
        sample = written(sample_of(docs, marks, config), "toxicity-sample")
        got = sample.coalesce(1).mapInPandas(fitted, "bias double, known binary, weight binary, factor binary").collect()
    if not got:
        return Machine(-40.0, np.empty(0, np.int64), np.empty(0), np.empty((0, config.factors)))
    known = np.frombuffer(bytes(got[0].known), np.int64)
    return Machine(got[0].bias, known, np.frombuffer(bytes(got[0].weight)), np.frombuffer(bytes(got[0].factor)).reshape(len(known), config.factors))


def score(docs: DataFrame, model: Machine, config: ToxicityConfig | None = None) -> DataFrame:
    """doc_id, score of each whole text. The model's size is bounded by 2 ** bits terms, whatever the input."""
    bits = (config or ToxicityConfig()).bits
    machine = shared(docs.sparkSession, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                ids = batch.column("doc_id").slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(machine.value.scores(texts, bits))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = score(docs, train(docs, labels, config), config)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted label isn't toxic. Nothing is shuffled."""
    bits = (config or ToxicityConfig()).bits
    machine = shared(docs.sparkSession, train(docs, labels, config))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                clean = machine.value.scores(texts, bits) < 0.5
                yield batch.slice(at.start, at.stop - at.start).filter(pa.array(clean))

    return docs.mapInArrow(kept, docs.schema)
