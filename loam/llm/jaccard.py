"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct shingles. Documents with equal sets form a class; from there on only
classes are compared. Two classes link when 100 * |intersection| >= percent * |union|.

Tokens are ordered by how many documents hold them, rarest first, as counted over all documents in a table of fixed
size (any order that all tasks agree on gives right results; this one keeps frequent tokens out). Classes that link
share one of their first n - ceil(percent * n / 100) + 1 tokens. The join has two steps:

1. Leaders. Of the classes that share such a token, each is compared with one of them, the token's leader. The links
   found so connect classes, and what they connect isn't compared again.
2. Token-group matrix. Classes are partitioned by the one of those tokens that most classes have, whether they link or
   not, so versions of one text meet in a group; groups are cut into pieces of about `piece` classes. A token's row holds
   the pieces in which some class has it. A class is a query to the pieces, at least as large as its own, that its
   tokens' rows name, whose sizes fit, and in which that token's classes aren't all connected with it.

In both, a piece first meets its queries' signatures (the parities of a set's tokens in about as many bits as it has
tokens): two sets differ in at least as many tokens as their parities do, which bounds their overlap. Only pieces and
queries that the bound lets through are opened, which is when sets travel. There the union of a piece's tokens bounds
each query's overlap once more before its classes are counted exactly. A piece gives no link between classes that links
have connected before, so copies of copies aren't paired.

Both steps together miss no connection: every linked pair shares a token, so it was either connected in step 1, or one
of the two is a query to the other's piece in step 2.

A filter of fixed size over documents' ids picks the signatures and sets that travel in the scan.

Nulls and edges: a null or empty text, or one without words, has an empty set and links with nothing: it is its own
component. A text of fewer than `size` words has its whole sequence as the one shingle. Rows with a null doc_id have a
null component. Rows of one doc_id and other texts are documents of their own, each with its own component; components
are named by their smallest doc_id, so two that share that id share the name without being joined. Hashes have 64 bits. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .sketches import Filter, counts, rank_of
from .storage import scratch, shared, written
from .words import SPACED_LOWER, U64, chunks, give_back, mix, rolling, words

#: Stands for a null doc_id where classes are looked up by one of their documents.
NO_ID = -1


@dataclass(frozen=True)
class JaccardConfig:
    size: int = 4
    percent: int = 85
    piece: int = 256
    queries: int = 512


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = words(texts, SPACED_LOWER)
    rolled, out = rolling(found.hash, size), []
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        else:
            out.append(rolling(found.hash[a:b], b - a) if b > a else np.empty(0, U64))
    return out


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; never 0 for a set with tokens."""
    total = np.array([len(tokens)], U64)
    total += mix(tokens ^ U64(0xA0761D6478BD642F)).sum(dtype=U64)
    return int(mix(total).view(np.int64)[0]) or 1


def needed(n, percent: int):
    """The least overlap of a set of n tokens with one that links with it."""
    return -(-n * percent // 100)


def _ids(batch: pa.RecordBatch, at: slice) -> pa.Array:
    return batch.column("doc_id").slice(at.start, at.stop - at.start)


def classes(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """doc_id, n, class (0 for an empty set) of each document, and h if docs has it."""
    more = [c for c in docs.columns if c == "h"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, config.size)
                names = [class_of(x) if len(x) else 0 for x in sets]
                kept = [batch.column(c).slice(at.start, at.stop - at.start) for c in more]
                yield pa.RecordBatch.from_arrays([_ids(batch, at), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.int64()), *kept], ["doc_id", "n", "class", *more])

    return docs.mapInArrow(listed, ", ".join(["doc_id long, n long, class long", *(f"{c} long" for c in more)]))


def prefix_tokens(docs: DataFrame, sketch: np.ndarray, config: JaccardConfig, only: Filter | None = None) -> DataFrame:
    """token, class, n of each class's first tokens; a task gives a class once, as long as it remembers it."""
    both = shared(docs.sparkSession, (sketch, only))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, wanted = both.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                held = []
                for tokens in shingle_sets(texts, config.size):
                    name = class_of(tokens) if len(tokens) else 0
                    if not name or name in seen:
                        continue
                    seen.add(name)
                    n = len(tokens)
                    order = np.lexsort((tokens, rank_of(ranks, tokens)))[: n - needed(n, config.percent) + 1]
                    held.append((tokens[order].view(np.int64), name, n))
                if len(seen) > 500_000:
                    seen.clear()
                if not held:
                    continue
                many = [len(x) for x, _, _ in held]
                token = np.concatenate([x for x, _, _ in held])
                name, n = (np.repeat(np.array([h[k] for h in held], np.int64), many) for k in (1, 2))
                keep = wanted.has(token) if wanted else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(name[keep]), pa.array(n[keep])], ["token", "class", "n"])

    return docs.mapInArrow(first, "token long, class long, n long")


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in 2 ** k bits, as many as there are tokens, or more, and 64 at least."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & U64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def sets_of(docs: DataFrame, wanted: DataFrame, config: JaccardConfig, of=lambda tokens: tokens.tobytes()) -> DataFrame:
    """class, data (what `of` makes of the set), once for each class of wanted (class, doc_id: one of its documents, or NO_ID).

    A few other classes that the filters let through come along; joins on the class drop them.
    """
    only = shared(docs.sparkSession, (Filter.of(wanted, "doc_id"), Filter.of(wanted, "class")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            documents, named = only.value
            kept = batch.filter(pa.array(documents.has(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False))))
            for _, texts in chunks(kept, "text"):
                sets = [x for x in shingle_sets(texts, config.size) if len(x)]
                names = np.array([class_of(x) for x in sets], np.int64)
                fresh = []
                for i in np.flatnonzero(named.has(names)):  # a task gives a class once, as long as it remembers it
                    if int(names[i]) not in seen:
                        seen.add(int(names[i]))
                        fresh.append(i)
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(names[fresh]), pa.array([of(sets[i]) for i in fresh], pa.binary())], ["class", "data"])

    return docs.mapInArrow(read, "class long, data binary").dropDuplicates(["class"])


def _passing(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """The queries that the signatures' bound lets through to some class of one piece, of another root; and those classes."""
    role, names, sizes, roots = (table[c].to_numpy() for c in ("role", "class", "n", "root"))
    bits = [np.frombuffer(x.as_py(), np.uint64) for x in table["data"]]
    kinds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(bits[m]) for m in np.flatnonzero(role == 0)}:
        some = np.array([m for m in np.flatnonzero(role == 0) if len(bits[m]) == width])
        kinds[width] = np.stack([bits[m] for m in some]), some
    asking, held = [], np.zeros(len(role), bool)
    for q in np.flatnonzero(role == 1):
        any_ = False
        for width, (sets, at) in kinds.items():
            both = min(width, len(bits[q]))  # the wider one folds onto the narrower
            own = np.bitwise_xor.reduce(bits[q].reshape(-1, both), axis=0)
            apart = np.bitwise_count(np.bitwise_xor.reduce(sets.reshape(len(sets), -1, both), axis=1) ^ own).sum(axis=1).astype(np.int64)
            most = np.minimum((sizes[at] + sizes[q] - apart) // 2, np.minimum(sizes[at], sizes[q]))
            fits = at[(100 * most >= percent * (sizes[at] + sizes[q] - most)) & (roots[at] != roots[q])]
            held[fits] = True
            any_ |= len(fits) > 0
        if any_:
            asking.append(int(names[q]))
    return asking, names[held].tolist()


def passing(queries: DataFrame, members: DataFrame, signatures: DataFrame, config: JaccardConfig) -> DataFrame:
    """class, piece, role: the queries (1) that the signatures' bound lets through to a piece, and the members (0) it lets them meet."""

    def passed(key: tuple, table: pa.Table) -> pa.Table:
        asking, held = _passing(table, config.percent)
        n = len(asking) + len(held)
        return pa.table({"class": pa.array(asking + held, pa.int64()), "piece": pa.array([key[0].as_py()] * n, pa.int64()), "role": pa.array([1] * len(asking) + [0] * len(held), pa.int32())})

    dealt = _lots(queries, members, config).join(signatures, "class")
    return dealt.groupBy("piece", "lot").applyInArrow(passed, "class long, piece long, role int").distinct()


def _compared(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links between the queries and the members of one piece that connect all roots that link."""
    role, names, roots = (table[c].to_numpy() for c in ("role", "class", "root"))
    sets = [np.frombuffer(x.as_py(), U64) for x in table["data"]]
    members = np.flatnonzero(role == 0)
    out: tuple[list[int], list[int]] = ([], [])
    if not len(members):
        return out
    size = np.array([len(sets[m]) for m in members])
    token, owner = np.concatenate([sets[m] for m in members]), np.repeat(np.arange(len(members)), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    union = np.unique(token)
    above: dict[int, int] = {}

    def top(root: int) -> int:
        while root in above:
            root = above[root]
        return root

    for q in np.flatnonzero(role == 1):
        own = sets[q]
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        shared = own[union[at] == own]
        if len(shared) < max(needed(len(own), percent), needed(int(size.min()), percent)):
            continue  # the bound: no class of the piece can link
        low, high = np.searchsorted(token, shared), np.searchsorted(token, shared, side="right")
        spans = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        both = np.bincount(owner[spans], minlength=len(members))
        hits = members[(100 * both >= percent * (len(own) + size - both)) & (roots[members] != roots[q])]
        for m in hits[np.unique(roots[hits], return_index=True)[1]]:
            a, b = top(int(roots[q])), top(int(roots[m]))
            if a != b:
                above[max(a, b)] = min(a, b)
                out[0].append(int(names[q]))
                out[1].append(int(names[m]))
    return out


def compare(pairs: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """a, b: links among pairs (piece, lot, class, root, role: 1 for queries, 0 for members)."""

    def linked(table: pa.Table) -> pa.Table:
        a, b = _compared(table, config.percent)
        if table.num_rows > 64:
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.join(sets, "class").groupBy("piece", "lot").applyInArrow(linked, "a long, b long")


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _lots(queries: DataFrame, members: DataFrame, config: JaccardConfig) -> DataFrame:
    """Pieces with their queries dealt into lots of about config.queries; the members go to each lot.

    queries, members: class, piece, root (of the classes that links connect already).
    """
    lots = queries.groupBy("piece").agg(F.ceil(F.count("*") / config.queries).cast("long").alias("lots"))
    asked = queries.join(lots, "piece").select("piece", F.pmod(F.xxhash64("class"), "lots").alias("lot"), "class", "root", F.lit(1).alias("role"))
    held = members.join(lots, "piece").select("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), "class", "root", F.lit(0).alias("role"))
    return asked.unionByName(held)


def link(docs: DataFrame, config: JaccardConfig | None = None, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, class of each document, with hashed also h, its text's hash; a, b: links between classes that connect all that link)."""
    config = config or JaccardConfig()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with scratch(docs.sparkSession) as own:
        listed = written(classes(docs.withColumn("h", _text_hash()) if hashed else docs, config), "jaccard-classes")
        total = listed.agg(F.sum("n").alias("n")).first().n or 0
        width = min(1 << 24, max(1 << 16, 1 << (total // 64).bit_length()))

        def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, texts in chunks(batch, "text"):
                yield np.concatenate([np.empty(0, U64), *shingle_sets(texts, config.size)])

        sketch = counts(docs, hashes, width)
        firsts = prefix_tokens(docs, sketch, config)
        stars = firsts.groupBy("token").agg(F.min("class").alias("leader"), F.max("class").alias("last"), F.count("*").alias("held"))
        stars = written(stars.where("leader <> last").drop("last"), "jaccard-stars")
        firsts = written(prefix_tokens(docs, sketch, config, Filter.of(stars, "token")).distinct().join(stars, "token"), "jaccard-tokens")
        several = firsts.groupBy("class").agg(F.first("n").alias("n"), F.max(F.struct("held", "token")).getField("token").alias("key"))
        reps = listed.where("class <> 0").groupBy("class").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc_id"))
        reps = written(several.join(reps, "class").select("class", "doc_id", "n", "key"), "jaccard-shared")
        signatures = sets_of(docs, reps.select("class", "doc_id"), config, signature).join(reps.select("class", "n"), "class")
        signatures = written(signatures, "jaccard-signatures")

        def opened(queries: DataFrame, members: DataFrame) -> DataFrame:
            """Links of the queries that pass the bound with the members of their pieces."""
            passed = written(passing(queries, members, signatures, config), "jaccard-passed")
            asked, held = (x.join(passed.where(F.col("role") == r).drop("role"), ["class", "piece"]) for x, r in ((queries, 1), (members, 0)))
            wanted = passed.select("class").distinct().join(reps.select("class", "doc_id"), "class")
            sets = sets_of(docs, written(wanted, "jaccard-wanted"), config)
            return written(compare(_lots(asked, held, config), sets, config), "jaccard-links")

        # Step 1: each class with the leaders of its tokens.
        near = firsts.where(F.col("class") != F.col("leader")).select("class", "n", F.col("leader").alias("piece")).distinct()
        near = near.join(reps.select(F.col("class").alias("piece"), F.col("n").alias("leader_n")), "piece")
        near = near.where(_fits(F.col("n"), F.col("leader_n"), config.percent)).select("class", "piece", F.col("class").alias("root"))
        near = written(near, "jaccard-leaders")
        leaders = near.select("piece").distinct().select(F.col("piece").alias("class"), "piece", F.col("piece").alias("root"))
        links = opened(near, leaders)

        # Step 2: each class with the pieces in its tokens' rows.
        connected = components(links)
        rooted = reps.join(connected, F.col("class") == F.col("node"), "left").select("class", "n", "key", F.coalesce("root", "class").alias("root"))
        many = reps.groupBy("key").agg(F.ceil(F.count("*") / config.piece).cast("long").alias("pieces"))
        piece = F.when(F.col("pieces") == 1, F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("class"), "pieces")))
        placed = written(rooted.join(many, "key").select("class", "n", "root", piece.alias("piece")), "jaccard-pieces")
        amount = placed.groupBy("piece").agg(F.count("*").alias("amount"))
        held = written(firsts.select("token", "class").join(placed.join(amount, "piece"), "class"), "jaccard-held")
        matrix = held.groupBy("token", "piece", "amount").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("n", "root") for f in (F.min, F.max)))
        several = matrix.groupBy("token").agg(F.min("min_root").alias("g"), F.max("max_root").alias("h")).where("g <> h").select("token")
        matrix = written(matrix.join(several, "token"), "jaccard-matrix")
        asking = held.select("token", "class", "n", "root", F.col("piece").alias("own"), F.col("amount").alias("own_amount")).join(matrix, "token")
        fits = (F.col("max_n") * 100 >= F.col("n") * config.percent) & (F.col("n") * 100 >= F.col("min_n") * config.percent)
        other = (F.col("min_root") != F.col("root")) | (F.col("max_root") != F.col("root"))
        ahead = F.struct("own_amount", "own") <= F.struct("amount", "piece")
        asked = written(asking.where(fits & other & ahead).select("class", "piece", "root").distinct(), "jaccard-queries")
        more = opened(asked, placed.select("class", "piece", "root"))
        own.keep(listed, links, more)
    return listed, links.unionByName(more)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _least(listed: DataFrame, links: DataFrame, value: Column) -> DataFrame:
    """class, component: the least value of the documents of each class's component."""
    group = components(links).select(F.col("node").alias("class"), "root")
    own = listed.where("class <> 0").groupBy("class").agg(F.min(value).alias("least"))
    rooted = own.join(group, "class", "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return written(rooted.join(best, "root").select("class", "component"), "jaccard-components")


def join(docs: DataFrame, config: JaccardConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    with scratch(docs.sparkSession) as own:
        listed, links = link(docs, config)
        named = _least(listed, links, F.col("doc_id"))
        own.keep(listed, named)
    return listed.join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, config: JaccardConfig | None = None) -> DataFrame:
    """One row of docs of each component, that of the smallest doc_id (nulls last), then of the smallest hash of the text.

    Of rows that agree in both any one stays. Rows with an empty set link with nothing, and all stay.
    """
    with scratch(docs.sparkSession) as own:
        listed, links = link(docs.select("doc_id", "text"), config, hashed=True)
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
        named = _least(listed, links, row)
        told = listed.join(named, "class").select("doc_id", "h", (row == F.col("component")).alias("first"))
        told = told.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.first("first").alias("_first"), F.count("*").alias("_n"))
        gone = written(told.where("not _first or _n > 1"), "jaccard-gone")
        own.keep(gone)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (_text_hash() == F.col("_h"))
    rest = docs.join(gone, same, "left_anti")
    repeated = gone.where("_first")
    if repeated.isEmpty():
        return rest
    once = docs.join(repeated, same, "left_semi").withColumn("_h", _text_hash()).dropDuplicates(["doc_id", "_h"]).drop("_h")
    return rest.unionByName(once)
