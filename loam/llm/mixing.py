"""Mixing sources to target weights by a flow of words from groups of documents to quotas of sources.

A document may belong to several sources. Documents are summed by their membership pattern (the set of sources), which
leaves a small table. Words flow from each pattern to the quotas of its sources: one arc for each time a document may be
taken (`most` in all), where each repeat costs more than the one before, so the cheapest flow repeats as little as the
quotas allow. Patterns and sources that no pattern connects are flows of their own; a pattern whose one source nobody
else has needs none. Patterns and sources are collected: their number is that of distinct source sets, and more than
`most_patterns` of them raise an error.

Documents are then picked in a seeded order, that of the MD5 of seed, id and text. A pattern that gives f words of its s
takes each of its documents f // s times, and the rest of f from the first documents of the order, the last of which in
part, so quotas are met to the word. The order is cut by a histogram of the hash in two levels (the bin at the cut has a
histogram of its own); both are summed before they are shuffled, so a source with a third of all rows isn't gathered in
one place, and only what shares the last bin, one of 2 ** (2 * `bits`), is put in order.

Nulls and edges: a null text has no words and nothing is taken of it. Rows with a null source are a source of their
own, last in order. A source without words has target 0. Repeated ids and texts are rows like others: rows that agree in
id and text share one place, each taking the same. A null id or text counts as empty in the hash. An empty table gives
no rows. Other columns pass through unless a result has their name.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch, written


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (3, 1, 2)
    total_percent: int = 150
    most: int = 2
    seed: int = 17
    bits: int = 12
    most_patterns: int = 100_000


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")).cast("long")


def targets(sizes: dict[str | None, int], config: MixConfig, total: int | None = None) -> dict[str | None, float]:
    """Each source's target: its weight's part of the total, at most `most` times its size; the rest goes to others.

    total: words of all documents, where those of several sources count once; by default the sum of sizes.
    """
    order = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in sizes)
    weight = {s: config.weights[k % len(config.weights)] for k, s in enumerate(order)}
    left = (sum(sizes.values()) if total is None else total) * config.total_percent / 100
    got: dict[str | None, float] = {}
    open_ = list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > config.most * sizes[s]]
        if not full:
            return got | {s: share * weight[s] for s in open_}
        for s in full:
            got[s] = float(config.most * sizes[s])
            left -= got[s]
        open_ = [s for s in open_ if s not in got]
    return got


class Flow:
    """Min-cost flow by shortest augmenting paths with node potentials; costs start at 0 or more."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def run(self, source: int, sink: int) -> int:
        height, moved = [0] * len(self.out), 0
        while True:
            far: dict[int, int] = {source: 0}
            via: dict[int, int] = {}
            heap, done = [(0, source)], set()
            while heap:
                d, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    y = self.head[e]
                    if self.room[e] and y not in done and (to := d + self.cost[e] + height[x] - height[y]) < far.get(y, to + 1):
                        far[y], via[y] = to, e
                        heapq.heappush(heap, (to, y))
            if sink not in far:
                return moved
            height = [h + min(far.get(x, far[sink]), far[sink]) for x, h in enumerate(height)]
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.head[via[x] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            moved += push


def _separate(patterns: dict[tuple, int]) -> list[list[tuple]]:
    """Patterns in groups that share no source."""
    above: dict[str | None, str | None] = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for p in patterns:
        for s in p[1:]:
            above[top(s)] = top(p[0])
    groups: dict[str | None, list[tuple]] = {}
    for p in patterns:
        if p:
            groups.setdefault(top(p[0]), []).append(p)
    return list(groups.values())


def routed(patterns: dict[tuple, int], quotas: dict[str | None, int], most: int) -> dict[tuple, int]:
    """Words that each pattern gives. The k-th time a pattern's words are used costs k * k."""
    given = {p: 0 for p in patterns}
    for order in _separate(patterns):
        names = sorted({s for p in order for s in p}, key=lambda s: (s is None, s))
        if len(order) == 1:  # one way only: as much as the quotas take
            given[order[0]] = min(most * patterns[order[0]], sum(quotas[s] for s in names))
            continue
        flow, own = Flow(2 + len(order) + len(names)), {}
        number = {s: 2 + len(order) + j for j, s in enumerate(names)}
        for i, p in enumerate(order):
            own[p] = [flow.arc(0, 2 + i, patterns[p], k * k) for k in range(most)]
            for s in p:
                flow.arc(2 + i, number[s], most * patterns[p], 0)
        for s in names:
            flow.arc(number[s], 1, quotas[s], 0)
        flow.run(0, 1)
        given |= {p: sum(flow.room[e ^ 1] for e in own[p]) for p in order}
    return given


def _place(seed: int) -> Column:
    """Place of a row in the seeded order: 60 bits of an MD5."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, members: Column | None = None, config: MixConfig | None = None) -> DataFrame:
    """docs with size, source_size, target (both of the document's first source) and taken (words, repeats counted).

    members: an array of sources; by default the column source alone.
    """
    config = config or MixConfig()
    spark = docs.sparkSession
    plain = docs.drop("size", "source_size", "target", "taken")
    members = F.array("source") if members is None else F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>"))
    rows = plain.withColumns({"_members": members.cast("array<string>"), "size": n_words(F.col("text")), "_place": _place(config.seed)})
    low = (1 << config.bits) - 1
    rows = rows.withColumns({"_bin": F.shiftright("_place", 60 - config.bits), "_sub": F.shiftright("_place", 60 - 2 * config.bits).bitwiseAND(F.lit(low))})
    with scratch(spark) as own:
        sizes_ = written(rows.select("_members", "size", "_place", "_bin", "_sub"), "mix-sizes")
        histogram = written(sizes_.groupBy("_members", "_bin").agg(F.sum("size").alias("_words")), "mix-bins")
        summed = histogram.groupBy("_members").agg(F.sum("_words").alias("n")).limit(config.most_patterns + 1).collect()
        if len(summed) > config.most_patterns:
            raise ValueError(f"more than {config.most_patterns} distinct sets of sources")
        patterns = {tuple(r["_members"]): r["n"] for r in sorted(summed, key=lambda r: [(s is None, s or "") for s in r["_members"]])}
        sizes: dict[str | None, int] = {}
        for p, n in patterns.items():
            for s in p:
                sizes[s] = sizes.get(s, 0) + n
        goal = targets(sizes, config, sum(patterns.values()))
        given = routed(patterns, {s: math.floor(x + 0.5) for s, x in goal.items()}, config.most)

        told = [(k, [*p], sizes[p[0]], goal[p[0]], given[p] // max(n, 1), given[p] % max(n, 1)) for k, (p, n) in enumerate(patterns.items()) if p]
        plan = spark.createDataFrame(told, "_k int, _pattern array<string>, source_size long, target double, _times long, _rest long")

        def planned(df: DataFrame) -> DataFrame:
            """df with its pattern's plan: at most most_patterns rows, broadcast."""
            return df.join(F.broadcast(plan), F.col("_members").eqNullSafe(F.col("_pattern")), "left").drop("_members", "_pattern")

        def cut(bins: DataFrame, at: str, rest: Column, name: str) -> DataFrame:
            """_k and the bin in which the sum of a pattern's words reaches its rest, with the words before it: a row for each pattern at most."""
            before = F.sum("_words").over(Window.partitionBy("_k").orderBy(at)) - F.col("_words")
            found = bins.withColumn("_before", before).where((F.col("_before") < rest) & (F.col("_before") + F.col("_words") >= rest))
            return written(found.select("_k", F.col(at).alias(f"{at}_cut"), F.col("_before").alias(f"{at}_before")), name)

        first = cut(planned(histogram), "_bin", F.col("_rest"), "mix-cuts")
        placed = planned(sizes_).join(F.broadcast(first), "_k")
        finer = placed.where("_bin = _bin_cut and size > 0").groupBy("_k", "_sub").agg(F.sum("size").alias("_words"), F.first(F.col("_rest") - F.col("_bin_before")).alias("_left"))
        second = cut(finer, "_sub", F.col("_left"), "mix-subcuts")
        placed = placed.join(F.broadcast(second), "_k")
        # Only the documents of that bin's bin are put in order. Rows that agree in id and text stand at one place.
        last = placed.where("_bin = _bin_cut and _sub = _sub_cut and size > 0").groupBy("_k", "_place").agg(F.sum("size").alias("_here"), F.count("*").alias("_same"))
        up_to = F.sum("_here").over(Window.partitionBy("_k").orderBy("_place")) - F.col("_here")
        last = written(last.select("_k", "_place", "_same", up_to.alias("_up_to")), "mix-order")
        own.keep(first, second, last)
    placed = planned(rows).join(F.broadcast(first), "_k", "left").join(F.broadcast(second), "_k", "left")
    joined = placed.join(last, ["_k", "_place"], "left")
    part = ((F.col("_rest") - F.col("_bin_before") - F.col("_sub_before") - F.col("_up_to")) / F.col("_same")).cast("long")
    ahead = (F.col("_bin") < F.col("_bin_cut")) | ((F.col("_bin") == F.col("_bin_cut")) & (F.col("_sub") < F.col("_sub_cut")))
    extra = F.when(ahead, F.col("size")).when(F.col("_up_to").isNotNull(), F.greatest(F.lit(0), F.least("size", part)))
    taken = F.coalesce(F.col("size") * F.col("_times") + F.coalesce(extra, F.lit(0)), F.lit(0))
    whole = F.coalesce("source_size", F.lit(0)).cast("long")
    return joined.select(*plain.columns, "size", whole.alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), taken.cast("long").alias("taken"))
