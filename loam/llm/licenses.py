"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence words.

The automaton holds phrases, sentences and whole licence texts, word by word. A text is streamed through it: at each word
the automaton gives the longest run of words, ending there, that stands in some template (the matching statistic). Runs
of at least `least` words are chained, template by template, while both sides move forward by at most `gap` words; a chain
that covers at least `share` of its template's words is a span with the template's label. A span that lies within one of
another label that covers more words gives way to it, so a licence's text doesn't also carry the labels of its parts.

A place of a phrase is where the current match, as long as the phrase or longer, ends in it; the automaton marks the
states of which that holds. Phrases may have any number of words, but not none.

Only stretches of a text in which word pairs of the templates stand one after the other are streamed, as many as the
shortest phrase or run has (single words, if that has one). That is the whole of any match, so nothing is lost by it.

Nulls and edges: a null or empty text has no words, no places, no spans, empty labels and score 0. Repeated documents and
null ids give a row each. Very long texts are streamed whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import PHRASES, SENTENCES, TEXTS
from .storage import shared
from .words import ALNUM_LOWER, Words, chunks, rolling, words

#: Label and text of each template.
TEMPLATES = SENTENCES + TEXTS

@dataclass
class Automaton:
    """Suffix automaton of several word sequences; state 0 is the start."""

    next: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of target for the strings of state plus word, taking over their edges."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        there = self.next[last].get(word)
        if there is not None:  # another sequence has it already
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            self.link[state] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return state

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def state_of(self, sequence: list[bytes]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state

    def stream(self, sequence: list[bytes]) -> Iterator[tuple[int, int]]:
        """(state, matching statistic) after each word."""
        state = size = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            else:
                size = 0
            yield state, size


def word_list(text: str) -> list[bytes]:
    found = words([text.encode()], ALNUM_LOWER)
    return [found.word(k) for k in range(len(found.start))]


class Scanner:
    """The automaton of phrases and templates, and what it says of one text."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], least: int, gap: int, share: float):
        self.least, self.gap, self.share = least, gap, share
        self.phrases = [(word_list(k), v) for k, v in phrases.items()]
        self.templates = [(label, word_list(text)) for label, text in templates]
        everything = [x for x, _ in self.phrases] + [x for _, x in self.templates]
        if not all(everything) or least < 1:
            raise ValueError("phrases, templates and runs need a word at least")
        self.automaton = Automaton()
        for sequence in everything:
            self.automaton.add(sequence)
        self.ends: dict[int, list[int]] = {}
        for k, (sequence, _) in enumerate(self.phrases):
            self.ends.setdefault(self.automaton.state_of(sequence), []).append(k)
        #: For each state, the templates' places (template, end) of its strings.
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.automaton.length]
        for t, (_, sequence) in enumerate(self.templates):
            for end, (state, _) in enumerate(self.automaton.stream(sequence), 1):
                while state > 0:
                    self.places[state].append((t, end))
                    state = self.automaton.link[state]
        hashes = [words([b" ".join(x)], ALNUM_LOWER).hash for x in everything]
        none = np.empty(0, np.uint64)
        self.pairs = np.unique(np.concatenate([none, *(rolling(x, 2) for x in hashes)]))
        alone = hashes if least == 1 else [x for x in hashes[: len(self.phrases)] if len(x) == 1]
        self.singles = np.unique(np.concatenate([none, *alone]))
        #: So many pairs in a row can hold a phrase of two words or more, or a run.
        self.row = max(2, min([max(2, least), *(len(x) for x, _ in self.phrases if len(x) > 1)])) - 1

    def stretches(self, found: Words) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end) of the stretches that can hold a place or a run."""
        covered = np.isin(found.hash, self.singles)
        pair = rolling(found.hash, 2)
        if len(pair) and len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = self.pairs[at] == pair
            border = found.first[1:-1]
            known[border[(border > 0) & (border <= len(known))] - 1] = False  # a pair doesn't reach into the next text
            for begin, end in zip(*_runs(known), strict=True):
                if end - begin >= self.row:
                    covered[begin : end + 1] = True
        for a, b in zip(*_runs(covered), strict=True):
            inner = found.first[(found.first > a) & (found.first < b)] if len(found.first) > 2 else ()
            for begin, end in pairwise([a, *np.unique(inner), b]):
                yield int(np.searchsorted(found.first, begin, side="right") - 1), int(begin), int(end)

    def phrase_places(self, state: int, size: int) -> Iterator[int]:
        """The phrases that end where a match of that state and size ends."""
        while state > 0:
            for k in self.ends.get(state, ()):
                if len(self.phrases[k][0]) <= size:
                    yield k
            state = self.automaton.link[state]

    def scan(self, sequence: list[bytes], offset: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(word, phrase) places, and maximal matches (template, its first word, the text's first word, size)."""
        places, runs = [], []
        before: tuple[int, int] = (0, 0)
        steps = [*self.automaton.stream(sequence), (0, 0)]
        for i, (state, size) in enumerate(steps):
            places += [(offset + i + 1 - len(self.phrases[k][0]), k) for k in self.phrase_places(state, size)]
            if before[1] >= self.least and size != before[1] + 1:
                runs += [(t, end - before[1], offset + i - before[1], before[1]) for t, end in self.places[before[0]] if end >= before[1]]
            before = (state, size)
        return places, runs

    def spans(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, words covered, share of the template) of the chains that cover enough.

        Spans of one label don't share a word of the text, nor does a chain lie within one of another label that
        covers more.
        """
        chains = []
        for t in {x[0] for x in runs}:
            label, sequence = self.templates[t]
            done: list[tuple[int, int, int, int]] = []  # end in the text, end in the template, words covered, first word
            for _, start, at, size in sorted((x for x in runs if x[0] == t), key=lambda x: (x[2], x[1])):
                done = [x for x in done if at - x[0] <= self.gap]
                covered, first = max(((c, f) for e, s, c, f in done if at >= e and 0 <= start - s <= self.gap), default=(0, at))
                done.append((at + size, start + size, covered + size, first))
                chains.append((covered + size, t, label, first, at + size - 1, (covered + size) / len(sequence)))
        out: list[tuple[int, int, str, int, int, float]] = []
        for x in sorted(chains, key=lambda x: (-x[0], x[1], x[3])):
            c, _, label, first, last, share = x
            apart = all(last < y[3] or first > y[4] for y in out if y[2] == label)
            inside = any(y[3] <= first and last <= y[4] and y[0] > c for y in out if y[2] != label)
            if share >= self.share and apart and not inside:
                out.append(x)
        return sorted((label, first, last, c, share) for c, _, label, first, last, share in out)

    def best(self, runs: list[tuple[int, int, int, int]]) -> float:
        """The largest share of a template that some single run covers."""
        return max((size / len(self.templates[t][1]) for t, _, _, size in runs), default=0.0)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


_PLACES = "array<struct<label:string,first_word:bigint>>"
_SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,covered:bigint,share:double>>"


def _scanned(scanner: Scanner, texts: list[bytes]) -> dict[str, list]:
    found = words(texts, ALNUM_LOWER)
    places: dict[int, list[tuple[int, int]]] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for text, begin, end in scanner.stretches(found):
        first = int(found.first[text])
        got, more = scanner.scan([found.word(k) for k in range(begin, end)], begin - first)
        places.setdefault(text, []).extend(got)
        runs.setdefault(text, []).extend(more)
    listed = [[{"label": scanner.phrases[k][1], "first_word": w} for w, k in places.get(i, [])] for i in range(len(texts))]
    spans = [[dict(zip(("label", "first_word", "last_word", "covered", "share"), x, strict=True)) for x in scanner.spans(runs[i])] if i in runs else [] for i in range(len(texts))]
    return {"n_words": np.diff(found.first), "places": listed, "spans": spans, "nearest": [scanner.best(runs.get(i, [])) for i in range(len(texts))]}


def matches(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, least: int = 3, gap: int = 6, share: float = 0.75) -> DataFrame:
    """doc_id, n_words, places of phrases, spans of templates, nearest (the largest share of a template that one run covers).

    No shuffle. The automaton's size is that of the templates.
    """
    scanner = shared(docs.sparkSession, Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, least, gap, share))
    place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
    kinds = {"n_words": pa.int64(), "places": place, "spans": span, "nearest": pa.float64()}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                ids = batch.column("doc_id").slice(at.start, at.stop - at.start)
                found = _scanned(scanner.value, texts)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[k], kind) for k, kind in kinds.items())], ["doc_id", *kinds])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(scanned, f"doc_id long, n_words long, places {_PLACES}, spans {_SPANS}, nearest double")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document, from matches()."""
    base, spans = F.col("places.label"), F.col("spans")
    share = F.greatest(F.lit(0.0), "nearest", F.array_max(spans["share"]))
    return matches(docs, **options).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        _joined(base).alias("base_labels"), _joined(F.concat(base, spans["label"])).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.lit(1.0), share)).alias("score"),
    )
