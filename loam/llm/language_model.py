"""LM scoring: a trigram model in Elias-Fano tries, one for each shard of the vocabulary.

With c the counts in the training texts, N their tokens, V their distinct tokens, p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)):

    p(w | u v) = (c(u v w) + a c(v w) + m p(w)) / (c(u v) + a c(v) + m)

which is Dirichlet smoothing with a pseudo-tokens for each pair and m more; it sums to 1 over the V words and one unknown
word. A text's score is the sum of log10 p(w | u v) over its tokens and one end, each after the two tokens before it or
starts. The numerator needs only what is known of w, and the denominator, taken with v, only what is known of v. So all
that belongs to a word meets in the word's shard: the trie there has the word's count, under it the words v before it
with the quantised log10 of a c(v w) + m p(w) and, for the token after, of c(v w) + a c(w) + m, and under those the words
u before them with the quantised numerators.

Steps, each over all texts: (1) counts of words, which give N, V and the words that are a thousandth of all tokens or
more; (2) counts of pairs of two such words, of which those of a ten-thousandth or more are kept; (3) counts of such pairs
after such words, with the same bound; (4) scoring: what concerns those words, pairs and triples, a thousand and twice ten
thousand at most, is broadcast and added up where the text is; every other triple goes to its word's shard (with a
frequent word to one by the hash of the pair, with a frequent pair to one by the hash of all three), which builds its trie
from the training texts, writes it to a file, maps that, looks every triple up in it, and sends partial sums back to the
text's chunk, where they are added.

Words are 64-bit hashes; those of the words before have 40 bits under a word, and 32 under a pair. The number of shards
follows the number of tokens.

Nulls and edges: a null text is empty; an empty text has the end as its only token. Rows with a null doc_id are never
learnt from, and held out. Repeated rows are learnt from, and scored, each for itself. Without training texts every
token has probability 1. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .eliasfano import CONTEXT_BITS, FURTHER_BITS, EliasFano, Level, Trie, Values, in_blocks
from .storage import scratch, shared, written
from .words import CHUNK, SPACED_LOWER, U64, give_back, mix, parts, words

_START, _END = U64(0x5354415254), U64(0x454E44)
_CHUNK, _MOST_DOCS = 3 << 20, 1 << 14


@dataclass(frozen=True)
class ModelConfig:
    pseudo: float = 8.0
    pair_weight: float = 0.01
    tokens_a_shard: int = 1_600_000
    least_shards: int = 24
    frequent: int = 1000
    frequent_pairs: int = 10_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(True))


def _context(h: np.ndarray) -> np.ndarray:
    return mix(h ^ U64(0x6A09E667F3BCC909)) >> U64(64 - CONTEXT_BITS)


def _further(h: np.ndarray) -> np.ndarray:
    return mix(h ^ U64(0xBB67AE8584CAA73B)) >> U64(64 - FURTHER_BITS)


def _pair_name(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(word + context)


@dataclass
class _Tokens:
    """Tokens of some texts, ends included: word, the word before it, the one before that, and text of each."""

    word: np.ndarray
    before: np.ndarray
    further: np.ndarray
    text: np.ndarray


def tokens(texts: list[bytes]) -> _Tokens:
    hashes, counts = [np.empty(0, U64)], [np.empty(0, np.int64)]
    end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(end // CHUNK)) + 1):  # words() takes 24 bytes a byte of text
        if len(part):
            found = words(texts[part[0] : part[-1] + 1], SPACED_LOWER)
            hashes.append(found.hash)
            counts.append(np.diff(found.first) + 1)
            del found
    many = np.concatenate(counts)
    stop = np.cumsum(many)
    word = np.full(stop[-1] if len(stop) else 0, _END, U64)
    inner = np.ones(len(word), bool)
    inner[stop - 1] = False
    word[inner] = np.concatenate(hashes)
    del hashes, inner
    before, further = np.full(len(word), _START, U64), np.full(len(word), _START, U64)
    before[1:] = word[:-1]
    before[stop - many] = _START
    further[1:] = before[:-1]
    further[stop - many] = _START
    return _Tokens(word, before, further, np.repeat(np.arange(len(texts)), many))


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[slice, list[bytes]]]:
    return parts(batch, "text", most, _MOST_DOCS)


class _Sums:
    """Counts of 64-bit numbers, merged now and then so that the memory stays bounded."""

    def __init__(self, most: int = 2_000_000):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.unique(values, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.rest()

    def _merge(self) -> None:
        if self.held:
            key, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            self.held = [(key, np.bincount(at, np.concatenate([n for _, n in self.held])).astype(np.int64))]
            self.size = len(key)

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for key, n in self.held:
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], ["key", "n"])
        self.held, self.size = [], 0


def _counted(docs: DataFrame, of) -> DataFrame:
    """key, n: sums over the training texts of what of(tokens) gives."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for _, texts in _parts(batch, 1 << 20):
                yield from sums.add(of(tokens(texts)))
        yield from sums.rest()

    return docs.where("not held_out").mapInArrow(told, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """N, V, training texts; the frequent words (sorted) with counts; frequent pairs and triples (sorted numbers) with counts."""

    total: int
    distinct: int
    texts: int
    word: np.ndarray
    count: np.ndarray
    pair: np.ndarray
    pair_count: np.ndarray
    triple: np.ndarray
    triple_count: np.ndarray

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def number(self, x: np.ndarray) -> np.ndarray:
        """Number of each frequent word; -1 for others."""
        return _found(self.word, x)

    def before(self, x: np.ndarray) -> np.ndarray:
        """Number of each frequent word, the start's being the last; -1 for others."""
        return np.where(x == _START, len(self.word), self.number(x))

    def pairs(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """word's number times (number of frequent words + 1) plus the one's before it; -1 if either isn't frequent."""
        w, h = self.number(word), self.before(before)
        return np.where((w >= 0) & (h >= 0), w * (len(self.word) + 1) + h, -1)

    def triples(self, pair_at: np.ndarray, further: np.ndarray) -> np.ndarray:
        """A frequent pair's place times (number of frequent words + 1) plus the number before it; -1 if either isn't frequent."""
        h = self.before(further)
        return np.where((pair_at >= 0) & (h >= 0), pair_at * (len(self.word) + 1) + h, -1)

    def pair_names(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted names of the frequent pairs, and their counts."""
        words_ = np.append(self.word, _START)
        name = _pair_name(self.word[self.pair // len(words_)], _context(words_[self.pair % len(words_)])) if len(self.pair) else np.empty(0, U64)
        order = np.argsort(name)
        return name[order], self.pair_count[order]


def _found(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in a sorted array; -1 if it isn't there."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def frequent(docs: DataFrame, config: ModelConfig) -> Frequent:
    """docs: doc_id, text, held_out."""
    counted = written(_counted(docs, lambda t: t.word), "lm-words")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    few = counted.where(F.col("n") * config.frequent >= total).collect()
    few.sort(key=lambda r: r.key & ((1 << 64) - 1))
    word = np.array([r.key for r in few], np.int64).view(U64)
    texts = next((r.n for r in few if np.int64(r.key).view(U64) == _END), None)
    if texts is None:
        texts = (counted.where(F.col("key") == int(_END)).agg(F.sum("n")).first()[0]) or 0
    none = np.empty(0, np.int64)
    known = Frequent(total, distinct, texts, word, np.array([r.n for r in few], np.int64), none, none, none, none)

    def kept(of) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a ten-thousandth of all tokens or more, and their counts."""
        rows = _counted(docs, of).where(F.col("n") * config.frequent_pairs >= total).collect() if total else []
        rows.sort(key=lambda r: r.key)
        return np.array([r.key for r in rows], np.int64), np.array([r.n for r in rows], np.int64)

    def both(t: _Tokens, f: Frequent = known) -> np.ndarray:
        pair = f.pairs(t.word, t.before)
        return pair[pair >= 0].astype(U64)

    pair, pair_count = kept(both)
    known = Frequent(total, distinct, texts, word, known.count, pair, pair_count, none, none)

    def three(t: _Tokens, f: Frequent = known) -> np.ndarray:
        triple = f.triples(_found(f.pair, f.pairs(t.word, t.before)), t.further)
        return triple[triple >= 0].astype(U64)

    triple, triple_count = kept(three) if len(pair) else (none, none)
    return Frequent(total, distinct, texts, word, known.count, pair, pair_count, triple, triple_count)


_PLACE = np.dtype([("doc", "<u2"), ("score", "<f8"), ("base", "<f8"), ("known", "<u4")])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's rows differ from those before them."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _packed(word: np.ndarray, context: np.ndarray, further: np.ndarray, mark: np.ndarray) -> bytes:
    """Triples in the order of word, context and further: each distinct one once, with its places; five bytes a context, four a further."""
    triple, pair, own = _heads(word, context, further), _heads(word, context), _heads(word)
    many = lambda inner, outer: np.diff(np.append(np.searchsorted(inner, outer), len(inner))).astype("<u4")
    times = np.diff(np.append(triple, len(word))).astype("<u4")
    sizes = zlib.compress(many(pair, own).tobytes() + many(triple, pair).tobytes() + times.tobytes(), 1)
    low = np.ascontiguousarray(context[pair].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8])
    front = np.array([len(own), len(pair), len(triple), len(word), len(sizes)], "<i8")
    return front.tobytes() + word[own].tobytes() + further[triple].astype("<u4").tobytes() + low.tobytes() + mark.tobytes() + sizes


@dataclass
class _Places:
    """What _packed() holds, without a copy: words; words before them, five bytes each, and how many each word has; words before those; times and marks of places."""

    word: np.ndarray
    context: np.ndarray
    of_word: np.ndarray
    further: np.ndarray
    of_pair: np.ndarray
    times: np.ndarray
    mark: np.ndarray


def _unpacked(blob: bytes | pa.Buffer) -> _Places:
    a, b, c, d, size = np.frombuffer(blob, "<i8", 5)
    own = np.frombuffer(blob, "<u8", a, 40)
    further = np.frombuffer(blob, "<u4", c, 40 + 8 * a)
    at = 40 + 8 * a + 4 * c
    context = np.frombuffer(blob, np.uint8, b * 5, at).reshape(b, 5)
    at += 5 * b
    mark = np.frombuffer(blob, "<u2", d, at)
    sizes = np.frombuffer(zlib.decompress(memoryview(blob)[at + 2 * d : at + 2 * d + size]), "<u4")
    return _Places(own, context, sizes[:a], further, sizes[a : a + b], sizes[a + b :], mark)


_FURTHER = U64((1 << FURTHER_BITS) - 1)
_CONTEXT = U64((1 << CONTEXT_BITS) - 1)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(x, return_inverse=True), with numbers of four bytes."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    x = x[new]
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return x, at


def _below(at: np.ndarray, many: np.ndarray, bits: int, inner: np.ndarray) -> np.ndarray:
    """Each number of at so many times, in front of inner's bits."""
    key = np.repeat(at.astype(U64), many)
    key <<= U64(bits)
    key |= inner
    return key


@dataclass
class Grams:
    """Distinct words, pairs and triples of a shard, sorted; a pair is its word's number and the context, a triple its pair's number and the further one."""

    word: np.ndarray
    pair: np.ndarray
    triple: np.ndarray

    @staticmethod
    def of(word: np.ndarray, context: np.ndarray, of_word: np.ndarray, further: np.ndarray, of_pair: np.ndarray) -> tuple[Grams, np.ndarray]:
        """The grams, and the number of the triple that each entry of further is."""
        names, at = _numbered(word)
        pairs, at = _numbered(_below(at, of_word, CONTEXT_BITS, context))
        triples, at = _numbered(_below(at, of_pair, FURTHER_BITS, further))
        return Grams(names, pairs, triples), at

    @staticmethod
    def of_places(places: list[_Places]) -> tuple[Grams, np.ndarray]:
        """The same for all places together; of a level, no more than its entries are held at once."""
        names, at = _numbered(np.concatenate([x.word for x in places]))
        context = np.zeros((sum(len(x.context) for x in places), 8), np.uint8)
        np.concatenate([x.context for x in places], out=context[:, :5])
        pairs, at = _numbered(_below(at, np.concatenate([x.of_word for x in places]), CONTEXT_BITS, context.view("<u8")[:, 0]))
        del context
        triples, at = _numbered(_below(at, np.concatenate([x.of_pair for x in places]), FURTHER_BITS, np.concatenate([x.further for x in places])))
        return Grams(names, pairs, triples), at

    @property
    def word_of(self) -> np.ndarray:
        """The number of each pair's word."""
        return (self.pair >> U64(CONTEXT_BITS)).astype(np.int64)

    @property
    def pair_of(self) -> np.ndarray:
        """The number of each triple's pair."""
        return (self.triple >> U64(FURTHER_BITS)).astype(np.int64)

    def pair_names(self) -> np.ndarray:
        return _pair_name(self.word[self.word_of], self.pair & _CONTEXT)


def _sent(docs: DataFrame, known: Frequent, shards: int, config: ModelConfig) -> DataFrame:
    """shard, chunk, kind, data: places for each shard (kind 0), and each chunk's own rows (kind 1)."""
    broadcast = shared(docs.sparkSession, known)
    m, a = config.pseudo, config.pair_weight

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Frequent = broadcast.value
        log_mass, part = np.log10(f.mass), 0
        for batch in batches:
            for at, texts in _parts(batch, _CHUNK):
                t, n = tokens(texts), len(texts)
                ids = batch.column("doc_id").slice(at.start, n)
                out = np.asarray(batch.column("held_out").slice(at.start, n).to_numpy(zero_copy_only=False), bool)
                number = f.number(t.word)
                base, score, seen = np.zeros(n), np.full(n, -np.log10((1 + a) * f.texts + m)), np.zeros(n, np.int64)
                own = number >= 0
                some = np.flatnonzero(own)
                base += np.bincount(t.text[some], np.log10(f.count[number[some]] + 0.5) - log_mass, n)
                seen += np.bincount(t.text[some], minlength=n)
                pair = _found(f.pair, f.pairs(t.word, t.before))
                some = np.flatnonzero((pair >= 0) & (t.word != _END))
                score -= np.bincount(t.text[some], np.log10(f.pair_count[pair[some]] + a * f.count[number[some]] + m), n)
                triple = _found(f.triple, f.triples(pair, t.further))
                some = np.flatnonzero(triple >= 0)
                p = (f.count[number[some]] + 0.5) / f.mass
                score += np.bincount(t.text[some], np.log10(f.triple_count[triple[some]] + a * f.pair_count[pair[some]] + m * p), n)
                away = np.flatnonzero(triple < 0)
                chunk = (TaskContext.get().partitionId() << 32) + part
                part += 1
                rest = np.rec.fromarrays([base, score, seen, np.bincount(t.text, minlength=n), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), out], names="base,score,seen,tokens,doc,null,out")
                rows = [(chunk % shards, chunk, 1, rest.tobytes())]
                word, context, further = t.word[away], _context(t.before[away]), _further(t.further[away])
                name = _pair_name(word, context)
                to = np.where(pair[away] >= 0, mix(name + further), np.where(own[away], name, word)) % U64(shards)
                one = np.ones(len(away), np.int64)
                _, gram = Grams.of(word, context, one, further, one)
                order = np.argsort((to << U64(max(1, len(away).bit_length()))) | gram.astype(U64), kind="stable")
                text = t.text[away]
                mark = (text | ((~out[text]).astype(np.int64) << 15)).astype("<u2")
                to, word, context, further, mark = (x[order] for x in (to, word, context, further, mark))
                cut = np.append(_heads(to), len(to)).tolist()  # only shards that the chunk has tokens for
                rows += [(int(to[i]), chunk, 0, _packed(word[i:j], context[i:j], further[i:j], mark[i:j])) for i, j in pairwise(cut)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["shard", "chunk", "kind", "data"])

    return docs.mapInArrow(told, "shard long, chunk long, kind int, data binary")


def build(grams: Grams, count: np.ndarray, known: Frequent, config: ModelConfig) -> Trie:
    """The trie of a shard's triples that have training counts (count: each triple's)."""
    three = np.flatnonzero(count)
    two = np.zeros(len(grams.pair), np.int64)
    for some in in_blocks(len(count)):
        np.add.at(two, (grams.triple[some] >> U64(FURTHER_BITS)).astype(np.int64), count[some])
    one = np.bincount(grams.word_of, two, len(grams.word)).astype(np.int64)
    pair, own = np.flatnonzero(two), np.flatnonzero(one)
    new_pair, new_word = np.cumsum(two > 0, dtype=np.int32) - np.int32(1), np.cumsum(one > 0, dtype=np.int32) - np.int32(1)
    further, count = grams.triple[three], count[three]
    of_pair = new_pair[further >> U64(FURTHER_BITS)]
    further &= _FURTHER
    third = Level.of(len(pair), of_pair, further, FURTHER_BITS)
    del further, three, new_pair
    names, of_word = grams.word[own], new_word[grams.word_of[pair]]
    one, two = one[own], two[pair]
    number = known.number(names)
    one[number >= 0] = known.count[number[number >= 0]]
    pair_names, pair_counts = known.pair_names()
    at = _found(pair_names, grams.pair_names()[pair])
    two[at >= 0] = pair_counts[at[at >= 0]]
    m, a = config.pseudo, config.pair_weight
    alone = a * two + m * (one[of_word] + 0.5) / known.mass
    value = alone[of_pair]
    value += count
    value = Values.of(np.log10(value, out=value))
    weight = Values.of(np.log10(two + a * one[of_word] + m))
    second = Level.of(len(own), of_word, grams.pair[pair] & _CONTEXT, CONTEXT_BITS)
    return Trie(EliasFano.of(names, 64), one, second, Values.of(np.log10(alone)), weight, third, value)


def _scored(table: pa.Table, known: Frequent, config: ModelConfig) -> pa.Table:
    """chunk, kind, data: a shard's partial sums (kind 0) and what passes through (kind 1)."""
    kind, chunk, data = table["kind"].to_numpy(), table["chunk"].to_numpy(), table["data"]
    places = [(int(chunk[i]), _unpacked(data[int(i)].as_buffer())) for i in np.flatnonzero(kind == 0)]
    out = [(int(chunk[i]), 1, data[int(i)].as_py()) for i in np.flatnonzero(kind == 1)]
    if places:
        grams, at = Grams.of_places([x for _, x in places])
        cut = np.cumsum([0, *(len(x.further) for _, x in places)])
        count = np.zeros(len(grams.triple), np.int64)
        for (_, x), i, j in zip(places, cut[:-1], cut[1:], strict=True):
            np.add.at(count, at[i:j], np.add.reduceat((x.mark >> 15).astype(np.int64), np.cumsum(x.times, dtype=np.int64) - x.times))
        with tempfile.TemporaryDirectory(prefix="loam-trie-") as folder:  # mapped, so its pages can leave memory again
            path = os.path.join(folder, "trie")
            with open(path, "wb") as f:
                build(grams, count, known, config).write(f)
            del count
            score, word_of, base, seen = _looked_up(Trie.open(path), grams, known, config)
        del grams
        for (name, x), i, j in zip(places, cut[:-1], cut[1:], strict=True):
            text = (x.mark & 0x7FFF).astype(np.int64)
            n = int(text.max()) + 1
            word = word_of[at[i:j]]
            sums = [np.bincount(text, np.repeat(v, x.times), n) for v in (score[at[i:j]], base[word], seen[word])]
            some = np.flatnonzero(np.bincount(text, minlength=n))
            part = np.empty(len(some), _PLACE)
            part["doc"], part["score"], part["base"], part["known"] = some, sums[0][some], sums[1][some], sums[2][some]
            out.append((name, 0, part.tobytes()))
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    give_back()
    return pa.table({"chunk": pa.array(a, pa.int64()), "kind": pa.array(b, pa.int32()), "data": pa.array(c, pa.binary())})


def _looked_up(trie: Trie, grams: Grams, known: Frequent, config: ModelConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each triple adds to its texts' score, and its word's number; what each word adds to the base score and to the known tokens."""
    m, a = config.pseudo, config.pair_weight
    number, often = trie.find(grams.word), known.number(grams.word)
    one = np.where(number >= 0, trie.counts[number] if trie.words.n else 0, 0)
    one[often >= 0] = known.count[often[often >= 0]]
    pair_names, pair_counts = known.pair_names()
    pair, word_of = np.empty(len(grams.pair), np.int32), np.empty(len(grams.pair), np.int32)
    alone, weight = np.empty(len(pair)), np.empty(len(pair))
    for some in in_blocks(len(pair)):
        key = grams.pair[some]
        word = (key >> U64(CONTEXT_BITS)).astype(np.int64)
        at = trie.second.find(number[word], key & _CONTEXT)
        more, less = trie.alone.get(at), trie.weight.get(at)
        both = _found(pair_names, _pair_name(grams.word[word], key & _CONTEXT))
        two = np.zeros(len(at), np.int64)
        two[both >= 0] = pair_counts[both[both >= 0]]
        lacks = np.flatnonzero(at < 0)
        more[lacks] = np.log10(a * two[lacks] + m * (one[word[lacks]] + 0.5) / known.mass)
        less[lacks] = np.log10(a * one[word[lacks]] + m)
        # What a frequent pair is as a context was added where the text is, and so was the base of frequent words.
        less[(both >= 0) | (grams.word[word] == _END)] = 0.0
        pair[some], word_of[some], alone[some], weight[some] = at, word, more, less
    score, of_triple = np.empty(len(grams.triple)), np.empty(len(grams.triple), np.int32)
    for some in in_blocks(len(score)):
        key = grams.triple[some]
        at = (key >> U64(FURTHER_BITS)).astype(np.int64)
        value = trie.value.get(trie.third.find(pair[at], key & _FURTHER))
        score[some] = np.where(np.isnan(value), alone[at], value) - weight[at]
        of_triple[some] = word_of[at]
    rare = often < 0
    base = np.where(rare, np.log10(one + 0.5) - np.log10(known.mass), 0.0)
    return score, of_triple, base, (rare & (one > 0)).astype(float)


_REST = np.dtype([("base", "<f8"), ("score", "<f8"), ("seen", "<i8"), ("tokens", "<i8"), ("doc", "<i8"), ("null", "?"), ("out", "?")])


def _added(table: pa.Table, total: int) -> pa.Table:
    """A chunk's texts with their sums."""
    kind, data = table["kind"].to_numpy(), table["data"]
    rest = np.frombuffer(data[int(np.flatnonzero(kind == 1)[0])].as_py(), _REST)
    score, base, seen = rest["score"].copy(), rest["base"].copy(), rest["seen"].copy()
    for i in np.flatnonzero(kind == 0):
        part = np.frombuffer(data[int(i)].as_py(), _PLACE)
        score[part["doc"]] += part["score"]
        base[part["doc"]] += part["base"]
        seen[part["doc"]] += part["known"]
    return pa.table({"doc_id": pa.array(rest["doc"], mask=rest["null"]), "held_out": pa.array(rest["out"]), "n_tokens": pa.array(rest["tokens"]), "n_known": pa.array(seen), "train_tokens": pa.array(np.full(len(rest), total)), "base_score": pa.array(base), "score": pa.array(score)})


def score(docs: DataFrame, config: ModelConfig | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    config = config or ModelConfig()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    with scratch(docs.sparkSession) as own:
        known = frequent(rows, config)
        shards = max(config.least_shards, -(-known.total // config.tokens_a_shard))
        broadcast = shared(docs.sparkSession, known)
        total = known.total
        sums = _sent(rows, known, shards, config).groupBy("shard").applyInArrow(lambda t: _scored(t, broadcast.value, config), "chunk long, kind int, data binary")
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        out = written(sums.groupBy("chunk").applyInArrow(lambda t: _added(t, total), schema), "lm-scores")
        own.keep(out)
    return out
