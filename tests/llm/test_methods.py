"""The data structures alone, against plain computations."""

import collections
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import eliasfano, fmindex, language_model, licenses, mixing, substrings, topk, toxicity, warc, words

U64 = np.uint64


def test_words_agree_with_split():
    texts = [b"Hello  World", b"", b" a b A\x0b", "été Ça Été".encode(), b"x" * 3000, b"\x1cone\x1c two"]
    for rule, plain in ((words.SPACED, lambda t: t.split()), (words.SPACED_LOWER, lambda t: t.lower().split())):
        found = words.words(texts, rule)
        assert [[found.word(k) for k in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:])] == [plain(t) for t in texts]
    assert len(set(found.hash.tolist())) == len({found.word(k) for k in range(len(found.hash))})


def test_rolling_hash_is_the_same_everywhere():
    code = words.mix(np.arange(50, dtype=U64) % U64(5))
    rolled = words.rolling(code, 10)
    assert (rolled[:30] == rolled[5:35]).all()
    assert len(np.unique(rolled)) == 5
    assert len(words.rolling(code[:3], 10)) == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, 1 << 40, n).astype(U64))
    held, _ = eliasfano.EliasFano.view(eliasfano.EliasFano.of(values, 40).dump(), 0)
    assert (held.get(np.arange(n)) == values).all()
    asked = np.concatenate([values, rng.integers(0, 1 << 40, 200).astype(U64), np.array([0, (1 << 40) - 1], U64)])
    assert (held.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_from_a_file(tmp_path):
    """Counts, both values of pairs and those of triples, looked up in a mapped file."""
    rng = np.random.default_rng(3)
    none = np.empty(0, np.int64)
    known = language_model.Frequent(5000, 300, 10, np.empty(0, U64), none, none, none, none, none)
    config = language_model.ModelConfig()
    names = np.unique(rng.integers(0, 1 << 63, 300).astype(U64))
    word, context, further = names[rng.integers(0, len(names), 4000)], rng.integers(0, 1 << 40, 40)[rng.integers(0, 40, 4000)].astype(U64), rng.integers(0, 5, 4000).astype(U64)
    count, single = rng.integers(0, 4, 4000), np.ones(4000, np.int64)
    grams, at = language_model.Grams.of(word, context, single, further, single)
    (tmp_path / "trie").write_bytes(language_model.build(grams, np.bincount(at, count).astype(np.int64), known, config).dump())
    trie = eliasfano.Trie.open(str(tmp_path / "trie"))
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for w, v, u, c in zip(word.tolist(), context.tolist(), further.tolist(), count.tolist()):
        one[w] += c
        two[w, v] += c
        three[w, v, u] += c
    number = trie.find(word)
    pair = trie.second.find(number, context)
    triple = trie.third.find(pair, further)
    for i, (w, v, u) in enumerate(zip(word.tolist(), context.tolist(), further.tolist())):
        assert (number[i] >= 0, pair[i] >= 0, triple[i] >= 0) == (one[w] > 0, two[w, v] > 0, three[w, v, u] > 0)
    part = config.pseudo / known.mass
    for at, values, expected in (
        (pair, trie.alone, [config.pair_weight * two[k] + part * (one[k[0]] + 0.5) for k in zip(word.tolist(), context.tolist())]),
        (pair, trie.weight, [two[k] + config.pair_weight * one[k[0]] + config.pseudo for k in zip(word.tolist(), context.tolist())]),
        (triple, trie.value, [three[k] + config.pair_weight * two[k[:2]] + part * (one[k[0]] + 0.5) for k in zip(word.tolist(), context.tolist(), further.tolist())]),
    ):
        assert np.allclose(values.get(at)[at >= 0], np.log10(expected)[at >= 0], atol=1e-3)
    assert (trie.counts[number[number >= 0]] == np.array([one[w] for w in word.tolist()])[number >= 0]).all()
    assert trie.find(np.array([12345], U64))[0] == -1
    assert (trie.second.find(number, context ^ U64(1 << 39)) == -1).all()


@pytest.mark.parametrize("wide", [1, 2, 3, 7, 28, 32])
def test_first_least(wide):
    order = np.random.default_rng(wide).integers(0, 9, 200).astype(U64)
    assert substrings.first_least(order, wide).tolist() == [i + int(np.argmin(order[i : i + wide])) for i in range(200 - wide + 1)]


def _shard(places, chunks):
    """Rows as a shard of the language model gets them: random places, a fifth of them in texts that are held out."""
    rng, rows = np.random.default_rng(1), []
    for chunk in range(chunks):
        word, context, further = (rng.integers(0, n, places // chunks).astype(U64) for n in (3_000, 300, 5_000))
        word = words.mix(word)
        order = np.lexsort((further, context, word))
        text = np.sort(rng.integers(0, 1_000, places // chunks))
        mark = (text | ((text % 5 > 0).astype(np.int64) << 15)).astype("<u2")
        rows.append((chunk, 0, language_model._packed(word[order], context[order], further[order], mark[rng.permutation(len(mark))])))
    return pa.table({"chunk": [r[0] for r in rows], "kind": pa.array([r[1] for r in rows], pa.int32()), "data": [r[2] for r in rows]})


def test_memory_of_scoring_a_shard(monkeypatch):
    none = np.empty(0, np.int64)
    known, table = language_model.Frequent(5_000_000, 3_000, 1_000, np.empty(0, U64), none, none, none, none, none), _shard(600_000, 10)
    tracemalloc.start()
    at_once = language_model._scored(table, known, language_model.ModelConfig())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 * 600_000
    monkeypatch.setattr(eliasfano, "BLOCK", 1_000)
    assert language_model._scored(table, known, language_model.ModelConfig()).equals(at_once)


def test_tokens_of_much_text_are_those_of_each_text():
    texts = [b"", b"Aa b " * 150_000, b"", b"c", b"d e " * 400_000, b" ", b"f"]
    found = language_model.tokens(texts)
    each = [language_model.tokens([x]) for x in texts]
    for c in ("word", "before", "further"):
        assert (getattr(found, c) == np.concatenate([getattr(x, c) for x in each])).all()
    assert (found.text == np.repeat(np.arange(len(texts)), [len(x.word) for x in each])).all()
    tracemalloc.start()
    language_model.tokens([b"word " * 2_000] * 1_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 10_000_000


def test_fm_index_counts_and_statistics():
    rng = np.random.default_rng(5)
    pieces = [rng.integers(0, 4, rng.integers(1, 30)) for _ in range(40)]
    index = fmindex.FMIndex(pieces, 4)
    text = rng.integers(0, 4, 200)
    places = lambda p: sum((x[i : i + len(p)] == p).all() for x in pieces for i in range(len(x) - len(p) + 1))
    for end in range(1, 200):
        expected = 0
        while expected < min(end, 8) and places(text[end - expected - 1 : end]) >= 2:
            expected += 1
        assert index.statistics(text, np.array([end]), 8)[0] == expected


def test_block_top_equals_brute_force():
    rng = np.random.default_rng(1)
    for scale in (3, 1 << 23):
        x = np.floor(rng.normal(size=(300, 8)) * scale)
        ids, q = np.arange(300), np.arange(0, 300, 20)
        turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        number, item, score = topk.block_top(x[q], ids[q], x, ids, turn, 5, 3, step=64)
        for k, i in enumerate(q):
            full = [sum(int(a) * int(b) for a, b in zip(x[i], y)) for y in x]
            best = sorted((-s, j) for j, s in enumerate(full) if j != i)[:5]
            assert [(-int(s), int(j)) for j, s in zip(item[number == k], score[number == k])] == best


def test_pointer_jumping_follows_one_chain():
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(5000, 400, replace=False)).astype(np.int64)
    to = np.where(rng.random(400) < 0.1, -1, at + rng.integers(1, 60, 400))
    to = np.where(rng.random(400) < 0.7, np.append(at, 9999)[np.minimum(np.searchsorted(at, to), 400)], to)
    place = {x: i for i, x in enumerate(at.tolist())}
    leaves = warc.followed(at, to)
    for i in range(400):
        k = i
        while to[k] in place:
            k = place[int(to[k])]
        assert leaves[i] == to[k]
    seen, k = set(), int(at[3])
    while k in place:
        seen.add(k)
        k = int(to[place[k]])
    assert set(at[warc.reached(at, to, np.array([at[3]]))].tolist()) == seen


def test_min_cost_flow_repeats_as_little_as_it_can():
    given = mixing.routed({("a",): 100, ("b",): 100, ("a", "b"): 100}, {"a": 200, "b": 100}, 2)
    assert given == {("a",): 100, ("b",): 100, ("a", "b"): 100}
    # Of all ways to meet the quotas the cheapest repeats the fewest words.
    patterns, quotas = {("a",): 3, ("b",): 2, ("a", "b"): 4, ("c",): 5}, {"a": 7, "b": 4, "c": 7}
    given = mixing.routed(patterns, quotas, 2)
    cost = lambda n, size: sum(min(max(n - k * size, 0), size) * k * k for k in range(2))
    ways = [(a, b, ab) for a in range(7) for b in range(5) for ab in range(9) if a <= 7 and b <= 4 and a + b + ab == 11]
    best = min(cost(a, 3) + cost(b, 2) + cost(ab, 4) for a, b, ab in ways)
    assert sum(given[p] for p in [("a",), ("b",), ("a", "b")]) == 11
    assert sum(cost(given[p], patterns[p]) for p in [("a",), ("b",), ("a", "b")]) == best
    assert given["c",] == 7
    assert mixing.routed({("a",): 10}, {"a": 50}, 2) == {("a",): 20}


def test_targets_stop_at_twice_the_size():
    got = mixing.targets({"a": 10, "b": 1000, None: 100}, mixing.MixConfig())
    assert got["a"] == 20
    assert got[None] == 200
    assert sum(got.values()) == pytest.approx(1.5 * 1110)
    assert mixing.targets({}, mixing.MixConfig()) == {}
    assert mixing.targets({"a": 0}, mixing.MixConfig()) == {"a": 0}


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(2)
    # Terms 0 and 1 are harmless alone; only together do they make the label 1.
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    terms = [np.array(sorted({*([0] * int(x)), *([1] * int(y)), 2 + i % 7}), np.int64) for i, (x, y) in enumerate(zip(a, b))]
    label = (a & b).astype(float)
    model = toxicity.fit(terms, label, toxicity.ToxicityConfig(epochs=60, rate=0.2, l1=0))
    row = np.repeat(np.arange(4), [0, 1, 1, 2])
    found = model.margins(row, np.array([0, 1, 0, 1]), 4)
    assert found[3] > 0 > max(found[:3])


def test_scanner_finds_phrases_and_chains():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, 3, 6, 0.75)
    out = licenses._scanned(scanner, [b"Under the MIT License, under the mit license. Then CC BY-NC 4.0!", b"", b"Licensed under the GNU General Public License, version 3.", b"of the license and the terms", b"under the", b"mit license"])
    assert [len(x) for x in out["places"]] == [3, 0, 0, 0, 0, 0]
    assert [x["first_word"] for x in out["places"][0]] == [0, 4, 9]
    assert [[x["label"] for x in y] for y in out["spans"]] == [["mit", "mit"], [], ["gpl-3"], [], [], []]


@pytest.mark.parametrize("k", range(len(licenses.TEXTS)))
def test_whole_licence_texts_are_spans(k):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, 3, 6, 0.75)
    label, text = licenses.TEXTS[k]
    own = licenses.word_list(text)
    changed = b" ".join(b"CHANGED" if i % 40 == 20 else w for i, w in enumerate(own))
    spans = licenses._scanned(scanner, [b"Some words before. " + changed + b" and after"])["spans"][0]
    assert label in {x["label"] for x in spans}
    assert {x["label"] for x in spans} <= {label, "bsd-3"}
    whole = max(spans, key=lambda x: x["covered"])
    assert whole["first_word"] == 3
    assert whole["last_word"] == 2 + len(own)


def test_model_sums_to_one():
    one, two, three = {"a": 50, "b": 30, "e": 20}, {"a": 5, "b": 1}, {"a": 2}
    config, mass = language_model.ModelConfig(), 100 + 0.5 * 4
    a, m = config.pair_weight, config.pseudo
    total = sum((three.get(w, 0) + a * two.get(w, 0) + m * (one.get(w, 0) + 0.5) / mass) / (2 + a * 6 + m) for w in [*one, "unknown"])
    assert total == pytest.approx(1)
