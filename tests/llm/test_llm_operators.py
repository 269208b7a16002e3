"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import decontamination, jaccard, language_model, licenses, mixing, pii, substrings, topk, toxicity, warc

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, seq string, score double"


def words(text):
    return (text or "").encode().split()


def base_text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in rng.integers(0, 400, n))


@pytest.fixture(scope="module")
def texts():
    a, b, passage = base_text(1, 300), base_text(2, 200), base_text(3, 60)
    near = a.split()
    near[150] = "changed"
    out = {
        1: a, 2: a, 3: " ".join(near), 4: b, 5: b + " " + passage, 6: base_text(4, 90) + " " + passage + " tail", 7: "", 8: None, 9: "one two", 10: "One  two",
        11: "one two three", 12: "same " * 80, 13: base_text(5, 6000), 14: "É é İ ı\x0bx", 15: base_text(3, 60), 16: "  \n\t ", 17: passage + " " + passage, 18: base_text(6, 36), 19: base_text(6, 35),
    }
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "clash", 1.0) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_substrings(docs, empty, texts):
    listed = {i: words(t) for i, t in texts.items()}
    count = collections.Counter(tuple(w[k : k + 35]) for w in listed.values() for k in range(len(w) - 34))
    expected = {}
    for i, w in listed.items():
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        expected[i] = len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()
    columns = ("n_words", "n_removed", "kept_sha256")
    assert by_id(substrings.dedupe(docs), *columns) == expected
    assert by_id(substrings.dedupe(docs, substrings.SubstringConfig(hot=1, regions_a_shard=3)), *columns) == expected
    assert substrings.dedupe(empty).count() == 0
    kept = by_id(substrings.dedupe(docs, texts=True), "n_removed", "kept_sha256", "kept_text")
    assert {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, (n, _, t) in kept.items()} == {i: x[1:] for i, x in expected.items()}


def test_substrings_with_null_and_repeated_ids(spark):
    a, b, passage = base_text(21, 80), base_text(22, 80), base_text(23, 50)
    rows = [(None, a), (1, a), (2, b), (2, b), (3, passage), (3, f"x {passage} y"), (None, f"{base_text(24, 40)} {passage}"), (4, base_text(25, 500))]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, seq string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedupe(docs).collect()), key=str)
    assert got == sorted([(None, 80, 80), (1, 80, 80), (2, 80, 80), (2, 80, 80), (3, 50, 50), (3, 52, 50), (None, 90, 0), (4, 500, 0)], key=str)


def test_jaccard(docs, empty, texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    expected = {i: (len(sets[i]), root[i]) for i in sets}
    assert by_id(jaccard.join(docs), "n_shingles", "component_id") == expected
    assert by_id(jaccard.join(docs, jaccard.JaccardConfig(piece=1, queries=1)), "n_shingles", "component_id") == expected
    assert jaccard.join(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in root if root[i] == i}


@pytest.fixture(scope="module")
def chain(spark):
    """Near copies where each links with its neighbours only."""
    base, rows = base_text(9, 120).split(), []
    for i in range(12):
        rows.append((100 + i, " ".join(base)))
        for k in range(3):
            base[(i * 9 + k * 2) % 120] = f"edit{i}x{k}"
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_follows_chains(chain):
    texts = {r.doc_id: r.text.split() for r in chain.collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in texts.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert by_id(jaccard.join(chain), "component_id") == {i: (r,) for i, r in root.items()}


def test_decontamination(spark, docs, empty, texts):
    passage = texts[15]
    items = [(1, passage), (2, base_text(3, 9)), (10, base_text(2, 12).upper()), (3, ""), (4, None), (None, passage), (5, "one TWO"), (1, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        if i is not None and w:
            for k in range(max(0, len(w) - 10) + 1):
                wins[tuple(w[k : k + 10])].add(i)
    expected = {}
    for i, t in texts.items():
        w, hit, found = split(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        names = ",".join(sorted(map(str, found)))
        expected[i] = len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontamination.decontaminate(docs, bench), *columns) == expected
    assert by_id(decontamination.decontaminate(docs, bench, broadcast_windows=0), *columns) == expected
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(docs, bench.where("false")).collect())
    assert {r.doc_id for r in decontamination.keep_clean(docs, bench).collect()} == {i for i, x in expected.items() if not x[4]}


def test_language_model(spark, docs, empty, texts):
    texts = texts | {30: "same same same", 31: "a b a b a b a b", 32: "b a"}
    rows = [(i, t, "en", "s", 0, "clash", 1.0) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, (None, "a b never learnt", "en", "s", 0, "", 0.0)], DOCS).repartition(3)
    listed = {i: (t or "").encode().lower().split() + ["</s>"] for i, t in texts.items()}
    learnt = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in texts}
    places = lambda w: zip(["<s>", "<s>", *w], ["<s>", *w], w)
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in listed.items():
        if learnt[i]:
            one.update(w)
            two.update(zip(["<s>", *w], w))
            three.update(places(w))
    total, mass = sum(one.values()), sum(one.values()) + 0.5 * (len(one) + 1)
    context, contexts = collections.Counter(one), collections.Counter(two)
    context["<s>"] = contexts["<s>", "<s>"] = sum(learnt.values())
    for config in (language_model.ModelConfig(), language_model.ModelConfig(frequent=3, frequent_pairs=20, least_shards=2), language_model.ModelConfig(frequent=300, frequent_pairs=300, pair_weight=0.3)):
        a, m = config.pair_weight, config.pseudo
        rows = language_model.score(docs, config).collect()
        got = {r.doc_id: r for r in rows}
        assert len(rows) == len(texts) + 1
        assert got[None].held_out
        for i, w in listed.items():
            base = sum(math.log10((one[x] + 0.5) / mass) for x in w)
            score = sum(math.log10((three[u, v, x] + a * two[v, x] + m * (one[x] + 0.5) / mass) / (contexts[u, v] + a * context[v] + m)) for u, v, x in places(w))
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learnt[i], len(w), sum(one[x] > 0 for x in w), total)
            assert r.base_score == pytest.approx(base)
            assert r.score == pytest.approx(score, rel=1e-3)
    assert language_model.score(empty).count() == 0


def spark_rows(docs, rows):
    return docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing(docs, empty, texts):
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {i: len(words(t)) for i, t in texts.items()}
    assert {i: r.size for i, r in rows.items()} == size
    sources = collections.defaultdict(int)
    for r in rows.values():
        sources[r.source] += r.taken
    for r in rows.values():
        assert sources[r.source] == pytest.approx(r.target, abs=1)
        assert 0 <= r.taken <= 2 * r.size
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(1)).collect()}
    assert again == {i: r.taken for i, r in rows.items()}
    assert mixing.mix(empty).count() == 0
    # A source without words keeps its place in the order of weights.
    ten = " ".join("abcdefghij")
    few = spark_rows(docs, [(1, ten, "a"), (2, "", "b"), (3, ten[:9], "c"), (3, ten[10:], "c"), (4, ten, "d"), (4, None, "d")])
    got = {r.source: (r.source_size, r.target) for r in mixing.mix(few).collect()}
    assert got == {"a": (10, 16.875), "b": (0, 0.0), "c": (10, 11.25), "d": (10, 16.875)}
    both = mixing.mix(docs, F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).collect()
    assert sum(r.taken for r in both) == pytest.approx(1.5 * sum(size.values()), abs=2)


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(60)] + [(60, None, ""), (80, [1.0, None], ""), (100, [float("nan")] * 6, ""), (61, [float("inf")] * 6, ""), (120, [0.5], ""), (62, [], "")]
    rows += [(i, rows[0][1], "copy") for i in range(200, 230)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for i in whole:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)[:20]
            expected += [(i, k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    for blocks in ({}, {"items_a_block": 16, "queries_a_block": 2}):
        got = topk.search(table, F.col("vec_id") % 20 == 0, **blocks)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(expected)
    assert topk.search(table.where("false"), F.lit(True)).count() == 0


def test_topk_over_lengths(spark):
    """Lengths from 1 to 1,000: a query visits few bands; with equal lengths, or fewer rows than k, it visits all."""
    rng = np.random.default_rng(5)
    for scale in (np.logspace(0, 3, 400), np.ones(400), np.zeros(400), np.ones(9)):
        x = np.floor(rng.normal(size=(len(scale), 5)) * scale[:, None] * 20) / 64
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        whole = np.floor(64 * x).astype(int)
        got = topk.search(table, F.col("vec_id") % 7 == 0, k=5, items_a_block=16, queries_a_block=8).collect()
        expected = []
        for i in range(0, len(x), 7):
            best = sorted((-int(whole[i] @ whole[j]), j) for j in range(len(x)) if j != i)[:5]
            expected += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == expected


def round_tripped(spark, rows, html=True):
    table = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in warc.round_trip(table, html=html).collect()]


def expected_records(rows, html=True):
    largest, out = {}, []
    for i, _, h, _ in rows:
        largest[h or ""] = max((x for x in (i, largest.get(h or "")) if x is not None), default=None)
    for i, _, h, _ in rows:
        body, top = (h or "").encode(), largest[h or ""]
        other = top is not None and top != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other else "response", top if other else None, None if other or not html else h or ""))
    return out


INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:loam:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAYLOADS = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc", "\r\n", "<p>a</p>", "b" * 100_000, INNER, "x" + INNER * 3 + "WARC/1.0\r\n", "WARC/1.0\r\n" * 5, "\r\n\r\n" + INNER]


def test_warc(spark):
    rows = [(i, f"http://x/{i}", h, "z") for i, h in enumerate(PAYLOADS)] + [(20, None, "u", ""), (None, "v", "w", ""), (None, "v", "w", ""), (None, "t\x00\r\n ", "<p>a</p>", ""), (7, "again", "b" * 100_000, ""), (3, "other", "other", "")]
    assert sorted(round_tripped(spark, rows), key=str) == sorted(expected_records(rows), key=str)
    assert sorted(round_tripped(spark, rows, html=False), key=str) == sorted(expected_records(rows, html=False), key=str)
    assert round_tripped(spark, []) == []
    urls = {r.page_id: r.url for r in warc.round_trip(spark.createDataFrame([(1, "a\r\nb c", "x"), (2, None, "y")], "page_id long, url string, html string")).collect()}
    assert urls == {1: "a%0D%0Ab%20c", 2: ""}


def test_warc_over_many_ranges(spark):
    """One archive of far more than a task's byte range, with magic and whole records inside payloads that cross ranges."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        body = "".join(rng.choice(["p" * 700, INNER, "WARC/1.0\r\n", "é" * 300, "\r\n\r\n"], rng.integers(0, 12)))
        rows.append((i, f"http://x/{i}", body if i % 50 else INNER * 400, ""))
    table = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").coalesce(1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "16384")
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in warc.round_trip(table).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(expected_records(rows), key=str)


def test_broken_archives_are_errors(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(INNER.encode() + b"x")
    with pytest.raises(ValueError, match="chain"):
        warc.read(spark, str(tmp_path)).collect()


LICENSED = ["Under the MIT License. cc by nc, under the mit license", "apache license, version 2.0 apache license", "under the mit", "the license", "a b a b a", "CC by nc cc BY nc", "MIT", "", None]


@pytest.mark.parametrize("phrases", [licenses.PHRASES, {"mit license": "two", "Apache": "one", "a b a": "odd", "under the mit license": "four"}])
def test_license_scan(spark, docs, empty, phrases):
    """Places against a plain search of each phrase at each word."""
    rows = [(i, t, "x") for i, t in enumerate(LICENSED)] + [(None, LICENSED[0], "y"), (0, LICENSED[0], "x"), (50, "word " * 70_000 + LICENSED[0], "z")]
    more = docs.select("doc_id", "text", "seq").collect()
    table = spark.createDataFrame(rows + [(r.doc_id + 100, r.text, r.seq) for r in more], "doc_id long, text string, labels string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = []
    for i, text, *_ in table.collect():
        w = word.findall((text or "").translate(LOWER))
        sought = {tuple(p.lower().split()): x for p, x in phrases.items()}
        at = [(k, x) for p, x in sought.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p]
        expected.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = licenses.scan(table, phrases=phrases).collect()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(expected, key=str)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0) for r in got if r.n_base)
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError, match="word"):
        licenses.scan(table, phrases={"--": "none"})


PEOPLE = [
    (1, "Write to anna.berg@mail.example.com or 10.1.2.3 now."),
    (2, "ANNA.BERG@mail.example.com again; card 4337166598464399, not 4337166598464398."),
    (3, "Mr. John Smith and Mrs. Mary SMITH met Dr. Smith. Call +1 (456) 555-2186."),
    (4, "No one here, Version 2.0."), (5, None), (6, ""), (7, "Phone 456-555-2186 and 123-45-6789 and 8.8.8.8"), (4, "No one here, Version 2.0."), (8, "г-жа Анна Иванова, г-н Иванов"),
]


def test_pii(spark):
    table = spark.createDataFrame([(i, t, "x") for i, t in PEOPLE], "doc_id long, text string, h string")
    out = pii.pseudonymise(table)
    got = {r.doc_id: r for r in out.collect()}
    assert len(out.collect()) == len(PEOPLE)
    assert [got[i].text for i in (4, 5, 6)] == ["No one here, Version 2.0.", None, ""]
    assert [got[i].n_pii for i in range(1, 8)] == [2, 2, 4, 0, 0, 0, 3]
    mail = re.search(r"\S+@\S+", got[1].text)[0]
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{4}@[a-z]{4}\.[a-z]{7}\.com", mail)
    assert mail != "anna.berg@mail.example.com"
    assert mail in got[2].text
    assert re.search(r" 10\.\d+\.\d+\.\d+ ", got[1].text)
    card = re.search(r"card (\d{16})", got[2].text)[1]
    digits = [int(c) for c in card[::-1]]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert card != "4337166598464399"
    assert "not 4337166598464398" in got[2].text
    john, smith, mary, upper, again = re.search(r"Mr\. (\w+(?:-\w+)?) (\w+) and Mrs\. (\w+(?:-\w+)?) (\w+) met Dr\. (\w+)", got[3].text).groups()
    assert upper == smith.upper()
    assert again == smith
    assert smith != "Smith"
    assert john.split("-")[0] in pii.GIVEN["latin", "m"]
    assert mary.split("-")[0] in pii.GIVEN["latin", "f"]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.$", got[3].text)
    assert re.search(r"г-жа [А-Я]\w+ ", got[8].text)
    assert pii.pseudonymise(table).orderBy("doc_id").collect() == out.orderBy("doc_id").collect()
    assert pii.pseudonymise(table.where("false")).count() == 0


def test_pii_surrogates_are_distinct(spark):
    names = [(i, f"Mr. Adam Name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)]
    table = spark.createDataFrame(names, "doc_id long, text string")
    got = [r.text for r in pii.pseudonymise(table).collect()]
    assert len({t.split()[-1].lower() for t in got}) == 600
    assert len({t.split()[1] for t in got}) == 1


def test_toxicity(spark, empty):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        body = [f"w{x}" for x in rng.integers(0, 80, 25)] + (["idiot", "scum"] if bad else [])
        rows.append((i, " ".join(body), "en", "s", 0, "", 0.0))
        marks.append((i, int(bad)))
    rows += [(1000, "", "en", "s", 0, "", 0.0), (1001, None, "en", "s", 0, "", 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([*marks, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 602
    for i, bad in marks:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == bad
        assert got[i].predicted == (got[i].score >= 0.5)
    assert 0 <= got[1000].score == got[1001].score < 0.5
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(docs, labels.where("false")).collect()} == {0}
    assert {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()} == {i for i in got if not got[i].predicted}
