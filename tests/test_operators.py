"""Cases derived by hand."""

import itertools
import unicodedata

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import answers, catalogue, chunking, encoding, noise, retrieval, structure
from loam.operators.index import SearchIndex
from loam.plans import catalog


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "value", "expected"),
    [
        (T.edge_key, "Page 12 of 300", "page # of #"),
        (T.join_lines, "envi-\nronment is\nkey", "environment is key"),
        (T.clean_block, "ﬁne  text", "fine text"),
        (T.clean_year, "1970", ""),
        (T.clean_year, " 2015 ", "2015"),
        (T.readable, "01_Floods_GLOFs", "Floods GLOFs"),
        (T.readable, "Some_Report.pdf", "Some Report"),
        (T.search_terms, "PM2.5 in Kathmandu?", "PM2 5 in Kathmandu"),
        (T.token_estimate, "abcdefgh", 2),
        (T.token_estimate, "a", 1),
        (T.page_language, "日本語の文書", "other"),
        (T.local_path, "/a/b:c. /", "a/b_c"),
        (structure.is_heading, "4.2.1 Methods", True),
        (structure.is_heading, "A sentence that ends here.", False),
        (structure.heading_level, "RESULTS", 1),
        (structure.heading_level, "4.2.1 Methods", 3),
        (structure.heading_level, "Introduction", 2),
        (structure.heading_level, "4 Results", 1),
        (chunking.sentences, "See Fig. 3 for data. Next one.", ["See Fig. 3 for data.", "Next one."]),
        (answers.clean_source, "rose [12] by [3, 4] m", "rose by m"),
        (answers.without_thoughts, "<think>x</think>ok", "ok"),
        (answers.without_thoughts, "ok <think>never ends", "ok"),
        (answers.uncited, "Nothing could not find", False),
        (noise.is_review, "L418: please comment. L465-470: unclear", True),
    ],
)
def test_scalars(spark, make, value, expected):
    assert one(spark, make(F.col("v")), v=value) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a title that ends in 2010 and 100", "a title that ends in 2010 and 100"),  # line 0 keeps its zeros
        ("short\n1 title that ends in 201", "1 title that ends in 201"),
        ("   a title between spaces   \nx", "a title between spaces"),
        ("\u3000 a title between other spaces \u00a0\u2003", "a title between other spaces"),
        ("\ta title between two tabs\t", "\ta title between two tabs\t"),
        (" \n" * 10 + "blank lines don't count as lines", "blank lines don't count as lines"),
        ("  Abstract of what is written here\nwhat is written here follows", "what is written here follows"),
        ("\u0130NTRODUCTION to what is written\nwhat is written here follows", "what is written here follows"),
        ("      exactly 20 letters..     ", "untitled"),
        ("", "untitled"),
    ],
)
def test_guessed_title_is_that_of_sql(spark, text, expected):
    assert one(spark, T.guess_title(F.col("v"), F.lit("untitled")), v=text) == expected
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").toPandas()  # noqa: F841 (the SQL reads it)
    assert duckdb.sql(f"WITH documents AS (SELECT * FROM frame) {catalog.oracle_sql()['title_guess'].replace('WITH l', ', l', 1)}").fetchall() == [(1, expected), (2, "untitled")]


def test_sentences_keep_their_digits(spark):
    text = "0 floods came by 2010. 1 dam broke in 2011. 2 more held in 2012. "
    assert one(spark, chunking.sentences(F.col("v")), v=text) == ["0 floods came by 2010.", "1 dam broke in 2011.", "2 more held in 2012."]
    assert one(spark, chunking.sentences(F.col("v")), v="  Spaces before.  After it.   ") == ["Spaces before.", "After it."]


def test_density(spark):
    assert one(spark, noise.citation_density(F.col("v")), v="Smith et al 2010 said") == pytest.approx(1.25 / 5)


@pytest.mark.parametrize(("pages", "n", "expected"), [(25, 10, [0, 3, 5, 8, 11, 13, 16, 19, 21, 24]), (3, 10, [0, 1, 2])])
def test_page_sample(pages, n, expected):
    assert catalogue.page_sample(pages, n) == expected


@pytest.mark.parametrize(("pages", "cpp", "size", "expected"), [(3, 150, 5000, "needs_ocr"), (3, 500, 19999, "stub"), (3, 800, 20000, "ok"), (0, 0, 0, "broken")])
def test_classify(spark, pages, cpp, size, expected):
    assert one(spark, catalogue.classify(F.col("p"), F.col("c"), F.col("s")), p=pages, c=cpp, s=size) == expected


@pytest.mark.parametrize("length", [0, 1, 1999, 2000, 2001, 3800, 3801, 5000, 7399])
def test_char_windows_cover_the_text(spark, length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    expected, start = [], 0
    while start < length:
        expected.append(text[start : start + 2000])
        if start + 2000 >= length:
            break
        start += 1800
    assert one(spark, structure.char_windows(F.col("v")), v=text) == expected


def test_sections_and_cap(spark):
    rows = [("a", 1, "1 Intro"), ("a", 2, "t."), ("a", 3, "1.1 Scope"), ("a", 4, "u."), ("a", 5, "2 Data"), ("a", 6, "v.")]
    rows += [("b", 1, "Acknowledgements"), ("b", 2, "x" * 3000), ("b", 3, "y" * 2000), ("b", 4, "z" * 10)]
    got = structure.sections(spark.createDataFrame(rows, "doc string, seq int, text string")).orderBy("doc", "seq").collect()
    assert [(r.doc, r.seq, r.section) for r in got] == [("a", 2, "1 Intro"), ("a", 4, "1 Intro > 1.1 Scope"), ("a", 6, "2 Data"), ("b", 3, ""), ("b", 4, "")]


def test_reference_list(spark):
    p = "p" * 320
    rows = [("a", 1, 1, "Body."), ("a", 1, 2, "References"), ("a", 2, 3, "Smith 2010"), ("a", 2, 4, p), ("a", 2, 5, p), ("a", 3, 6, p), ("a", 3, 7, "Tail.")]
    rows += [("b", 1, 1, "References"), ("b", 1, 2, p), ("b", 2, 3, "Jones 1999"), ("b", 2, 4, p), ("b", 3, 5, "ANNEX ONE"), ("b", 3, 6, "End.")]
    got = structure.strip_references(spark.createDataFrame(rows, "doc string, page int, seq int, text string")).orderBy("doc", "seq").collect()
    assert [(r.doc, r.page, r.seq) for r in got] == [("a", 1, 1), ("a", 3, 4), ("a", 3, 5), ("a", 3, 6), ("a", 3, 7), ("b", 3, 4), ("b", 3, 5), ("b", 3, 6)]


def chunks_of(sizes, segments, config=chunking.ChunkConfig()):
    return chunking.boundaries(np.array(sizes), np.array(segments), config)


def test_packing_repeats_only_the_overlap():
    found = chunks_of([60] * 30, [0] * 30)
    assert all((b - a) * 60 <= 768 for _, a, b in found)
    covered = 0
    for _, a, b in found:
        assert (covered - a) * 60 <= 64
        assert a <= covered < b
        covered = b
    assert covered == 30


def test_small_sections_join_a_neighbour():
    assert chunks_of([200, 20], [0, 1]) == [(0, 0, 2)]
    assert chunks_of([20, 200], [0, 1]) == [(1, 0, 2)]
    assert chunks_of([20], [0]) == [(0, 0, 1)]
    assert chunks_of([], []) == []
    assert chunks_of([760, 20, 20], [0, 1, 2]) == [(0, 0, 1), (2, 1, 3)]  # too large to be joined: they wait, and end


@given(st.lists(st.tuples(st.integers(1, 300), st.booleans()), min_size=1, max_size=60))
def test_packing_rules(rows):
    """Each rule of packing, checked on the chunks alone."""
    config = chunking.ChunkConfig()
    sizes, segments = [n for n, _ in rows], list(itertools.accumulate(int(new) for _, new in rows))
    found, total = chunks_of(sizes, segments), [0, *itertools.accumulate(sizes)]
    tokens = lambda a, b: total[b] - total[a]
    assert found[0][1] == 0
    assert found[-1][2] == len(rows)
    for (_, a, b), (_, c, d) in itertools.pairwise(found):
        assert a <= c <= b < d
        assert tokens(c, b) <= config.overlap
        if c < b or segments[b - 1] == segments[b]:  # cut within a section: one sentence more would pass the target
            assert tokens(a, b + 1) > config.target or tokens(b, d) < config.least
            assert c == a or tokens(c - 1, b) > config.overlap
    for k, (name, a, b) in enumerate(found):
        fresh = a if not k else found[k - 1][2]
        assert fresh < b
        assert segments[name] in segments[a:b]
        assert tokens(a, b) <= max(config.most, config.target + max(sizes), config.overlap + max(sizes))
        if tokens(fresh, b) < config.least and k:  # a small rest stays alone only where it doesn't fit the chunk before it
            assert tokens(found[k - 1][1], b) > config.most or k == len(found) - 1


def test_rrf(spark):
    lists = [spark.createDataFrame([(1, x, r) for r, x in enumerate(xs, 1)], "query_id int, id string, rank int") for xs in ("ABC", "BCD")]
    got = retrieval.rrf(lists, 9).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("B", 0.03252), ("C", 0.032), ("A", 0.01639), ("D", 0.01587)]


HITS = [
    {"doc_id": "a", "text": "The discharge reached 1,200 metres in 2015 [12].", "title": "T", "author": "Bastola", "collection": "papers", "category": "x", "year": "2019", "path": "/p/a.pdf", "page_start": 3, "page_end": 3},
    {"doc_id": "a", "text": "Landslides killed 43 people in the upper valley.", "title": "T", "author": "Bastola", "collection": "papers", "category": "x", "year": "2019", "path": "/p/a.pdf", "page_start": 7, "page_end": 8},
    {"doc_id": "b", "text": "Forest cover grew to 44.7 percent.", "title": "U", "author": "", "collection": "reports", "category": "Some_Office", "year": "", "path": "/p/b.pdf", "page_start": 1, "page_end": 1},
]


def on_answer(spark, column, text):
    rows = spark.createDataFrame([(text, HITS)], f"answer string, used array<{answers.HIT}>").withColumn("held", answers.evidence(F.col("used")))
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("change", "text", "expected"),
    [
        (answers.auto_cited, "Forest cover grew to 44.7 percent. Short one.", "Forest cover grew to 44.7 percent [~S3]. Short one."),
        (answers.auto_cited, "Nothing of all this stands anywhere.\n\n \nLandslides killed people in the upper valley!", "Nothing of all this stands anywhere.\n\nLandslides killed people in the upper valley [~S2]!"),
        (answers.auto_cited, "", ""),
        (answers.repaired, "Landslides killed 43 people [S1].", "Landslides killed 43 people [~S2]."),
        (answers.repaired, "Landslides killed 43 people [S2].", "Landslides killed 43 people [S2]."),
        (answers.repaired, "Cover grew to 44.7 percent [S1][S2] now", "Cover grew to 44.7 percent now [~S3]"),
        (answers.repaired, "It was 99 then [S1].", "It was 99 then [S1]."),
    ],
)
def test_labels(spark, change, text, expected):
    assert on_answer(spark, change(F.col("answer"), F.col("held")), text) == expected


@pytest.mark.parametrize(("text", "expected"), [("It rose [S1][S2]. So (S3).", "It rose [Bastola, 2019, pp. 3–8]. So [Some Office, n.d., p. 1]."), ("It rose [S9].", "It rose [S9]."), ("[~S3] [S1] end", "[~Some Office, n.d., p. 1; Bastola, 2019, p. 3] end")])
def test_apa(spark, text, expected):
    assert on_answer(spark, answers.apa(F.col("answer"), F.col("used")), text) == expected


def test_references(spark):
    found = on_answer(spark, answers.references(F.col("used"), F.array(F.lit(3), F.lit(1), F.lit(2))), "")
    assert found == ["Some Office. (n.d.). U. /p/b.pdf", "Bastola. (2019). T. /p/a.pdf"]
    assert on_answer(spark, answers.markdown(F.lit("Q"), F.col("answer"), F.array(F.lit("r"))), "A") == "# Q\n\nA\n\n## References\n\n- r"


def test_nfkc_is_pythons(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["ﬁne ①", "ｆｕｌｌ", None, "e\u0301"]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, v string").select("i", T.nfkc(F.col("v")).alias("x")).collect()
    assert [r.x for r in sorted(got)] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_index_versions(spark, tmp_path, sf_dir):
    """Created, appended to and compacted, an index by lists gives what one made at once gives."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    chunks = spark.range(500).select("id", F.concat(F.lit("word"), (F.col("id") % 7).cast("string"), F.lit(" common")).alias("text"))
    index = SearchIndex.create(chunks.where("id < 400"), rows.where("id < 400"), str(tmp_path / "i"), least_rows=100)
    index.append(chunks.where("id >= 400"), rows.where("id >= 400"))
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    before = index.vector(asked, 5, probes=1000).orderBy("query_id", "rank").collect()
    index.compact()
    again = SearchIndex(spark, str(tmp_path / "i"))
    assert again.version == 2
    assert again.vector(asked, 5, probes=1000).orderBy("query_id", "rank").collect() == before
    exact = retrieval.ClusteredVectors(rows).search_all(asked, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in before] == [(r.query_id, r.id) for r in exact]
    questions = spark.createDataFrame([(0, "word3 word3")], "query_id long, text string")
    assert {r.id % 7 for r in again.keyword(questions, 10).collect()} == {3}
    fused = again.search(questions, asked.where("query_id = 0"), 8)
    assert fused.count() == 8
    assert "text" in fused.columns


def test_encoder_halves_batches():
    seen = []

    def encode(texts):
        seen.append(len(texts))
        if len(texts) > 3:
            raise MemoryError
        return np.ones((len(texts), 2))

    assert encoding.halving(encode, ["x"] * 10, 16).shape == (10, 2)
    assert max(n for n in seen if n <= 3) == 2
    with pytest.raises(MemoryError):
        encoding.halving(lambda texts: (_ for _ in ()).throw(MemoryError()), ["x"], 4)


def test_exact_tokens(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "t.json"))
    rows = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    assert [r.tokens for r in encoding.exact_tokens(rows, "text", str(tmp_path / "t.json")).collect()] == [3, 0, 0]


def test_parallel_arrays_must_agree(spark):
    with pytest.raises(Exception, match="parallel arrays"):
        encoding.zipped(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>"), "a", "b").collect()
