import math

import pytest
from pyspark.sql import functions as F

from wardenlake.llm import language, reading
from wardenlake.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    samples = table(spark, SF, "level_samples")
    return reading.fit_votes(spark, language.sample_labelled(samples, "sample_id", "text", language.code_column(F.col("lang"))))


def test_running_text():
    text = "# Notes for Wick-7\nThe bot reads the note. It works well!\n* She opens the box\n2024-01-01 10:00:00 WARN [Wick-7] tool took=3ms rc=1\n| a | 3 | ok |\nWick-7,12,0.5,tool,true\n{\"id\": 3, \"q\": \"the note\"}\n  at tool.call(a.py:12)\n0a1b2c3d4e5f"
    assert [" ".join(s) for s in reading.running_sentences(text)] == ["The bot reads the note", "It works well", "She opens the box"]


def _right(spark, fitted, monkeypatch, features):
    """How many of 100 held-out samples get their grade by these features, and whether all are within one of it."""
    monkeypatch.setattr(reading, "FEATURES", features)
    samples = table(spark, SF, "level_samples")
    documents = table(spark, SF, "documents").select("doc_id", "text")
    test = samples.filter("sample_id % 2 = 0").select((F.col("sample_id") + 10**9).alias("doc_id"), "text")
    got = reading.grades(documents.unionByName(test), "doc_id", "text", samples.filter("sample_id % 2 = 1"), fitted).filter("id >= 1000000000").collect()
    truth = {r.sample_id + 10**9: r.grade for r in samples.collect()}
    assert len(got) == 100
    return sum(truth[r.id] == r.grade for r in got), all(abs(truth[r.id] - r.grade) <= 1 for r in got)


def test_held_out(spark, fitted, monkeypatch):
    right, near = _right(spark, fitted, monkeypatch, reading.FEATURES)
    assert right >= 95 and near


def test_coverage_decides(spark, fitted, monkeypatch):
    whole, sentence = reading.FEATURES, ("sentence",)
    with_coverage = _right(spark, fitted, monkeypatch, whole)[0]
    without = _right(spark, fitted, monkeypatch, sentence)[0]
    alone = _right(spark, fitted, monkeypatch, reading.COVERAGE)[0]
    print("held out of 100: both", with_coverage, "sentence", without, "coverage", alone)
    assert with_coverage >= without + 5 and alone >= 70


def test_rare_words_are_joined(spark, fitted, monkeypatch):
    """The same grades, however many words are looked up in place."""
    samples = table(spark, SF, "level_samples")
    documents = table(spark, SF, "documents").select("doc_id", "text")
    want = {r.id: r.grade for r in reading.grades(documents, "doc_id", "text", samples, fitted).collect()}
    monkeypatch.setattr(reading, "HEAD_WORDS", 40)
    assert {r.id: r.grade for r in reading.grades(documents, "doc_id", "text", samples, fitted).collect()} == want and len(want) > 800


def test_languages_by_votes(spark):
    script = language.script_of(spark)
    labelled = [("The bot reads the note and it works.", "en")] * 8 + [("Der Bot liest die Notiz und es geht.", "de")] * 6 + [("The bot reads it.", "de")] * 2 + [("Der Bot liest.", "en")]
    votes = reading.Votes(labelled, script)
    assert [votes.winner({w: 1 for w in t.split()}) for t in ("the note works", "der und liest", "zzz")] == ["en", "de", None]


def test_cases(spark, fitted):
    samples = table(spark, SF, "level_samples")
    easy = "The bot reads the note. It works well now. We check the keys now."
    rows = [(1, easy), (2, None), (3, ""), (4, " \n "), (5, "0a1b2c3d4e5f 0a1b2c3d4e5f"), (1, easy), (6, (easy + " ") * 3000), (None, easy), (7, "Zzqx vvwy qqrt. Xxkj wwzt.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"grade": F.lit(0), "lang": F.lit("x"), "words": F.lit(0), "_row": F.lit(0)})
    got = reading.grades(df, "doc_id", "text", samples, fitted).collect()
    assert sorted(str(r.id) for r in got) == ["1", "1", "6", "7", "None"] and {r.grade for r in got if r.id != 7} == {1} and all(1 <= r.grade <= 5 for r in got)
    assert reading.grades(df.limit(0), "doc_id", "text", samples, fitted).count() == 0
    assert reading.grades(df, "doc_id", "text", samples.limit(0), fitted).count() == 0


def test_ranks(spark):
    words = spark.createDataFrame([("en", "a", 3), ("en", "a", 2), ("en", "b", 2), ("en", "c", 2), ("en", "d", 1), ("de", "a", 1)], "lang string, word string, n int")
    ranked = reading.word_ranks(words).collect()
    beyond = {(r.lang, r.word): round(math.exp(-r.beyond), 6) for r in ranked}
    assert beyond == {("en", "a"): 1, ("en", "b"): 0.5, ("en", "c"): 0.5, ("en", "d"): 0.1, ("de", "a"): 1}
    got = {(r.lang, r.word): (r.rank, r.freq) for r in ranked}
    assert got == {("en", "a"): (1, 5), ("en", "b"): (3, 2), ("en", "c"): (3, 2), ("en", "d"): (4, 1), ("de", "a"): (1, 1)}
