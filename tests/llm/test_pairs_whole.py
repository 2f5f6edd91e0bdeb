"""The models of pairs are fitted on all rows, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlake.llm import language as L
from wardenlake.llm import pairs
from wardenlake.llm.queries import _labelled
from wardenlake.sources.tables import table

ROWS, RARE = 40_000, 2_000
LABELLED = [("How many retries did the agent need for this task?", "en"), ("The run stopped because the store was not reachable.", "en"), ("Wie viele Versuche hat der Agent dafür gebraucht?", "de"), ("Der Lauf wurde beendet, weil der Speicher nicht erreichbar war.", "de")] * 8


@pytest.fixture(scope="module")
def known(spark):
    """Pairs of which one in ``RARE`` has a wording of its own: letters that no other row has."""
    own = F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    rare = F.col("id") % RARE == 7
    rows = spark.range(ROWS).select(
        F.col("id").alias("seq"),
        F.when(rare, F.concat(F.lit("how many retries did the agent need for "), own)).otherwise("how many retries did the agent need for this task?").alias("input"),
        F.lit("It is done.").alias("output"),
        F.when(rare, F.concat(F.lit("the key is "), own)).otherwise("It is done.").alias("expected"),
    )
    found = [tuple(r) for r in rows.filter(F.col("seq") % RARE == 7).select("input", "expected").collect()]
    return pairs.sample_pairs(rows, "seq", "input", "output", "expected"), found


def test_every_ending_counts(known):
    """After a context that was seen once, with its end, the end takes one bit."""
    assert np.allclose(pairs.fit_endings(known[0]).bits([e for _, e in known[1]]), 1.0)


def test_every_wording_counts(spark, known):
    model, script = pairs.adapted(spark, LABELLED, known[0])
    plain = [script.words_of(p) for p, _ in known[1]]
    assert model.languages == ["de", "en"]
    assert max(model.bits(plain)[:, 1] / [len(p) for p in plain]) < 1.5


def test_every_labelled_row_is_read(spark):
    sf = "/root/testdata/sf0.1"
    n = sum(table(spark, sf, t).filter(L.code_column(F.col("lang")).isNotNull()).count() for t in ("messages", "documents"))
    assert _labelled(spark, sf).count() == n


def test_rows_are_corrected_as_lists_are(spark):
    texts = [(r["content"], r["lang"]) for r in table(spark, "/root/testdata/sf0.01", "messages").select("content", L.code_column(F.col("lang")).alias("lang")).filter("content IS NOT NULL AND lang IS NOT NULL").collect()]
    script = L.script_of(spark)
    pieces = L.count_pieces(spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "id int, text string, lang string"), script)
    languages = sorted({lang for _, lang in texts})
    halves = ([], [])
    for r in pieces.collect():
        halves[r["half"]].extend([(r["piece"], r["lang"])] * r["n"])
    assert sum(map(len, halves)) == sum(bool(script.words_of(t[a:b])) for t, _ in texts for a, b in L.pieces_of(t))
    counts = L.corrected_counts(pieces, languages, L.count_windows(pieces, languages, L.AsLabelled(languages)))
    one, other = L.corrected(halves)
    want, got = L.Model.fit(one + other), L.model_of(languages, counts)
    assert got.languages == want.languages
    assert all(np.array_equal(a, b) for x, y in zip(got.grams + got.contexts, want.grams + want.contexts, strict=True) for a, b in zip(x, y, strict=True))
    plain = [p for p, _ in one[:500]]
    assert np.array_equal(got.bits(plain), got.bits_of_windows(*L.distinct_windows(plain)))
