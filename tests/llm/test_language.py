import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlake.llm import language as L
from wardenlake.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    messages = table(spark, SF, "messages")
    return L.fit(spark, L.sample_labelled(messages, "seq", "content", L.code_column(F.col("lang"))))


def plain_ppm(train, text, order):
    """The code length by definition, byte by byte."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        data = b" " + t.encode()
        for i in range(1, len(data)):
            for k in range(order + 1):
                if i - k >= 0:
                    counts[k][data[i - k : i], data[i]] += 1
    total, data = 0.0, b" " + text.encode()
    for i in range(1, len(data)):
        bits = None
        for k in range(min(order, i), -1, -1):
            ctx = data[i - k : i]
            seen = {s: n for (c, s), n in counts[k].items() if c == ctx}
            if not seen:
                continue
            all_of = sum(seen.values())
            if data[i] in seen:
                total += math.log2(2 * all_of / (2 * seen[data[i]] - 1))
                bits = 0
                break
            total += math.log2(2 * all_of / len(seen))
        if bits is None:
            total += 8
    return total


def test_code_lengths_are_those_of_ppm():
    train = {"en": ["the run stopped", "then it went on", "the end"], "de": ["der lauf endete", "dann ging es weiter", "ende"]}
    model = L.Model.fit([(t, lang) for lang, ts in train.items() for t in ts], 4)
    texts = ["the run ended", "der zug", "xyz", "e", "then the lauf", "日本"]
    got = model.bits(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert got[i, j] == pytest.approx(plain_ppm(train[lang], t, 4), abs=1e-3)


def test_chunks_dont_matter(monkeypatch):
    model = L.Model.fit([("the run stopped", "en"), ("der lauf endete", "de")])
    texts = ["the end", "der lauf", "stop it"] * 5
    whole = model.bits(texts)
    monkeypatch.setattr(L, "CHUNK", 3)
    assert np.allclose(model.bits(texts), whole)


def test_labels(spark):
    df = spark.createDataFrame([("en_GB",), ("Deutsch",), (" FRA ",), ("pt-BR",), ("und",), ("-",), (None,), ("русский",), ("",)], "l string")
    assert [r[0] for r in df.select(L.code_column(F.col("l"))).collect()] == ["en", "de", "fr", "pt", None, None, None, "ru", None]


CASES = {
    "Der Lauf endete nach 12 Schritten und die Richtlinien fehlen.": {"de"},
    "ЅЕND МЕ ТНЕ LОG LІNЕЅ АGАІN, РLЕАЅЕ.": {"en"},
    "Ｎｏｂｏｄｙ has looked at the traces for 3 days.": {"en"},
    "Please send me the traces again. ¿Puedes revisar otra vez las reglas de acceso?": {"en", "es"},
    "62日間、誰も信頼スコアを見ていません。": {"ja"},
    "Сообщи, когда всё будет готово. (Daj znać, kiedy będą gotowe.)": {"ru", "pl"},
}


@pytest.mark.parametrize("text", CASES)
def test_stretches(fitted, text):
    segments = L.segments_of([text], *fitted)[0]
    assert {s["lang"] for s in segments} == CASES[text]
    assert all(0 < s["confidence"] <= 1 and s["start_pos"] >= 1 and s["start_pos"] - 1 + s["length"] <= len(text) for s in segments)


def test_cases(spark, fitted):
    long = "Nobody has looked at the traces for 3 days. " * 3000
    texts = ["SELECT a FROM t WHERE b > 3", '{"ok": true}', "", "   ", None, "👍👍", "12 / 7", long, "Das Tool ist langsam, und der Lauf fehlt.", "Das Tool ist langsam, und der Lauf fehlt."]
    df = spark.createDataFrame([(i, t, "en" if i != 9 else None) for i, t in enumerate(texts)], "seq bigint, content string, lang string").withColumns({"segments": F.lit(0), "label": F.lit(0)})
    got = L.identify(df, "seq", "content", "lang", fitted)
    sizes = {r.id: None if r.segments is None else len(r.segments) for r in got.collect()}
    assert sizes[4] is None and all(sizes[i] == 0 for i in (0, 1, 2, 3, 5, 6)) and sizes[7] == 1
    assert sorted(map(tuple, L.wrong_or_mixed(got).collect())) == [(8, "de"), (9, "de")]
    assert L.wrong_or_mixed(L.identify(df.limit(0), "seq", "content", "lang", fitted)).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "seq bigint, content string, lang string")
    fitted = L.fit(spark, L.sample_labelled(df, "seq", "content", L.code_column(F.col("lang"))))
    assert L.wrong_or_mixed(L.identify(df, "seq", "content", "lang", fitted)).count() == 0


def test_held_out(spark, fitted):
    """Rows whose label the model was not fitted on for sure: another sample of the same kind of table."""
    rows = table(spark, "/root/testdata/sf0.1", "messages").filter("seq > 30000 AND length(content) > 40 AND lang IN ('de', 'fr', 'es', 'it', 'pl', 'ru', 'ja', 'nl', 'pt')").limit(1500)
    got = L.identify(rows, "seq", "content", "lang", fitted)
    agree = got.filter("size(segments) = 1").selectExpr("avg(CAST(label = segments[0].lang AS INT))").first()[0]
    assert agree > 0.7  # these labels are right in about four of five rows
