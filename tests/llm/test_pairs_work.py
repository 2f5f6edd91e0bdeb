"""What repeats is read once, and what is read once is read as before."""

import random
import re

import numpy as np

from wardenlake.llm import language as L
from wardenlake.llm import pairs

LABELLED = [("How many retries did the agent need for this task?", "en"), ("The run stopped because the store was not reachable.", "en"), ("Wie viele Versuche hat der Agent dafür gebraucht?", "de"), ("Der Lauf wurde beendet, weil der Speicher nicht erreichbar war.", "de")] * 8
#: The patterns of pieces and of runs that are no words as they are defined, without a thought to speed.
PIECE = re.compile(r".+?(?:[.!?…]+[\"'”»)\]]*(?=\s)|[。！？]+|$)", re.M)
RUN = r"[^\s、-ヿ一-鿿]*"
NOT_WORDS = re.compile(rf"https?://\S+|www\.\S+|<[^<>\s]*/?>|{RUN}[\d_@#\\|=<>{{}}\[\]^~`]{RUN}|[•*→]+")
NAMES = re.compile(r"(?<=[\w,;:)»”\"'’.-] )[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]*(?:[-'’][^\W\d_]+)*\.?")
PARTS = [*" \n.!?…。！\"')]([{}<>=:_/\\|#*→0159٣²Ａаяß日カ\xa0\r-,aAb", "www.", "https://x", "<b>", " [at] ", "SELECT ", "FROM ", " Anna", "def f(x):", "1.", "word ", "Der Lauf "]


class Counted:
    """A pattern or function that counts what it is asked."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def search(self, text):
        self.asked.append(text)
        return self.inner.search(text)

    def bits(self, texts):
        self.asked += texts
        return self.inner(texts)


def test_texts_that_differ_in_numbers_are_judged_once(spark, monkeypatch):
    model, script = L.fit(spark, LABELLED)
    endings = pairs.Endings([t for t, _ in LABELLED])
    refusal, bits, ends = Counted(pairs.REFUSAL), Counted(model.bits), Counted(endings.bits)
    monkeypatch.setattr(pairs, "REFUSAL", refusal)
    monkeypatch.setattr(model, "bits", bits.bits)
    monkeypatch.setattr(endings, "bits", ends.bits)
    prompts = [f"How many retries did the agent need for task {i}?" for i in range(1000, 1300)]
    responses = [f"The agent needed {i} retries. The store of run {i} was not reachable." for i in range(1000, 1300)]
    responses[7] = "The agent needed 31 retries and the"
    assert [i for i, d in enumerate(pairs.defects_of(prompts, responses, (model, script), endings)) if d] == [7]
    assert len(refusal.asked) == 3 and len(bits.asked) == 4
    assert ends.asked == [responses[7]]


def test_rounds_read_windows_instead_of_texts(spark, monkeypatch):
    """Counts and corrected counts are the same from pieces and from the table of their windows, also of several rows."""
    monkeypatch.setattr(L, "READ_CHUNK", 100)
    pieces = L.count_pieces(spark.createDataFrame([(i, t + f" Und {'noch ' * (i % 5)}einmal.", lang) for i, (t, lang) in enumerate(LABELLED)], "id int, text string, lang string"), L.script_of(spark))
    read = L.read_windows(pieces, ["de", "en"])
    assert read.count() > 4 and "piece" not in read.columns
    want, got = (L.count_windows(x, ["de", "en"], L.AsLabelled(["de", "en"])) for x in (pieces, read))
    for a, b in ((want, got), (L.corrected_counts(pieces, ["de", "en"], want), L.corrected_counts(read, ["de", "en"], got))):
        assert all(np.array_equal(x, y) for h, g in zip(a, b, strict=True) for i, j in zip(h, g, strict=True) for x, y in zip(i, j, strict=True))
    assert sum(n.sum() for half in want for _, n in half) == sum(r["n"] * len(r["piece"].encode()) for r in pieces.collect())


def slowly(script: L.Script, piece: str) -> str:
    text = script.alphabet(piece)
    if L._SPELT_AT.search(text):
        text = L._SPELT_ADDRESS.sub(" ", text)
    text = NOT_WORDS.sub(" ", text)
    if not text.isupper():
        without, words = NAMES.sub(" ", text), text.split()
        if len(words) < 4 or len(without.split()) > (1 - L.HEADING_SHARE) * len(words):
            text = without
    return " ".join(text.lower().split())


def slowly_code(piece: str) -> bool:
    return bool(L._CODE.search(piece)) or len(L._CODE_MARKS.findall(piece)) > 0.3 * sum(map(str.isalpha, piece))


def test_short_cuts_change_nothing(spark):
    script, pick = L.script_of(spark), random.Random(5)
    for _ in range(20_000):
        text = "".join(pick.choices(PARTS, k=pick.randint(0, 20)))
        spans = []
        for m in PIECE.finditer(text):
            if spans and spans[-1][1] == m.start() and L._SHORT.search(text, max(spans[-1][0], spans[-1][1] - 8), spans[-1][1]):
                spans[-1] = (spans[-1][0], m.end())
            elif m[0].strip():
                spans.append(m.span())
        assert L.pieces_of(text) == spans, text
        for a, b in spans:
            piece = text[a:b]
            want = "" if slowly_code(piece) else slowly(script, piece)
            assert L.is_code(piece) == slowly_code(piece) and script.plain(piece) == slowly(script, piece), piece
            assert script.words_of(piece) == (want if L._WORD.search(want) else ""), piece
