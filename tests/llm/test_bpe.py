import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardenlake.llm import bpe

mine = bpe.Encoder(bpe.default_vocabulary(), bpe.default_pattern())
theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
theirs.encode_special_tokens = True


def same(text):
    return mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert same(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab =\n<|endoftext|>é日😀​'sre01", max_size=120))
def test_awkward_text(text):
    assert same(text)


def test_long_runs():
    for text in ("=" * 20_000, "ab" * 5_000, "<|endoftext|>", "日本" * 3_000, "é" * 999):
        assert same(text)


def test_column(spark):
    long = "word " * 40_000
    df = spark.createDataFrame([(1, "Hello  world"), (2, ""), (3, None), (1, "Hello  world"), (None, "x"), (4, long)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    want = theirs.encode("Hello  world", add_special_tokens=False).ids
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, want), (1, want), (2, []), (3, [])]
    assert (None, mine.encode("x")) in got and (4, theirs.encode(long, add_special_tokens=False).ids) in got
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    counts = {r.doc_id: r.n for r in df.select("doc_id", bpe.count_column(F.col("text")).alias("n")).collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == len(want)
