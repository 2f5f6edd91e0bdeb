import itertools
import random

import pytest
from pyspark.sql import functions as F

from wardenlake.llm import confusables as C


@pytest.fixture(scope="module")
def table(spark):
    return C.prototypes(spark)


SAME = [
    ("Report 12", "Ｒｅｐｏｒｔ　１２"), ("Report", "Rе​ро­rt"), ("a b", "a b"), ("a b", "a b"), ("é", "é"), ("INPUT", "ΙNРUТ"), ("ガ", "ｶﾞ"), ("x\ny", "x\r\ny"), ("l", "ⅼ"),
]
DIFFERENT = [("Report", "report"), ("e", "é"), ("2", "²"), ("6", "⑥"), ("a.", "a"), ("I", "l"), ("l", "1"), ("O", "0"), ("a  b", "a b"), ("m", "rn"), ("’", "'"), ("", " "), ("ё", "е"), ("👨‍👩", "👨👩")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(table, a, b):
    assert C.skeleton(a, table) == C.skeleton(b, table)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(table, a, b):
    assert C.skeleton(a, table) != C.skeleton(b, table)


def test_pairs_are_those_of_brute_force(spark, table, monkeypatch):
    monkeypatch.setattr(C, "HOT_ROWS", 5)  # salted too
    monkeypatch.setattr(C, "HOT_FORMS", 2)  # and in blocks
    r = random.Random(1)
    forms = ["abc", "аbc", "ａbc", "ab c", "ab c", "Abc", "", "​", "x" * 50_000, "х" * 50_000]
    rows = [(i, r.choice("mn"), r.choice([*forms, "abc", "abc", None])) for i in range(80)] + [(7, "m", "abc")]
    df = spark.createDataFrame(rows, "seq bigint, tbl string, content string").withColumns({"a": F.lit(0), "_look": F.lit(0), "_n": F.lit(0)})
    want = sorted(
        (x[1], min(x[0], y[0]), max(x[0], y[0]))
        for x, y in itertools.combinations([x for x in rows if x[2] is not None], 2)
        if x[1] == y[1] and x[0] != y[0] and x[2] != y[2] and C.skeleton(x[2], table) == C.skeleton(y[2], table)
    )
    assert sorted(map(tuple, C.same_look_pairs(df, "seq", "content", ["tbl"]).collect())) == want and len(want) > 50
    assert C.same_look_pairs(df.limit(0), "seq", "content", ["tbl"]).count() == 0


def test_forms(spark):
    rows = [(1, "t", "аbc"), (2, "t", "abc"), (3, "t", None), (4, "t", "ABC"), (2, "t", "abc"), (5, None, "ab​c")]
    df = spark.createDataFrame(rows, "seq bigint, tbl string, content string")
    got = sorted((r.seq, r.tbl or "", r.form or "") for r in C.consistent_forms(df, "seq", "content", ["tbl"]).collect())
    assert got == [(1, "t", "abc"), (2, "t", "abc"), (2, "t", "abc"), (3, "t", ""), (4, "t", "ABC"), (5, "", "ab​c")]
    assert C.consistent_forms(df.limit(0), "seq", "content", ["tbl"]).count() == 0


def test_a_look_of_many_spellings(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_FORMS", 7)
    forms = ["".join(p) for p in itertools.product("aа", "oо", "eе", "pр", "cс")]
    df = spark.createDataFrame([(i, "t", f) for i, f in enumerate(forms + forms[:3])], "seq bigint, tbl string, content string")
    n = len(forms) + 3
    assert C.same_look_pairs(df, "seq", "content", ["tbl"]).count() == n * (n - 1) // 2 - 3


def test_forms_of_a_whole_table_are_those_of_the_skeletons(spark, table):
    from wardenlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {("messages", r.seq): r.content for r in spark.read.parquet(f"{sf}/messages.parquet").collect()} | {("attacks", r.seq): r.content for r in spark.read.parquet(f"{sf}/attacks.parquet").collect()}
    got = {(r.tbl, r.seq): r.form for r in QUERIES["p4_forms"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    classes = {}
    for k, t in texts.items():
        if t is not None:
            classes.setdefault((k[0], C.skeleton(t, table)), []).append(t)
    for k, t in texts.items():
        alike = classes.get((k[0], C.skeleton(t, table))) if t is not None else [None]
        assert got[k] in alike and got[k] == (min(alike, key=lambda x: (sum(c > "\x7f" for c in x), x.encode())) if t is not None else None)
