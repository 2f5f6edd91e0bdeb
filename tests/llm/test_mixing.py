import random

import pytest

from wardenlake.llm import mixing as M

TARGETS = [("big", 0.5, 1), ("small-one", 0.3, 4), ("none", 0.1, 2), ("Mid", 0.1, 2)]


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["big"] * 6 + ["BIG ", "small_one", "mid", None, "other"]), r.choice([1, 10, 200, 0, None, r.randrange(1, 500)])) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, source string, tokens bigint"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_mix(spark, made, monkeypatch):
    sizes, targets = made
    monkeypatch.setattr(M, "WIDTH", 0.5)
    monkeypatch.setattr(M, "FINER", 4)
    mixed = M.mix(sizes, targets)
    known = sizes.withColumn("source", M.source_name(sizes.source)).filter("source IS NOT NULL AND tokens > 0")
    shares = {r.source: r for r in M.shares(mixed, M.plan(known, targets)).collect()}
    caps = {"big": 1, "small_one": 4, "none": 2, "mid": 2}
    assert set(shares) == set(caps) and shares["none"].reached == 0
    for s, cap in caps.items():
        assert shares[s].most_copies <= cap and shares[s].reached <= shares[s].planned <= shares[s].available * cap
    total = sum(x.reached for x in shares.values())
    for s, want in (("big", 0.5), ("small_one", 0.3), ("mid", 0.1)):
        assert shares[s].planned - shares[s].reached <= 500  # less than one more document
        assert shares[s].reached / total == pytest.approx(want / 0.9, rel=0.02)
    rows = mixed.collect()
    assert len({r.id for r in rows}) == len(rows) and all(r.copies >= 1 for r in rows)
    again = M.mix(sizes.repartition(7), targets).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert M.expand(mixed, sizes, "id").count() == sum(r.copies for r in rows)


def test_longer_documents_are_rarer(made):
    sizes, targets = made
    mixed = M.mix(sizes, targets, total=20_000).filter("source = 'big'")
    all_of = sizes.filter("trim(lower(source)) = 'big' AND tokens > 0")
    rate = [mixed.filter(c).count() / all_of.filter(c).count() for c in ("tokens < 50", "tokens >= 200")]
    assert rate[0] > rate[1] > 0


def test_cases(spark, made):
    sizes, targets = made
    assert M.mix(sizes.limit(0), targets).count() == 0 and M.mix(sizes, targets.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "small_one", 10), (1, "small_one", 10), (None, "big", 5)], sizes.schema)
    twice = M.mix(one, targets)
    assert [(r.id, r.copies) for r in twice.collect()] == [(1, 4)] and M.expand(twice, one, "id").count() == 4  # one document, at its cap
    assert [r.source for r in M.plan(M.usable(one), targets).filter("binds").collect()] == ["small_one"]
    everything = M.mix(sizes, targets, total=10**12)  # every source at its cap
    assert everything.filter("source = 'small_one' AND copies <> 4").count() == 0


def test_whole_tables(spark):
    """p7_mix and p7_shares against another tokenizer library and plain sums."""
    import base64

    import public_tokenizers as P
    import tiktoken

    from wardenlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    targets = {r.source: r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    mixed = QUERIES["p7_mix"](spark, sf).collect()
    assert len({r.doc_id for r in mixed}) == len(mixed) > 0
    reached = {}
    for r in mixed:
        assert r.tokens == len(enc.encode_ordinary(docs[r.doc_id].text)) and 1 <= r.copies <= targets[r.source].max_repeats
        assert docs[r.doc_id].source.strip().lower().replace(" ", "_").replace("-", "_") == r.source
        reached[r.source] = reached.get(r.source, 0) + r.tokens * r.copies
    shares = {r.source: r for r in QUERIES["p7_shares"](spark, sf).collect()}
    assert shares.keys() == targets.keys() and {s: r.reached for s, r in shares.items() if r.reached} == reached
    assert sum(r.share for r in shares.values()) == pytest.approx(1, abs=1e-5) and sum(r.binds for r in shares.values()) == 1
