"""Random logs against sequential simulations."""

import random

import pytest

from wardenlake.operators import memory, performance, taint, trust


@pytest.mark.parametrize("seed", [1, 2])
def test_trust(spark, seed, monkeypatch):
    monkeypatch.setattr(trust, "FAN", 7)  # many levels
    r = random.Random(seed)
    log = [(i, r.choice([1, 1, 1, 2, 3]), r.choice([-0.4, -0.1, 0.05, 0.3]), r.choice([None, {"a": 1.0}, {"b": i / 2, "c": 0.0}])) for i in range(1, 600)]
    score, walk = {}, {}
    for seq, agent, delta, _ in log:
        score[agent] = max(0.0, min(1.0, score.get(agent, 0.5) + delta))
        walk[seq] = score[agent]
    ops = spark.createDataFrame(log, "seq bigint, agent_id bigint, delta double, factors map<string,double>")
    assert {x.agent_id: x.score for x in trust.current(ops).collect()} == pytest.approx(score)
    assert {x.seq: x.score for x in trust.history(ops).collect()} == pytest.approx(walk)
    assert {x.seq: x.factors for x in trust.history(ops).collect()} == {seq: f or {} for seq, _, _, f in log}
    assert {x.seq: x.factors for x in trust.history(ops.drop("factors")).collect()} == {x[0]: {} for x in log}


@pytest.mark.parametrize(("seed", "rounds"), [(1, 16), (2, 16), (3, 1), (4, 0)])
def test_taint(spark, seed, rounds):
    """With few rounds most of it is followed in order."""
    r = random.Random(seed)
    log, now, passed = [], {}, set()
    for seq in range(1, 150):
        kind = r.choice(["mark", "propagate", "propagate", "propagate", "sanitize"])
        a, b, s = f"d{r.randrange(12)}", f"d{r.randrange(12)}", f"s{r.randrange(5)}"
        s = None if r.random() < 0.1 else s
        log.append((seq, kind, a, b, s, "op"))
        if kind == "mark":
            now.setdefault(a, set()).update({s} - {None})
        elif kind == "sanitize":
            now.pop(a, None)
        elif now.get(a):
            passed.add(seq)
            now.setdefault(b, set()).update(now[a])
    state = taint.replay(spark.createDataFrame(log, "seq bigint, kind string, data_id string, to_data_id string, source_id string, operation string"), rounds)
    got = {}
    for x in taint.current_taint(state.facts, state.epochs).collect():
        got.setdefault(x.data_id, set()).add(x.source_id)
    assert got == {k: v for k, v in now.items() if v} and {x.seq for x in state.propagations.collect()} == passed
    assert sorted(x.data_id for x in state.entries.collect()) == sorted(now)


def test_long_chain_of_copies(spark):
    log = [(0, "mark", "d0", None, "s", "op")] + [(i, "propagate", f"d{i - 1}", f"d{i}", None, "op") for i in range(1, 5001)] + [(9000, "mark", "e", None, "t", "op")]
    state = taint.replay(spark.createDataFrame(log, "seq bigint, kind string, data_id string, to_data_id string, source_id string, operation string"), 3)
    assert state.facts.count() == 5002 and state.propagations.count() == 5000


def test_namespaces(spark):
    r = random.Random(5)
    pairs = [(f"d{r.randrange(300)}", f"d{r.randrange(300)}") for _ in range(200)] + [(f"e{i}", f"e{i + 1}") for i in range(500)] + [("z", "z")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.data_id: x.namespace for x in taint.namespaces(spark.createDataFrame(pairs, "data_id string, to_id string")).collect()}
    assert got == {x: find(x) for x in root}


def test_memory(spark):
    r = random.Random(3)
    kinds = ["store"] * 5 + ["retrieve"] * 5 + ["clear"] + ["search"]
    log = [(i, r.randrange(3), r.choice(kinds), "short", f"k{r.randrange(6)}", f"v{i}", "v") for i in range(1, 500)]
    ops = spark.createDataFrame(log, "seq bigint, store_id bigint, kind string, tier string, mkey string, value string, query string")
    a = {x.seq: (x.hit, x.value) for x in memory.recall_short(ops, 4).collect()}
    b = {x.seq: (x.hit, x.value) for x in memory.replay(ops, 4, 9).filter("kind = 'retrieve'").collect()}
    assert a == b and any(h for h, _ in a.values()) and not all(h for h, _ in a.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_memory_of_all_kinds(spark, seed):
    """Both tiers with eviction, consolidation and NULL keys, against plain lists of dicts."""
    r = random.Random(seed)
    kinds = ["store"] * 6 + ["retrieve"] * 5 + ["search"] * 2 + ["consolidate"] + ["clear"] * (seed > 1)
    log = [(i, r.randrange(2), r.choice(kinds), r.choice(["short", "long"]), r.choice(["a", "b", "c", "d", None]), r.choice([f"v{i}", f"w{i}", None]), r.choice(["v", "w1", "", None, "none"])) for i in range(1, 400)]
    caps, tiers, want = {"short": 4, "long": 6}, {}, {}
    for seq, store, kind, tier, key, value, query in log:
        mine = tiers.setdefault(store, {"short": [], "long": []})
        seen = (None, None, None)
        if kind == "store":
            mine[tier] = [*mine[tier], {"key": key, "value": value, "n": 0, "at": None}]
            if len(mine[tier]) > caps[tier]:
                mine[tier] = (sorted(mine[tier], key=lambda x: x["n"]) if tier == "long" else mine[tier])[1:]
        elif kind == "retrieve":
            met = [x for x in mine[tier] if key is not None and x["key"] == key]
            if met:
                met[-1].update(n=met[-1]["n"] + 1, at=seq)
            seen = (bool(met), met[-1]["value"] if met else None, None)
        elif kind == "search":
            met = [x for x in mine[tier] if query is not None and query in str(x["value"]).lower()][-10:]
            for x in met:
                x["n"] += 1
            seen = (None, None, len(met))
        elif kind == "consolidate":
            met = [dict(x) for x in mine["short"] if x["n"] >= 3]
            mine["long"] = mine["long"] + met
            seen = (None, None, len(met))
        else:
            mine[tier] = []
        want[seq] = (*seen, len(mine["short"]), len(mine["long"]))
    ops = spark.createDataFrame(log, "seq bigint, store_id bigint, kind string, tier string, mkey string, value string, query string")
    assert {x.seq: (x.hit, x.value, x.n, x.short_items, x.long_items) for x in memory.replay(ops, 4, 6).collect()} == want
    held = {(x.store_id, x.tier, x.position): (x.mkey, x.value, x.access_count, x.last_accessed) for x in memory.items(ops, 4, 6).collect()}
    assert held == {(s, t, i): (x["key"], x["value"], x["n"], x["at"]) for s, mine in tiers.items() for t, kept in mine.items() for i, x in enumerate(kept, 1)}
    assert {x.store_id: (x.short_items, x.long_items) for x in memory.tier_sizes(memory.replay(ops, 4, 6), 4, 6).collect()} == {s: (len(m["short"]), len(m["long"])) for s, m in tiers.items()}
    recalled = {x.seq: (x.hit, x.value) for x in memory.recall_short(ops, 4).collect()}
    assert recalled == {seq: want[seq][:2] for seq, _, kind, tier, *_ in log if kind == "retrieve" and tier == "short"}
    assert memory.items(ops.limit(0)).count() == 0 and memory.replay(ops.limit(0)).count() == 0


def test_running_stats_across_stretches(spark, monkeypatch):
    import wardenlake.operators.scan as scan

    r = random.Random(4)
    log = [(i, r.choice([1, None]), r.random(), None, r.random() < 0.5) for i in range(1, 200)]
    perf = spark.createDataFrame(log, "seq bigint, agent_id bigint, execution_time double, token_usage int, success boolean")
    monkeypatch.setattr(performance, "running_sums", lambda *a: scan.running_sums(*a, chunk=16))
    seen = {}
    for x in performance.running_stats(perf).orderBy("seq").collect():
        seen.setdefault(x.agent_id, []).append(log[x.seq - 1])
        mine = seen[x.agent_id]
        assert x.total_executions == len(mine) and x.avg_execution_time == pytest.approx(sum(m[2] for m in mine) / len(mine), abs=1e-7)
