"""Bounded memories replayed from a log of store, retrieve, search, consolidate and clear operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.scan import running_last, running_sums

SHORT_CAPACITY, LONG_CAPACITY = 100, 10_000
CONSOLIDATE_FROM = 3


def recall_short(ops: DataFrame, capacity: int = SHORT_CAPACITY) -> DataFrame:
    """(seq, store_id, mkey, hit, value): what each retrieval from the short tier finds.

    The newest store of the key since the last clearing, unless ``capacity`` others came after it; a NULL key finds nothing. Counting and looking
    back are running values in stretches of the log, so one large store isn't one task.
    """
    short = ops.filter("tier = 'short'")
    counted = running_sums(short, ["store_id"], "seq", {"epoch": F.when(F.col("kind") == "clear", 1).otherwise(0), "stored": F.when(F.col("kind") == "store", 1).otherwise(0)})
    newest = F.when(F.col("kind") == "store", F.struct("stored", "value"))
    found = running_last(counted.filter("kind IN ('store', 'retrieve')"), ["store_id", "epoch", "mkey"], "seq", newest, "found")
    hit = F.coalesce(F.col("mkey").isNotNull() & (F.col("found.stored") > F.col("stored") - F.lit(capacity)), F.lit(False))
    return found.filter("kind = 'retrieve'").select("seq", "store_id", "mkey", hit.alias("hit"), F.when(hit, F.col("found.value")).alias("value"))


def live_short(ops: DataFrame, capacity: int = SHORT_CAPACITY) -> DataFrame:
    """(store_id, seq, mkey, value): what the short tier of each store holds at the end."""
    short = ops.filter("tier = 'short'")
    counted = running_sums(short, ["store_id"], "seq", {"epoch": F.when(F.col("kind") == "clear", 1).otherwise(0), "stored": F.when(F.col("kind") == "store", 1).otherwise(0)})
    last = counted.groupBy("store_id").agg(F.max("epoch").alias("_epoch"), F.max("stored").alias("_stored"))
    rows = counted.filter("kind = 'store'").join(last, "store_id").filter(f"epoch = _epoch AND stored > _stored - {int(capacity)}")
    return rows.select("store_id", "seq", "mkey", "value")


def search(items: DataFrame, query: str, limit: int = 10, order: str = "seq") -> DataFrame:
    """The newest items whose value contains the query in any case, newest first; a limit below one gives one."""
    return items.filter(F.contains(F.lower(F.col("value").cast("string")), F.lit(query.lower()))).orderBy(F.desc(order)).limit(max(limit, 1))


def stats_short(ops: DataFrame, capacity: int = SHORT_CAPACITY) -> DataFrame:
    """(store_id, items, capacity) of the short tier."""
    return live_short(ops, capacity).groupBy("store_id").agg(F.count(F.lit(1)).alias("items"), F.lit(capacity).alias("capacity"))


@dataclass
class _Item:
    key: str | None
    value: str | None
    accesses: int = 0
    accessed: int | None = None


class _Store:
    """Both tiers of one store."""

    def __init__(self, short: int, long: int) -> None:
        self.tiers: dict[str, list[_Item]] = {"short": [], "long": []}
        self.capacity = {"short": short, "long": long}

    def store(self, tier: str, key: str | None, value: str | None) -> None:
        items = self.tiers[tier]
        items.append(_Item(key, value))
        if len(items) > self.capacity[tier]:
            if tier == "long":  # the least accessed goes, of several the first; the order by accesses stays
                items.sort(key=attrgetter("accesses"))
            del items[0]

    def retrieve(self, tier: str, key: str | None, seq: int) -> tuple[bool, str | None]:
        item = next((x for x in reversed(self.tiers[tier]) if x.key == key), None) if key is not None else None
        if item is None:
            return False, None
        item.accesses += 1
        item.accessed = seq
        return True, item.value

    def search(self, tier: str, query: str, limit: int = 10) -> int:
        met = list(islice((x for x in reversed(self.tiers[tier]) if query in str(x.value).lower()), max(limit, 1)))
        for x in met:
            x.accesses += 1
        return len(met)

    def consolidate(self) -> int:
        moved = [replace(x) for x in self.tiers["short"] if x.accesses >= CONSOLIDATE_FROM]
        self.tiers["long"] += moved
        return len(moved)

    def apply(self, seq: int, kind: str, tier: str, key: object, value: object, query: object) -> tuple[bool | None, str | None, int | None]:
        """What one operation finds (hit, value, n)."""
        key, value = (x if isinstance(x, str) else None for x in (key, value))
        if kind == "store":
            self.store(tier, key, value)
        elif kind == "retrieve":
            return *self.retrieve(tier, key, seq), None
        elif kind == "search":
            return None, None, self.search(tier, query.lower()) if isinstance(query, str) else 0
        elif kind == "consolidate":
            return None, None, self.consolidate()
        elif kind == "clear":
            self.tiers[tier] = []
        return None, None, None


def _in_order(ops: DataFrame) -> DataFrame:
    ordered = ops.filter("store_id IS NOT NULL").select("seq", "store_id", "kind", "tier", "mkey", "value", "query")
    return ordered.repartition("store_id").sortWithinPartitions("store_id", "seq")


REPLAYED = "seq bigint, store_id bigint, kind string, tier string, hit boolean, value string, n bigint, short_items bigint, long_items bigint"
ITEMS = "store_id bigint, tier string, position bigint, mkey string, value string, access_count bigint, last_accessed bigint"


def replay(ops: DataFrame, short: int = SHORT_CAPACITY, long: int = LONG_CAPACITY) -> DataFrame:
    """(seq, store_id, kind, tier, hit, value, n, short_items, long_items): every operation on both tiers, with the tiers' sizes after it.

    What the long tier drops depends on all accesses before, so a store is sequential; its operations stream through one task in order,
    which holds the bounded tiers of one store and never a store's log. Operations with a NULL store are left out; a NULL key or query finds nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, _Store(short, long)
        for batch in batches:
            out = []
            for seq, store_id, kind, tier, *found_by in batch.itertuples(index=False, name=None):
                if store_id != at:
                    at, state = store_id, _Store(short, long)
                tier = "long" if tier == "long" else "short"
                out.append((seq, store_id, kind, tier, *state.apply(seq, kind, tier, *found_by), len(state.tiers["short"]), len(state.tiers["long"])))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in REPLAYED.split(", ")])
            yield frame.astype({"hit": "boolean", "n": "Int64"})

    return _in_order(ops).mapInPandas(run, REPLAYED)


def items(ops: DataFrame, short: int = SHORT_CAPACITY, long: int = LONG_CAPACITY) -> DataFrame:
    """(store_id, tier, position, mkey, value, access_count, last_accessed): what both tiers of each store hold at the end, in their order.

    ``last_accessed`` is the seq of the last retrieval; searches don't set it, and a consolidated copy keeps that of its original.
    """

    def held(store_id: object, state: _Store) -> pd.DataFrame:
        rows = [(store_id, tier, i, x.key, x.value, x.accesses, x.accessed) for tier, kept in state.tiers.items() for i, x in enumerate(kept, 1)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")]).astype({"last_accessed": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, _Store(short, long)
        for batch in batches:
            for seq, store_id, kind, tier, *found_by in batch.itertuples(index=False, name=None):
                if store_id != at:
                    if at is not None:
                        yield held(at, state)
                    at, state = store_id, _Store(short, long)
                state.apply(seq, kind, "long" if tier == "long" else "short", *found_by)
        if at is not None:
            yield held(at, state)

    return _in_order(ops).mapInPandas(run, ITEMS)


def tier_sizes(replayed: DataFrame, short: int = SHORT_CAPACITY, long: int = LONG_CAPACITY) -> DataFrame:
    """(store_id, short_items, long_items, short_capacity, long_capacity) after the last operation of each store."""
    last = replayed.groupBy("store_id").agg(F.max_by(F.struct("short_items", "long_items"), "seq").alias("_s"))
    return last.select("store_id", "_s.*", F.lit(short).alias("short_capacity"), F.lit(long).alias("long_capacity"))
