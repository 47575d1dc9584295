import random
import zlib
from collections import defaultdict

import pytest

from oddsmith.llm import sharding
from oddsmith.llm._shared import table


def plain_best_fit(sizes, capacity):
    """Best fit decreasing, one group at a time over a list."""
    left = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(left) if r >= size]
        if fits:
            _, k = min(fits)
            left[k] -= size
        else:
            left.append(max(capacity, size) - size)
    return len(left), sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_single_steps(seed):
    chosen = random.Random(seed)
    sizes = [chosen.randint(1, 60) for _ in range(400)]
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    runs = sharding.best_fit_decreasing(histogram, 100)
    count, left = plain_best_fit(sizes, 100)
    used = defaultdict(int)
    for size, _, shard, groups in runs:
        used[shard] += size * groups
    assert len(used) == count
    assert sorted(100 - u for u in used.values()) == left
    for size, groups in histogram:
        places = sorted((f, n) for s, f, _, n in runs if s == size)
        assert [f for f, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) == groups


def test_the_tree_gives_the_tightest():
    chosen = random.Random(5)
    items = [(chosen.randint(0, 500), k) for k in range(3000)]
    tree, left = sharding.CapacityTree(items), sorted(items)
    for k in range(3000, 5000):
        size = chosen.randint(0, 520)
        want = next((i for i in left if i[0] >= size), None)
        got = tree.pop_tightest(size)
        assert got == want
        if got:
            left.remove(got)
        new = (chosen.randint(0, 500), k)
        tree.add(*new)
        left.append(new)
        left.sort()


def test_an_oversized_group_does_not_unbalance_the_rest():
    runs = sharding.pack_evenly([(1000, 1), (10, 90)], 10)
    used = defaultdict(int)
    for size, _, shard, groups in runs:
        used[shard] += size * groups
    assert sorted(used.values()) == [100] * 9 + [1000]


def check(rows, shards):
    groups, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r["shard"] < shards
        groups[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_documents(spark, small, texts):
    rows = sharding.shard(table(spark, small, "documents")).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
    loads = check(rows, 24)
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows)


def test_odd_rows(odd, none):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count()
    check(rows, 24)
    assert {r["size"] for r in rows if r["doc_id"] in (4, 5)} == {8}
    assert sharding.shard(none).collect() == []


def test_fixed_capacity(documents):
    rows = sharding.shard(documents, shards=None, capacity=50_000).collect()
    loads = check(rows, 10**9)
    total = sum(loads.values())
    assert max(loads.values()) <= 50_000 and len(loads) <= 2 * -(-total // 50_000)
