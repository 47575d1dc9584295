import re
from collections import defaultdict

from oddsmith.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights, budget, repeats):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = budget * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= repeats * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def test_targets_and_taken_words(spark, documents):
    rows = mixing.mix_report(documents).collect()
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = filled(sizes, (3, 1, 2), 1.5, 2)
    for r in rows:
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * max(1, want[source[r["doc_id"]]])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
    total = sum(sizes.values())
    assert 1.5 * total - max(largest.values()) <= sum(taken.values()) <= 1.5 * total
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(largest.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(documents).collect()))


def test_the_mix_is_what_the_report_says(spark, documents):
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(documents).collect()}
    got = defaultdict(int)
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    for r in mixed.collect():
        got[r["doc_id"]] += size(r["text"])
    assert {k: v for k, v in report.items() if v} == dict(got)


def test_odd_rows(odd, none):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert [r["taken"] for r in rows if r["doc_id"] in (4, 5, 6)] == [0, 0, 0]
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_report(none).collect() == [] and mixing.mix(none).collect() == []


def test_every_source_full_when_the_budget_is(spark, odd):
    rows = mixing.mix_report(odd, budget=5.0).collect()
    assert all(r["taken"] == 2 * r["size"] for r in rows)
