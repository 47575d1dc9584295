import random
import re
from collections import Counter, defaultdict

import pytest
from made_texts import words

from oddsmith.llm import near_dups
from oddsmith.llm._links import components


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    seq = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(seq) < n:
        return frozenset([tuple(seq)] if seq else [])
    return frozenset(tuple(seq[k : k + n]) for k in range(len(seq) - n + 1))


def plain(rows, n, percent):
    """Set size and least id reachable of each (id, text), by an inverted list of shingles."""
    sets = [shingles(t, n) for _, t in rows]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for other, both in Counter(j for x in s for j in holders[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                above[top(k)] = top(other)
        for x in s:
            holders[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows)]


def check(docs, n, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(plain(rows, n, percent), key=str)
    found = near_dups.near_duplicates(docs, n, percent).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found], key=str) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)
    return found


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80), (3, 50)])
def test_documents(documents, n, percent):
    check(documents, n, percent)


def test_odd_rows(odd, none):
    check(odd, 3, 85)
    kept = near_dups.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {4, 5, 6, 7, 8, 9, 10, 11, 12} <= set(ids) and 2 not in ids
    assert near_dups.near_duplicates(none).collect() == []
    assert near_dups.keep_one(none).collect() == []


@pytest.mark.parametrize(("hubs", "block"), [(near_dups.HUBS, near_dups.BLOCK), (1, 4)])
def test_a_group_around_one_text_and_a_chain(spark, monkeypatch, hubs, block):
    """Copies that are near one text but not near each other, and texts linked one to the next."""
    monkeypatch.setattr(near_dups, "HUBS", hubs)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    chosen = random.Random(9)
    base = words(20, 80)
    rows = [(1000, " ".join(base))]
    for k in range(150):
        copy = list(base)
        for at in chosen.sample(range(80), 3):
            copy[at] = f"new{k}x{at}"
        rows.append((k, " ".join(copy)))
    chain = words(21, 100)
    for k in range(30):
        chain = [*chain[3:], f"c{k}a", f"c{k}b", f"c{k}c"]
        rows.append((2000 + k, " ".join(chain)))
    rows += [(3000 + k, " ".join(words(100 + k, 40))) for k in range(60)]
    chosen.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


@pytest.mark.parametrize("columns", [near_dups.COLUMNS, 7])
def test_blocks_join_what_is_linked(monkeypatch, columns):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(near_dups, "COLUMNS", columns)
    random = np.random.default_rng(4)
    base = random.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(random.choice(base, 45, replace=False)) for _ in range(24)]
    sets += [random.integers(0, 2**62, 30).astype(np.uint64) for _ in range(4)]
    first = [k % 3 == 0 for k in range(len(sets))]
    keys = [bytes([k]) for k in range(len(sets))]
    parts = [bytes([k // 2]) for k in range(len(sets))]
    names = ["band", "i", "j", "key", "component", "first", "shingles"]
    group = pa.table([[0] * 28] * 3 + [keys, parts, first, [x.tobytes() for x in sets]], names=names)
    found = near_dups._block_links(group, 60)

    def joined(links):
        above = {p: p for p in parts}

        def top(x):
            while above[x] != x:
                x = above[x]
            return x

        for a, b in links:
            above[max(top(parts[a]), top(parts[b]))] = min(top(parts[a]), top(parts[b]))
        return [top(p) for p in parts]

    want = [
        (a, b)
        for a in range(28)
        for b in range(28)
        if first[a] and not first[b]
        and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
    ]
    assert joined([(a[0], b[0]) for a, b in found]) == joined(want)
    assert want and len(found) < len(want)


def test_signature_agreement_is_the_similarity():
    import numpy as np

    signer = near_dups.Signer(3, 50)
    numbers = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    one, other = signer.signature(numbers[:2000]), signer.signature(numbers[1000:])
    wide = near_dups.Signer(3, 95)
    assert abs((one == other).mean() - 1 / 3) < 4 * (2 / 9 / signer.size) ** 0.5
    assert wide.agreeing <= wide.size


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    chosen = random.Random(seed)
    links = [(chosen.randint(0, 120), chosen.randint(0, 120)) for _ in range(70)]
    links += [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 330)]
    above = {x: x for pair in links for x in pair}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in found} == {x: top(x) for x in linked}
    assert len(found) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_columns_named_like_the_working_ones(odd):
    clash = odd.selectExpr("*", "1 gone_id", "2 gone_text", "3 _gone_id")
    found = near_dups.keep_one(clash)
    assert found.columns == clash.columns
    want = near_dups.keep_one(odd).collect()
    assert sorted(map(str, found.select(*odd.columns).collect())) == sorted(map(str, want))
