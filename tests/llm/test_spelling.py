import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from oddsmith.llm import spelling
from oddsmith.llm._shared import table


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def neighbours(words):
    """Words one edit apart, by what is left of them without one letter."""
    shorter, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter[w[:k], w[k + 1 :]].add(w)
            less = w[:k] + w[k + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in shorter.values():
        for w in group:
            near[w] |= group - {w}
    return near


def expected(n):
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(rows, key=str)


def found(df):
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted([tuple(r[c] for c in names) for r in df.collect()], key=str)


@pytest.mark.parametrize(("box", "part", "few"), [(4096, 1 << 16, 48), (100, 50, 8)])
def test_given_documents(spark, monkeypatch, box, part, few):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling.upper_trees, "__defaults__", (spelling.SAMPLE, box))
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = expected(counted(rows))
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)
    assert found(spelling.spelling_report(docs)) == want


def words_of(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_chains_ties_and_anagrams(spark):
    n = {"abcdefg": 3, "abcdefgh": 40, "abcdefghi": 500, "abcdefghij": 6000, "xbcdefg": 3, "ybcdefg": 30}
    # many words of the same letters, and near ones of theirs
    letters = list("abcdeffgh")
    random = np.random.default_rng(1)
    for _ in range(400):
        word = "".join(random.permutation(letters))
        n[word] = int(random.integers(2, 9))
        for other in (word[:4] + "z" + word[5:], word[:3] + "z" + word[3:]):
            n[other] = int(random.integers(2, 900))
    n.update({"éàçèñöü": 2, "éàçèñöûü": 20, "éàçèñöúü": 20, "éàçèñöÿ": 2, "x" * 3000: 5, "x" * 2999: 50})
    got = found(spelling.variants(words_of(spark, n)))
    assert got == expected(n)
    by_word = {r[0]: r for r in got}
    assert by_word["abcdefg"][2] == "abcdefghij" and by_word["éàçèñöü"][1] == "éàçèñöúü"


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(spelling.spelling_report(odd)) == expected(counted(rows))
    assert spelling.spelling_report(none).collect() == []


def test_boxes_leave_out_no_near_word():
    random = np.random.default_rng(2)
    words = sorted({"".join(random.choice(list("abcdeé"), 8)) for _ in range(3000)})
    letters, place = spelling.letters_of(pa.array(words))
    counts = spelling.counts_of(spelling.matrix_of(letters, place[:-1], 8))
    tree, held = spelling.Tree.over(counts, 20)
    assert sorted(np.concatenate(held)) == list(range(len(words)))
    met = set()
    for leaf, rows in tree.search(counts, 1, 1):
        met |= {(int(a), int(b)) for a in rows for b in held[leaf]}
    assert len(met) < len(words) ** 2 / 2
    where = {w: k for k, w in enumerate(words)}
    near = neighbours(where)
    assert all((where[a], where[b]) in met for a in near for b in near[a])
    home = tree.home(counts)
    assert all((home[rows] == leaf).all() for leaf, rows in enumerate(held))
