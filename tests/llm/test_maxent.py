import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from oddsmith.llm import maxent
from oddsmith.llm._shared import table
from oddsmith.llm._words import WordReader


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def check(docs, found):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    bottom = math.log10(total + 0.1 * (distinct + 1))
    want = []
    for i, text in rows:
        seq = tokens(text)
        base = sum(math.log10(counts[t] + 0.1) - bottom for t in seq)
        want.append((i, held(i), len(seq), sum(counts[t] > 0 for t in seq), total, round(base, 6)))
    got = [
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        for r in found
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("frequent", [maxent.FREQUENT, 30])
def test_baseline_is_exact(documents, monkeypatch, frequent):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    check(documents, maxent.score(documents, rounds=1).collect())


def test_odd_rows(odd, none):
    found = maxent.score(odd, rounds=2).collect()
    check(odd, found)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert maxent.score(none).collect() == []


def test_only_held_out_rows(spark):
    ids = [k for k in range(60) if held(k)]
    docs = spark.createDataFrame([(k, "nothing was learnt") for k in ids], "doc_id long, text string")
    found = maxent.score(docs).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in found)


def test_better_than_the_baseline_on_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [r for r in maxent.score(docs).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.1


def test_class_probabilities_sum_to_one():
    rows = np.random.default_rng(2).normal(size=maxent.Weights().rows.shape)
    found = maxent.class_probabilities(rows, np.arange(maxent.CLASSES**2))
    assert np.allclose(found.sum(axis=1), 1)


def test_gradient_is_the_slope_of_the_likelihood():
    random = np.random.default_rng(3)
    rows = random.normal(size=maxent.Weights().rows.shape) * 0.3
    cell = np.unique(random.integers(0, maxent.CLASSES**3, 300))
    n = random.integers(1, 5, len(cell)).astype(float)

    def likelihood(weights):
        found = maxent.class_probabilities(weights, cell // maxent.CLASSES)
        return (n * np.log(found[np.arange(len(cell)), cell % maxent.CLASSES])).sum()

    slope = np.zeros(rows.shape)
    for row, sums in maxent.context_gradient(rows, cell, n):
        slope[row] += np.frombuffer(sums, "<f4").reshape(2, -1)[0]
    toward = random.normal(size=rows.shape)
    step = 1e-4
    measured = (likelihood(rows + step * toward) - likelihood(rows - step * toward)) / (2 * step)
    assert abs(measured - (slope * toward).sum()) < 1e-2 * abs(measured) + 1e-2


def hash_of(words):
    batch = pa.RecordBatch.from_arrays([pa.array(words)], names=["text"])
    return [h for piece in WordReader().read(batch, 0) for h in piece.hash.view(np.int64).tolist()]


def shared(word):
    raw = word.encode()
    return ((raw[-1] * 256 + (raw[-2] if len(raw) > 1 else 0)) * 40503 >> 7) & (maxent.SHARED - 1)


def plain_weights(pairs, mass, of_class):
    """Weights and normalisers by context and class, each fitted by itself with many small steps."""
    groups = {}
    for (before, word), n in pairs.items():
        groups.setdefault((before, of_class[word]), {})[word] = n
    found = {}
    for group, seen in groups.items():
        total = sum(seen.values())
        kept = {w: n for w, n in seen.items() if n >= maxent.LEAST_PAIRS}
        weight = dict.fromkeys(kept, 0.0)
        for _ in range(3000):
            z = 1 + sum(mass[w] * math.expm1(u) for w, u in weight.items())
            for w, n in kept.items():
                expected = total * mass[w] * math.exp(weight[w]) / z
                weight[w] += 0.5 * (n - expected - maxent.PAIR_PRIOR * weight[w]) / (max(n, expected) + 1)
        found[group] = weight, 1 + sum(mass[w] * math.expm1(u) for w, u in weight.items())
    return found


@pytest.mark.parametrize("usual", [maxent.FREQUENT_PAIRS, 5])
def test_score_against_plain_softmax(spark, monkeypatch, usual):
    monkeypatch.setattr(maxent, "FREQUENT_PAIRS", usual)
    random = np.random.default_rng(5)
    lexicon = [a + b for a in "klmnprstvz" for b in ("ado", "eri", "ilu", "ona", "uke", "yso", "ate", "int")]
    steps = {w: random.choice(lexicon, 4) for w in lexicon}
    rows = []
    for k in range(120):
        text = [str(random.choice(lexicon))]
        while len(text) < 40:
            text.append(str(random.choice(steps[text[-1]]) if random.random() < 0.8 else random.choice(lexicon)))
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame([*rows, (200, None), (201, "unheard words")], "doc_id long, text string")
    learnt = [(i, t) for i, t in rows + [(200, None), (201, "unheard words")] if not held(i)]
    counts = Counter(t for _, text in learnt for t in tokens(text))
    ends = counts.pop("\n")
    by_hash = dict(zip(counts, hash_of(list(counts)), strict=True))
    ranked = sorted(counts, key=lambda w: (-counts[w], by_hash[w]))
    top, others = ranked[: maxent.ALONE], ranked[maxent.ALONE :]
    assert others
    of_class = {w: shared(w) for w in others}
    sums, kinds = Counter(), Counter()
    for w in others:
        sums[of_class[w]] += counts[w] + 0.1
        kinds[of_class[w]] += counts[w]
    mass = {w: (counts[w] + 0.1) / sums[of_class[w]] for w in others}
    sizes = Counter(of_class.values())
    pairs = Counter()
    for _, text in learnt:
        seq = ["\n", *tokens(text)]
        pairs.update((a, b) for a, b in zip(seq, seq[1:], strict=False) if b in of_class)
    fitted = plain_weights(pairs, mass, of_class)
    assert any(weight for weight, _ in fitted.values())
    alone = np.array([by_hash[w] for w in top], np.int64).view(np.uint64)
    trained = docs.filter(~maxent.held_out(docs.doc_id))
    rows_of = maxent.train(maxent.context_counts(trained, alone), 3)

    def number(word):
        if word == "\n":
            return maxent.END
        return top.index(word) if word in top else maxent.ALONE + 1 + shared(word)

    def score(text):
        seq, done = ["\n", "\n", *tokens(text)], 0.0
        for skip, before, word in zip(seq, seq[1:], seq[2:], strict=False):
            context = np.array([number(skip) * maxent.CLASSES + number(before)])
            line = sum(rows_of[at[0]] for at in maxent.Weights.features(context))
            done += (line[number(word)] - np.log(np.exp(line).sum())) / math.log(10)
            if word == "\n":
                done += math.log10((ends + 0.1) / (ends + 0.2))
            elif word in top:
                done += math.log10((counts[word] + 0.1) / (counts[word] + 0.2))
            else:
                c = shared(word)
                done += math.log10((counts[word] + 0.1) / (kinds[c] + 0.1 * (sizes[c] + 1)))
                weight, z = fitted.get((before, c), ({}, 1))
                if word in of_class:
                    done += (weight.get(word, 0) - math.log(z)) / math.log(10)
        return done

    found = {r["doc_id"]: r["score"] for r in maxent.score(docs, rounds=3).collect()}
    for row in docs.collect():
        assert found[row["doc_id"]] == pytest.approx(score(row["text"]), rel=2e-3, abs=2e-3)
