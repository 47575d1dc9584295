import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from oddsmith.llm import toxicity
from oddsmith.llm._shared import table
from oddsmith.llm._words import WordReader


def pieces_of(word):
    raw = b" " + word.encode() + b" "
    return [raw[max(0, k - 4) : k + 1] for k in range(1, len(raw))]


class Plain:
    """Both models with dictionaries and a probability at a time."""

    def __init__(self, ordinary, toxic):
        self.n = [Counter(p for w in texts for p in pieces_of(w)) for texts in (ordinary, toxic)]
        self.levels = [Counter(), Counter(), Counter(), Counter(), Counter(), self.n[0] + self.n[1]]
        level = set(self.levels[5])
        for order in (4, 3, 2, 1):
            self.levels[order] = Counter(p[-order:] for p in level)
            level = set(self.levels[order])

    def shared(self, piece, order):
        if order == 0:
            return 1 / 256
        level = self.levels[order]
        piece = piece[-order:]
        mine = [n for p, n in level.items() if p[:-1] == piece[:-1]]
        backed = self.shared(piece, order - 1)
        return (max(level[piece] - 0.75, 0) + 0.75 * len(mine) * backed) / sum(mine)

    def chance(self, piece, label):
        mine = [n for p, n in self.n[label].items() if p[:-1] == piece[:-1]]
        rest = (0.75 * len(mine) + 50) / (sum(mine) + 50)
        if piece not in self.levels[5]:
            return rest
        return max(self.n[label][piece] - 0.75, 0) / (sum(mine) + 50) + rest * self.shared(piece, 5)

    def evidence(self, word):
        return sum(math.log(self.chance(p, 1) / self.chance(p, 0)) for p in pieces_of(word))


def packed(word):
    return [int.from_bytes(p, "big") for p in pieces_of(word)]


def test_evidence_against_plain_models():
    ordinary = ["the", "then", "there", "hen", "other", "été", "a", "the", "anthem"] * 4
    toxic = ["the", "then", "idiot", "idiots", "other", "ça"] * 3
    plain = Plain(ordinary, toxic)
    keys = np.array(sorted({int.from_bytes(p, "big") for p in plain.levels[5]}), np.uint64)
    n = [
        np.array([plain.n[c][int(k).to_bytes(5, "big").lstrip(b"\0")] for k in keys], float) for c in (0, 1)
    ]
    model = toxicity.Evidence.of(keys, *n)
    asked = ["the", "idiot", "idiotic", "there", "zebra", "été", "t", "ça", "thesis"]
    (words,) = WordReader().read(pa.record_batch([pa.array([" ".join(asked)])], names=["t"]), 0)
    got = model.of_words(words.data, words.start, words.end)
    assert np.allclose(got, [plain.evidence(w) for w in asked], atol=1e-4)
    assert got[1] > 0.5 > abs(got[0])
    keys, begin = toxicity.pieces(words.data, words.start, words.end)
    assert keys.tolist() == [p for w in asked for p in packed(w)]
    assert begin.tolist() == np.cumsum([0, *(len(packed(w)) for w in asked)])[:-1].tolist()
    value = plain.evidence("idiot") + plain.evidence("the")
    (both,) = WordReader().read(pa.record_batch([pa.array(["Idiot the", ""])], names=["t"]), 0)
    assert np.allclose(model.of_texts(both)[:, 0], [value / 2, 0], atol=1e-4)


def test_shared_probabilities_sum_to_one_below_the_whole():
    plain = Plain(["anna", "annals", "banana"], ["bandana"])
    keys = np.array(sorted({int.from_bytes(p, "big") for p in plain.levels[5]}), np.uint64)
    n = np.array([plain.levels[5][int(k).to_bytes(5, "big").lstrip(b"\0")] for k in keys], float)
    found = toxicity.shared_probabilities(keys, n)
    for context in np.unique(keys >> np.uint64(8)):
        assert found[keys >> np.uint64(8) == context].sum() <= 1 + 1e-9


def test_counts_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 50)
    texts = [(k % 3, k % 2, f"word{k % 7} the the été{k}") for k in range(40)]
    df = spark.createDataFrame(texts, "fold int, label int, text string").repartition(5)
    want = Counter()
    for fold, label, text in texts:
        for word in text.split(" "):
            want.update((p, 2 * fold + label) for p in packed(word))
    got = {
        (r["piece"], k): r[f"n{k}"] for r in toxicity.piece_counts(df).collect() for k in range(6) if r[f"n{k}"]
    }
    assert got == dict(want)


def test_held_out_accuracy(spark):
    folder, least = "/root/testdata/sf0.1", 0.94
    labels = table(spark, folder, "labels")
    rows = toxicity.toxicity_report(table(spark, folder, "documents"), labels).collect()
    label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    judged = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(p == y for p, y in judged) / len(judged) > least
    clean = [p for p, y in judged if y == 0]
    assert sum(clean) / len(clean) < 0.03


def test_held_out_labels_and_other_columns_are_never_learnt(spark, documents, small):
    labels = table(spark, small, "labels")
    turned = labels.selectExpr(
        "doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end toxic"
    )
    blank = documents.selectExpr("doc_id", "text", "'x' lang", "'y' source", "0L n_chars")
    one, two = toxicity.fit(documents, labels), toxicity.fit(blank, turned)
    assert np.allclose(one.weights, two.weights)
    assert (one.evidence.known.values == two.evidence.known.values).all()


def test_odd_rows(spark, odd, none):
    schema = "doc_id long, toxic int, text string"
    labels = spark.createDataFrame(
        [(1, 1, "a"), (1, 1, "b"), (2, 0, "c"), (3, None, None), (None, 1, "d"), (7, 1, ""), (7, 0, ""), (11, 0, "")],
        schema,
    )
    rows = toxicity.toxicity_report(odd, labels).collect()
    assert len(rows) == odd.count()
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5, 6)}) == 1
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity_report(none, labels).collect() == []
    nothing = toxicity.toxicity_report(odd, labels.limit(0)).collect()
    assert {r["predicted"] for r in nothing} == {0}
