"""A quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features are words, pairs of words, word shapes and pairs of shapes, hashed to a fixed number of
slots. A shape is the word with letters, capitals, digits and other characters replaced by their
kind and runs reduced to one; a word that repeats the one before it is a feature
of its own. Labelled rows, a bounded number of them, become sparse rows in
parallel; one task then runs follow-the-regularised-leader updates over them. Every text is scored
whole by a sparse dot product with the weights, which are of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import TEXT_ROWS, landed, shuffles_dropped
from oddsmith.llm._words import Words, WordReader, mixed

SLOTS = 1 << 18
# Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
FITTED_ROWS = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02
THRESHOLD = 0.7
# The bias is a feature of this value, small beside a row's length of 1: what is not known about a
# short text should not count against it.
BIAS = 0.1
_REPEATED = np.uint64(0x2545F4914F6CDD1D)
_SEEDS = [np.uint64(0x51ED270B9 * k + 7) for k in (1, 2, 3, 4)]


class Features:
    """Sparse rows of a piece of texts: slots, with their weights in the row, row by row."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.reader = WordReader(lower=False)
        kind = np.full(256, ord("u"), np.uint8)
        kind[0:128] = np.arange(128)
        kind[0x30:0x3A] = ord("0")
        kind[0x41:0x5B] = ord("A")
        kind[0x61:0x7B] = kind[0x80:] = ord("a")
        self._kind = kind

    def _shapes(self, words: Words) -> np.ndarray:
        if not len(words.start):
            return np.zeros(0, np.uint64)
        kinds = self._kind[words.data]
        kept = np.ones(len(kinds), bool)
        kept[1:] = kinds[1:] != kinds[:-1]
        kept[words.start] = True
        place = np.cumsum(kept)
        return self.reader.hashes(kinds[kept], place[words.start] - 1, place[words.end - 1])

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, slot and value of every feature; a row's values have the Euclidean length 1."""
        keys = []
        shapes = self._shapes(words)
        same = words.row[1:] == words.row[:-1]
        with np.errstate(over="ignore"):
            for single, pair, hashes in ((0, 1, words.hash), (2, 3, shapes)):
                keys.append((words.row, mixed(hashes + _SEEDS[single])))
                both = hashes[:-1] * np.uint64(3) + mixed(hashes[1:] + _SEEDS[pair])
                keys.append((words.row[1:][same], mixed(both[same])))
        again = same & (words.hash[1:] == words.hash[:-1])
        keys.append((words.row[1:][again], np.full(int(again.sum()), _REPEATED)))
        row = np.concatenate([r for r, _ in keys]).astype(np.int64)
        slot = np.concatenate([h & np.uint64(self.slots - 1) for _, h in keys]).astype(np.int64)
        each, times = np.unique(row * self.slots + slot, return_counts=True)
        row, slot = each // self.slots, each % self.slots
        value = np.sqrt(times)
        length = np.sqrt(np.bincount(row, times, minlength=words.rows))
        return row, slot, value / length[row]


def _usable(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """One row for each id whose labels are known and agree."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    each = known.groupBy(F.col(doc_id).cast("long").alias("__id")).agg(
        F.min(label).cast("int").alias("__label"), F.max(label).cast("int").alias("__other")
    )
    return each.filter("__label = __other").drop("__other")


def held_out(doc_id: Column) -> Column:
    """Rows kept for judging the classifier; their labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    doc_id: str = "doc_id",
    most: int = FITTED_ROWS,
) -> np.ndarray:
    """The weights, and the bias at the end.

    At most ``most`` labelled ids are used, the first by a hash of the id; ids with contradicting
    labels and held-out ids are not. Of rows that share an id one text counts. Without any usable
    label all weights are zero.
    """
    chosen = landed(
        _usable(labels, label, doc_id)
        .filter(~held_out(F.col("__id")))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most),
        "quality-labels",
    )

    def sparse(batches):
        features = Features()
        for batch in batches:
            for words in features.reader.read(batch, 2):
                row, slot, value = features.rows(words)
                cuts = np.searchsorted(row, np.arange(words.rows + 1))
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, words.rows),
                        batch.column(1).slice(words.first, words.rows),
                        pa.array([slot[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                        pa.array([value[a:b].astype("<f4").tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["id", "label", "slots", "values"],
                )

    def trained(batches):
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([follow_the_leader(rows).astype("<f4").tobytes()], pa.binary())],
            names=["weights"],
        )

    rows = (
        docs.selectExpr(f"cast(`{doc_id}` as bigint) __id", f"`{text}` text")
        .join(F.broadcast(chosen), "__id")  # ``most`` rows of two numbers at most
        .select("__id", "__label", "text")
        .mapInArrow(sparse, "id long, label int, slots binary, values binary")
    )
    once = rows.groupBy("id").agg(F.min(F.struct("label", "slots", "values")).alias("r"))
    learnt = (
        once.select("id", "r.*")
        .repartition(1)
        .sortWithinPartitions(F.xxhash64("id"), "id")
        .mapInArrow(trained, "weights binary")
    )
    with shuffles_dropped(docs.sparkSession, TEXT_ROWS):
        found = learnt.first()
    return np.frombuffer(found[0], "<f4") if found else np.zeros(SLOTS + 1, np.float32)


def follow_the_leader(rows: list[tuple[int, bytes, bytes]], epochs: int = EPOCHS) -> np.ndarray:
    """Proximal FTRL over sparse rows ``(label, slots, values)``; the bias is the last weight."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(at):
        zs = z[at]
        shrunk = np.sign(zs) * L1 - zs
        return np.where(np.abs(zs) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    sparse = [
        (label, np.append(np.frombuffer(s, "<u4").astype(np.int64), SLOTS), np.append(np.frombuffer(v, "<f4"), BIAS))
        for label, s, v in rows
    ]
    for _ in range(epochs):
        for label, at, x in sparse:
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(SLOTS + 1))


def score(
    docs: DataFrame, weights: np.ndarray, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row a document: ``doc_id, score``, the probability of label 1.

    Null, empty and blank texts score as the bias says. Repeated rows each give a row; an empty
    table gives none. Nothing but the text enters the score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches):
        features = Features()
        for batch in batches:
            values = np.zeros(len(batch))
            for words in features.reader.read(batch, 1):
                values[words.first : words.last] = dot(features, words, sent.value)
            p = 1.0 / (1.0 + np.exp(-np.clip(values, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(
        scored, "doc_id long, score double"
    )


def dot(features: Features, words: Words, weights: np.ndarray) -> np.ndarray:
    row, slot, value = features.rows(words)
    return np.bincount(row, weights[slot] * value, minlength=words.rows) + BIAS * weights[-1]


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, with their columns.

    The weights are applied to each row's text where it lies; nothing is joined.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def kept(batches):
        features = Features()
        for batch in batches:
            values = np.zeros(len(batch))
            for words in features.reader.read(batch, at):
                values[words.first : words.last] = dot(features, words, sent.value)
            good = 1.0 / (1.0 + np.exp(-np.clip(values, -35, 35))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)
