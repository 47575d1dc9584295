"""Toxicity by two class-conditional Kneser-Ney models, one of toxic and one of ordinary texts.

The models give the probability of each letter of a word after the (up to four) bytes before it.
Each class discounts its own counts and gives the rest to a Kneser-Ney model of both classes
together, whose lower orders count in how many contexts a piece occurs; so what is rare in one class
is as likely in it as elsewhere, and only expressions that the classes use differently tell them
apart. A word's evidence is the logarithm of its toxic over its ordinary likelihood. Of a text three
averages over its words are taken, so that its length does not matter: the evidence, its part above a
floor, and the share of words with strong evidence. A logistic curve turns them into a probability;
it is fitted on evidence from models that did not see the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import TEXT_ROWS, by_frequency, landed
from oddsmith.llm._words import Words, WordReader

# Labelled rows that the models are fitted on, at most, chosen by a hash of the id, and pieces
# that they keep, at most, the most frequent ones.
FITTED_ROWS = 20_000
PIECES = 1 << 20
FOLDS = 3
# Bytes of a piece, the last of them predicted from the others.
ORDER = 5
DISCOUNT, SHARED = 0.75, 50.0
FLOOR, CEILING, STRONG = 2.0, 4.0, 3.0
THRESHOLD = 0.5
# Distinct pieces that a task holds before it hands their counts on.
HELD = 1 << 17
_MARK = 0x20
_CHUNK = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Rows kept for judging the models; their labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every piece of the given words, packed into a number, and where each word's pieces begin.

    A word has one piece for each byte and one for its end. A piece reaches back to the word's
    begin at most, which counts as a byte.
    """
    size = end - start + 1
    stop = np.cumsum(size)
    letters = np.ones(int(stop[-1]) if len(stop) else 0, bool)
    letters[stop - 1] = False
    at = np.flatnonzero(letters)
    held = np.full(len(letters) + ORDER, _MARK, np.uint64)
    held[at + ORDER] = data[at + np.repeat(start - (stop - size), end - start)]
    packed = held[ORDER:].copy()
    inside = np.ones(len(letters), bool)
    for back in range(1, ORDER):
        before = held[ORDER - back : len(held) - back]
        packed |= np.where(inside, before, np.uint64(0)) << np.uint64(8 * back)
        inside &= before != _MARK
    return packed, stop - size


def _distinct(words: Words):
    """The distinct words of a piece of texts, in chunks, and for each word which one it is."""
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    start, end = words.start[first], words.end[first]
    chunk = np.cumsum(end - start) // _CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(first)] if len(first) else [0]
    return [(start[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], which


@dataclass
class Table:
    """Sorted keys and the value of each."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys there are, and the values, 0 for others."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return found, np.where(found, self.values[at], 0.0)


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    each, back = np.unique(keys, return_inverse=True)
    return each, back, *(np.bincount(back, v, len(each)) for v in values)


def shared_probabilities(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Interpolated Kneser-Ney probability of each piece's last byte, from both classes' counts.

    Below the full order a piece counts as often as there are different bytes before it.
    """
    levels = [keys]
    for order in range(ORDER - 1, 0, -1):
        levels.append(np.unique(levels[-1] & np.uint64((1 << 8 * order) - 1)))
    below, lower = None, None
    for order in range(1, ORDER + 1):
        level = levels[ORDER - order]
        if order == ORDER:
            times = n
        else:
            longer = levels[ORDER - order - 1] & np.uint64((1 << 8 * order) - 1)
            times = np.bincount(np.searchsorted(level, longer), minlength=len(level))
        _, context, total, kinds = _grouped(level >> np.uint64(8), times, np.ones(len(level)))
        if order == 1:
            backed = np.full(len(level), 1 / 256)
        else:
            backed = lower[np.searchsorted(below, level & np.uint64((1 << 8 * (order - 1)) - 1))]
        own = np.maximum(times - DISCOUNT, 0)
        below, lower = level, (own + DISCOUNT * kinds[context] * backed) / total[context]
    return lower


@dataclass
class Evidence:
    """Logarithm of toxic over ordinary likelihood: of known pieces, and of others by context."""

    known: Table
    context: Table

    @staticmethod
    def of(keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> Evidence:
        """The two models from sorted pieces and their counts in each class."""
        seen = ordinary + toxic > 0
        keys, counts = keys[seen], (ordinary[seen], toxic[seen])
        shared = shared_probabilities(keys, counts[0] + counts[1])
        rest, chance = [], []
        for n in counts:
            contexts, context, total, kinds = _grouped(keys >> np.uint64(8), n, n > 0)
            rest.append((DISCOUNT * kinds + SHARED) / (total + SHARED))
            own = np.maximum(n - DISCOUNT, 0) / (total + SHARED)[context]
            chance.append(own + rest[-1][context] * shared)
        of_piece, of_context = np.log(chance[1] / chance[0]), np.log(rest[1] / rest[0])
        return Evidence(
            Table(keys, of_piece.astype(np.float32)), Table(contexts, of_context.astype(np.float32))
        )

    def of_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        packed, begin = pieces(data, start, end)
        found, value = self.known.find(packed)
        unknown = np.flatnonzero(~found)
        value[unknown] = self.context.find(packed[unknown] >> np.uint64(8))[1]
        return np.add.reduceat(value, begin) if len(begin) else np.zeros(0)

    def of_texts(self, words: Words) -> np.ndarray:
        """Three averages over the words of each text; zeros where there are none."""
        chunks, which = _distinct(words)
        each = [self.of_words(words.data, *chunk) for chunk in chunks]
        value = np.concatenate(each)[which] if each else np.zeros(0)
        n = np.maximum(words.counts(), 1)
        parts = value, np.clip(value - FLOOR, 0, CEILING), value > STRONG
        sums = [np.bincount(words.row, part.astype(float), words.rows) for part in parts]
        return np.stack(sums, 1) / n[:, None]


@dataclass
class Model:
    """Evidence of words and the curve over its averages; the last weight is the constant."""

    evidence: Evidence
    weights: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        averages = self.evidence.of_texts(words)
        return _curve(averages @ self.weights[:-1] + self.weights[-1])


def _curve(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def logistic(rows: np.ndarray, labels: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic curve by Newton steps, slightly drawn to zero, for scaled columns."""
    middle, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.column_stack([(rows - middle) / scale, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _curve(x @ w)
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(curvature, x.T @ (p - labels) + 0.01 * w)
    plain = w[:-1] / scale
    return np.append(plain, w[-1] - plain @ middle)


def _fitted_texts(
    docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, most: int
) -> DataFrame:
    """``fold, label, text`` of the rows to learn from: one text of each id whose labels agree."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    each = known.groupBy(F.col(doc_id).cast("long").alias("key")).agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")
    )
    usable = each.filter("label = other").filter(~held_out(F.col("key")))
    chosen = usable.orderBy(F.xxhash64("key"), "key").limit(most).select("key", "label")
    named = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    rows = named.join(F.broadcast(landed(chosen, "toxic-labels")), "key")
    once = rows.groupBy("key").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(FOLDS)).cast("int")
    return landed(once.select(fold.alias("fold"), "label", "text"), "toxic-texts", TEXT_ROWS)


def piece_counts(texts: DataFrame) -> DataFrame:
    """``piece, n0, n1, ..., n``: counts by fold and label (twice the fold plus the label)."""

    kinds = 2 * FOLDS

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        each, back = np.unique(np.concatenate([keys for keys, _ in held]), return_inverse=True)
        n = np.concatenate([n for _, n in held], axis=1)
        return each, np.stack([np.bincount(back, row, len(each)) for row in n])

    def handed_on(held: list) -> pa.RecordBatch:
        keys, n = held.pop()
        columns = [pa.array(keys.view(np.int64)), *(pa.array(row.astype(np.int64)) for row in n)]
        return pa.RecordBatch.from_arrays(columns, names=["piece", *(f"n{k}" for k in range(kinds))])

    def counted(batches):
        reader, held = WordReader(), []
        for batch in batches:
            group = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            for words in reader.read(batch, 2):
                chunks, which = _distinct(words)
                of_word = group[words.first + words.row].astype(np.int64)
                often = np.bincount(which * kinds + of_word, minlength=kinds * len(words.hash))
                at = 0
                for start, end in chunks:
                    packed, _ = pieces(words.data, start, end)
                    word = at + np.repeat(np.arange(len(start)), end - start + 1)
                    at += len(start)
                    held.append((packed, np.stack([often[word * kinds + k] for k in range(kinds)])))
                    held = [merged(held)]
                if held and len(held[0][0]) > HELD:
                    yield handed_on(held)
        if held:
            yield handed_on(held)

    names = [f"n{k}" for k in range(2 * FOLDS)]
    schema = ", ".join(["piece long", *(f"{name} long" for name in names)])
    found = texts.select("fold", "label", "text").mapInArrow(counted, schema)
    sums = found.groupBy("piece").agg(*[F.sum(name).alias(name) for name in names])
    return sums.withColumn("n", sum(F.col(name) for name in names))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    text: str = "text",
    doc_id: str = "doc_id",
    most: int = FITTED_ROWS,
) -> Model:
    """The two models and the curve.

    At most ``most`` labelled ids are used, the first by a hash of the id; ids with contradicting
    labels and held-out ids are not. Counting is spread over tasks; the driver gets the counts of
    at most ``PIECES`` pieces. Without usable rows of both labels every score is the share of
    toxic rows, 0 if there are none.
    """
    texts = _fitted_texts(docs, labels, label, text, doc_id, most)
    often, _ = by_frequency(landed(piece_counts(texts), "toxic-pieces", TEXT_ROWS), "n", PIECES)
    table = often.orderBy("piece").toArrow()
    keys = table.column("piece").to_numpy().view(np.uint64)
    n = np.array([table.column(f"n{k}").to_numpy() for k in range(2 * FOLDS)], float)
    n = n.reshape(FOLDS, 2, len(keys))
    evidence = Evidence.of(keys, n[:, 0].sum(axis=0), n[:, 1].sum(axis=0))
    unseen = [
        Evidence.of(keys, *(np.delete(n, fold, axis=0).sum(axis=0))) for fold in range(FOLDS)
    ]
    sent = docs.sparkSession.sparkContext.broadcast(unseen)

    def averaged(batches):
        reader = WordReader()
        for batch in batches:
            fold = batch.column(0).to_numpy()
            for words in reader.read(batch, 2):
                rows = [sent.value[k].of_texts(words) for k in range(FOLDS)]
                chosen = np.stack(rows)[fold[words.first : words.last], np.arange(words.rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(words.first, words.rows), *map(pa.array, chosen.T)],
                    names=["label", "a", "b", "c"],
                )

    rows = landed(
        texts.select("fold", "label", "text").mapInArrow(averaged, "label int, a double, b double, c double"),
        "toxic-averages",
        TEXT_ROWS,
    ).toArrow()
    marks = rows.column("label").to_numpy().astype(float)
    if len(set(marks)) < 2:
        share = marks.mean() if len(marks) else 0.0
        return Model(evidence, np.array([0, 0, 0, 35.0 if share else -35.0]))
    averages = np.column_stack([rows.column(name).to_numpy() for name in "abc"])
    return Model(evidence, logistic(averages, marks))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: ``doc_id, score``, the probability of label 1.

    Null, empty and blank texts score as the curve's constant says. Texts of any length are read
    whole. Repeated rows each give a row; an empty table gives none. Nothing but the text enters.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        reader = WordReader()
        for batch in batches:
            values = np.zeros(len(batch))
            for words in reader.read(batch, 1):
                values[words.first : words.last] = sent.value.scores(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        scored, "doc_id long, score double"
    )


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
