"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Words fall into classes: the most frequent ones stand alone, the others share a class by a hash of
their last two bytes. A word's probability is that of its class after the two words before it, times
that of the word within its class. Both factors are trained:

* The class is a softmax over hashed features: the previous word's class (n-gram), the one before
  (skip), and both together (n-gram). Training counts how often each class follows each context over
  all training texts; every round adds up the gradients of all tasks.
* The word is a softmax over the words of its class. Its bias is the logarithm of its smoothed count,
  its feature the pair of previous word (by hash) and word. Pairs are counted over all training
  texts, so their table grows with the corpus; those seen ``LEAST_PAIRS`` times get a weight. A
  context's words of one class are normalised together and by themselves, so they are fitted in one
  place, and the sum below the fraction needs only the words that have a weight. Words beyond the
  ``FREQUENT`` ones have no weights; their share of the class and their counts decide.

The unigram baseline uses exact counts of all words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import TEXT_ROWS, by_frequency, landed, repeated_mask, shuffles_dropped
from oddsmith.llm._words import Words, WordReader, mixed

# Words in classes of their own, the end of a text, and shared classes.
ALONE, SHARED = 63, 64
CLASSES = ALONE + 1 + SHARED
END = ALONE
END_HASH = np.uint64(0x0E0D0F0A11B0A7ED)
PAIR_SLOTS = 2048
ROUNDS = 15
# Tasks that add up the gradients of a round.
GRADIENT_TASKS = 4
STEP, SMOOTH, PRIOR = 0.35, 4.0, 0.5
ADDED = 0.1
# Words whose counts are broadcast, at most; the others are joined.
FREQUENT = 1 << 18
# Distinct words that a task holds before it hands its counts on.
HELD = 1 << 17
# A pair's key: 39 bits of the previous word's hash, 6 of the word's class, 18 of its place in it.
PLACE_BITS = 18
CONTEXT_SHIFT = 25
# Occurrences of a pair that earn it a weight, the weights' prior, and the rounds that fit them.
LEAST_PAIRS, PAIR_PRIOR, PAIR_ROUNDS = 2, 0.25, 20
# Pairs whose weights are broadcast, at most; the others are joined.
FREQUENT_PAIRS = 1 << 20
# Pairs that a task holds before it works on them.
PAIRS_HELD = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Rows that the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _shared_class(words: Words) -> np.ndarray:
    """0 to 63 from the last two bytes of each word."""
    last = words.data[words.end - 1].astype(np.int64)
    before = np.where(words.end - words.start > 1, words.data[words.end - 2], 0).astype(np.int64)
    return ((last * 256 + before) * 40503 >> 7) & (SHARED - 1)


class _Counter:
    """Sums of equal hashes, merged whenever many are held."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, hashes: np.ndarray, shared: np.ndarray, n: np.ndarray) -> None:
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.parts.append((each, shared[first], np.bincount(back, n).astype(np.int64)))
        self.held += len(each)

    def merge(self) -> None:
        hashes, shared, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        self.add(hashes, shared, n)

    def batch(self) -> pa.RecordBatch:
        self.merge()
        hashes, shared, n = self.parts.pop()
        self.held = 0
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(shared.astype(np.int32)), pa.array(n)],
            names=["hash", "shared", "n"],
        )


def word_counts(docs: DataFrame) -> DataFrame:
    """``hash, shared, n``: every distinct token of the column ``text``, with the ends of texts."""

    def counted(batches):
        reader, counter = WordReader(), _Counter()
        for batch in batches:
            ends = np.array([END_HASH]), np.array([0]), np.array([len(batch)])
            counter.add(*ends)
            for words in reader.read(batch, 0):
                counter.add(words.hash, _shared_class(words), np.ones(len(words.hash)))
                if counter.held >= HELD:
                    counter.merge()
                if counter.held >= HELD:
                    yield counter.batch()
        if counter.parts:
            yield counter.batch()

    rows = docs.select("text").mapInArrow(counted, "hash long, shared int, n long")
    return rows.groupBy("hash").agg(F.min("shared").alias("shared"), F.sum("n").alias("n"))


class ClassReader:
    """Class and context of every token of a piece of texts."""

    def __init__(self, alone: np.ndarray):
        order = np.argsort(alone)
        self._alone, self._class = alone[order], order

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, context and class of each token: the words of a text, then its end.

        A context is the class before the previous one, times the classes, plus the previous one;
        before a text stands its end.
        """
        classes = ALONE + 1 + _shared_class(words)
        if len(self._alone):
            at = np.minimum(np.searchsorted(self._alone, words.hash), len(self._alone) - 1)
            known = self._alone[at] == words.hash
            classes[known] = self._class[at[known]]
        counts = words.counts()
        ends = np.cumsum(counts + 1)
        row = np.repeat(np.arange(words.rows), counts + 1)
        token = np.full(2 + len(row), END, np.int64)
        token[2 + np.arange(len(classes)) + words.row] = classes
        skip = token[:-2].copy()
        skip[ends - counts - 1] = END
        return row, skip * CLASSES + token[1:-1], token[2:]


def _pair_slot(context: np.ndarray) -> np.ndarray:
    return (mixed(context.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)


class Weights:
    """Weights of the class softmax: a bias, and a row of classes for each feature."""

    def __init__(self):
        self.rows = np.zeros((1 + 2 * CLASSES + PAIR_SLOTS, CLASSES), np.float64)

    @staticmethod
    def features(context: np.ndarray) -> list[np.ndarray]:
        """The weight rows that a context switches on."""
        return [
            np.zeros(len(context), np.int64),
            1 + context % CLASSES,
            1 + CLASSES + context // CLASSES,
            1 + 2 * CLASSES + _pair_slot(context),
        ]


def class_probabilities(rows: np.ndarray, context: np.ndarray) -> np.ndarray:
    scores = sum(rows[at].astype(np.float64) for at in Weights.features(context))
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    return scores / scores.sum(axis=1, keepdims=True)


def context_gradient(rows: np.ndarray, cell: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Observed minus expected, and expected counts, of each weight row touched by the cells."""
    context, back = np.unique(cell // CLASSES, return_inverse=True)
    seen = np.zeros((len(context), CLASSES))
    seen[back, cell % CLASSES] = n
    expected = class_probabilities(rows, context) * seen.sum(axis=1, keepdims=True)
    touched = []
    for at in Weights.features(context):
        each, group = np.unique(at, return_inverse=True)
        sums = np.zeros((len(each), 2, CLASSES))
        np.add.at(sums[:, 0], group, seen - expected)
        np.add.at(sums[:, 1], group, expected)
        touched += [(int(r), s.astype("<f4").tobytes()) for r, s in zip(each, sums, strict=True)]
    return touched


def context_counts(docs: DataFrame, alone: np.ndarray) -> DataFrame:
    """``cell, n``: how often each class follows each context. Cells are of fixed number."""

    def counted(batches):
        reader, classes = WordReader(), ClassReader(alone)
        sums = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for words in reader.read(batch, 0):
                _, context, token = classes.tokens(words)
                cell, n = np.unique(context * CLASSES + token, return_counts=True)
                sums[cell] += n
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(counted, "cell long, n long")
    return rows.groupBy("cell").agg(F.sum("n").alias("n"))


def train(counts: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weight rows fitted to the context counts, a table spread over tasks.

    Each round sends the weights out; the tasks' gradients are added up by weight row in Spark, so the
    driver gets one row each, whatever the number of tasks. A step divides the gradient by the expected count, the diagonal of the curvature. The
    biases start at the classes' shares.
    """
    spark = counts.sparkSession

    def added(batches):
        sums = {}
        for batch in batches:
            for row, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, "<f4")
                sums[row] = sums[row] + part if row in sums else part
        parts = [s.astype("<f4").tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(parts, pa.binary())], names=["row", "sums"]
        )

    weights = Weights().rows
    shares = np.ones(CLASSES)
    for token, n in counts.groupBy(F.col("cell") % CLASSES).agg(F.sum("n")).collect():
        shares[token] += n
    weights[0] = np.log(shares / shares.sum())
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights.astype(np.float32))

        def gradients(batches, sent=sent):
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if not parts:
                return
            cell, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            touched = context_gradient(sent.value, cell, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in touched]), pa.array([s for _, s in touched], pa.binary())],
                names=["row", "sums"],
            )

        total = np.zeros((len(weights), 2, CLASSES))
        touched = counts.mapInArrow(gradients, "row long, sums binary")
        with shuffles_dropped(spark):
            summed = touched.repartition(GRADIENT_TASKS, "row").mapInArrow(added, touched.schema).toArrow()
        for row, sums in zip(summed["row"].to_pylist(), summed["sums"].to_pylist(), strict=True):
            total[row] += np.frombuffer(sums, "<f4").reshape(2, CLASSES)
        step = (total[:, 0] - PRIOR * weights) / (total[:, 1] + SMOOTH)
        weights += STEP * np.clip(step, -2, 2)
        sent.unpersist()
    return weights


class Vocabulary:
    """The frequent words: hashes in order, counts, and the code (class and place) of each.

    ``code`` is negative where the class has one word only, so that nothing is left to predict.
    ``mass`` is a word's share of the frequent words of its class, by ``first[class] + place``.
    """

    def __init__(self, hashes: np.ndarray, n: np.ndarray, shared: np.ndarray, alone: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.n, shared = hashes[order], n[order], shared[order].astype(np.int64)
        inside = ~np.isin(self.hashes, np.append(alone, END_HASH).view(np.int64))
        self.code = np.full(len(self.hashes), -1, np.int64)
        sizes = np.bincount(shared[inside], minlength=SHARED)
        self.first = np.cumsum(sizes) - sizes
        by_class = np.flatnonzero(inside)[np.argsort(shared[inside], kind="stable")]
        own = shared[by_class]
        self.code[by_class] = (own << PLACE_BITS) + np.arange(len(own)) - self.first[own]
        smooth = self.n[by_class] + ADDED
        self.mass = smooth / np.bincount(own, smooth, SHARED)[own]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the hashes, and whether it is there."""
        hashed = words.hash.view(np.int64)
        if not len(self.hashes):
            return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return at, self.hashes[at] == hashed

    def pairs(self, words: Words, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs that can have a weight, and the number of each one's word."""
        before = np.full(len(words.hash), END_HASH)
        same = words.row[1:] == words.row[:-1]
        before[1:][same] = words.hash[:-1][same]
        here = np.flatnonzero(found)
        here = here[self.code[at[here]] >= 0]
        context = (before[here] >> np.uint64(CONTEXT_SHIFT)).astype(np.int64)
        return (context << (PLACE_BITS + 6)) | self.code[at[here]], here

    def masses(self, key: np.ndarray) -> np.ndarray:
        return self.mass[self.first[(key >> PLACE_BITS) % SHARED] + (key & ((1 << PLACE_BITS) - 1))]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` over equal keys, which stand together."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def fit_pairs(key: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Keys, counts, weights and logarithms of the normalisers of whole contexts, by sorted counts.

    Within a context and class, a word has the probability ``mass * exp(weight) / z``, where ``z`` is 1
    plus the sum of ``mass * (exp(weight) - 1)`` over the words with a weight. Each round moves the
    weights by the inverse curvature times their gradient. The curvature is a diagonal less the product
    of the probabilities with themselves, so its inverse needs two sums over the words.
    """
    group = key >> PLACE_BITS
    number = np.cumsum(np.append(False, group[1:] != group[:-1])[: len(key)])
    total = np.bincount(number, n)
    kept = n >= LEAST_PAIRS
    key, n, number = key[kept], n[kept], number[kept]
    mass, weight = vocabulary.masses(key), np.zeros(len(key))
    for done in range(PAIR_ROUNDS + 1):
        raised = mass * np.exp(weight)
        z = 1 + np.bincount(number, raised - mass, len(total))
        if done < PAIR_ROUNDS:
            expected = total[number] * raised / z[number]
            slope = (n - expected - PAIR_PRIOR * weight) / (expected + PAIR_PRIOR)
            turn = raised / z[number] / (expected + PAIR_PRIOR)
            along = np.bincount(number, expected * slope, len(total))
            across = 1 - np.bincount(number, expected * turn, len(total))
            weight += np.clip(slope + turn * (along / across)[number], -1, 1)
    return key, n, weight, np.log(z)[number]


def pair_weights(docs: DataFrame, vocabulary) -> DataFrame:
    """``key, n, group, weight, z`` of every pair of words in ``text`` that earned a weight.

    Counts go to their context and class, sorted, and are fitted there as they stream by; a task holds
    one context's words of one class, of the frequent words, and a bounded buffer. ``vocabulary`` is
    a broadcast ``Vocabulary``.
    """

    def counted(batches):
        reader, parts, held = WordReader(), [], 0

        def handed_on():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for words in reader.read(batch, 0):
                parts.append(vocabulary.value.pairs(words, *vocabulary.value.find(words))[0])
                held += len(parts[-1])
                if held >= PAIRS_HELD:
                    yield handed_on()
                    parts, held = [], 0
        if held:
            yield handed_on()

    def fitted(batches):
        keys, counts, held, least = [], [], 0, PAIRS_HELD

        def rows(key, n):
            key, n, weight, z = fit_pairs(key, n, vocabulary.value)
            group = mixed((key >> PLACE_BITS).view(np.uint64)).view(np.int64)
            columns = [key, n, group, weight.astype(np.float32), z.astype(np.float32)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["key", "n", "group", "weight", "z"]
            )

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            counts.append(batch.column(1).to_numpy())
            held += len(batch)
            if held < least:
                continue
            key, n = _summed(np.concatenate(keys), np.concatenate(counts))
            cut = np.searchsorted(key, key[-1] >> PLACE_BITS << PLACE_BITS)
            if cut:
                yield rows(key[:cut], n[:cut])
            keys, counts, held = [key[cut:]], [n[cut:]], len(key) - cut
            least = held + PAIRS_HELD
        if held:
            yield rows(*_summed(np.concatenate(keys), np.concatenate(counts)))

    counts = docs.select("text").mapInArrow(counted, "key long, n long")
    together = counts.repartition(F.shiftright("key", PLACE_BITS)).sortWithinPartitions("key")
    return together.mapInArrow(fitted, "key long, n long, group long, weight float, z float")


def pair_scores(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """``row, lift``: what a pair's weight adds to the natural log probability of its row.

    ``tokens`` holds ``row`` and ``key``. A context's weights come before its tokens, so a task holds
    those of one context and class at a time.
    """
    no = F.lit(None).cast("float")
    given = weights.select("key", F.lit(-1).cast("long").alias("row"), "weight", "z")
    both = given.unionByName(tokens.select("key", "row", no.alias("weight"), no.alias("z")))
    group = F.shiftright("key", PLACE_BITS)

    def lifted(batches):
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for batch in batches:
            if not len(batch):
                continue
            key, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = row < 0
            fresh = [key[new]] + [
                batch.column(c).to_numpy(zero_copy_only=False)[new].astype(float) for c in (2, 3)
            ]
            held = [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            order = np.argsort(held[0], kind="stable")
            known, weight, z = (x[order] for x in held)
            key, row = key[~new], row[~new]
            if len(known) and len(key):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                own = np.where(known[at] == key, weight[at], 0.0)
                start = np.searchsorted(known, key >> PLACE_BITS << PLACE_BITS)
                start = np.minimum(start, len(known) - 1)
                same = known[start] >> PLACE_BITS == key >> PLACE_BITS
                lift = own[same] - z[start[same]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[same]), pa.array(lift)], names=["row", "lift"]
                )
            last = batch.column(0)[len(batch) - 1].as_py() >> PLACE_BITS
            stays = known >> PLACE_BITS == last
            held = [known[stays], weight[stays], z[stays]]

    # One number to sort by: the context and class, weights before tokens.
    place = group * 2 + (F.col("row") >= 0).cast("long")
    together = both.repartition(group).sortWithinPartitions(place)
    return together.mapInArrow(lifted, "row long, lift double")



def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS):
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Null, empty and blank texts have one token, their end. Texts of any length are scored whole.
    Repeated rows each give a row; an empty table gives none. Other columns are not looked at.
    """
    spark = docs.sparkSession
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(F.col(doc_id)).alias("held_out"),
        F.col(text).alias("text"),
    )
    learnt = plain.filter(~F.col("held_out"))
    words = landed(word_counts(learnt), "lm-words", TEXT_ROWS)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own = words.filter(F.col("hash") != int(END_HASH.view(np.int64)))
    top = own.orderBy(F.desc("n"), "hash").limit(ALONE).collect()
    alone = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    class_n, class_v = np.zeros(CLASSES), np.ones(CLASSES)
    class_n[: len(top)] = [r["n"] for r in top]
    class_n[END] = learnt.count()
    by_class = own.groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    for row in by_class:
        mine = [r["n"] for r in top if r["shared"] == row["shared"]]
        class_n[ALONE + 1 + row["shared"]] = row["n"] - sum(mine)
        class_v[ALONE + 1 + row["shared"]] = row["v"] - len(mine)
    weights = train(landed(context_counts(learnt, alone), "lm-contexts", TEXT_ROWS), rounds)
    table = np.log10(class_probabilities(weights, np.arange(CLASSES**2)))
    table -= np.log10(class_n + ADDED * (class_v + 1))
    often, seldom = by_frequency(words, "n", FREQUENT)
    known = often.select("hash", "n", "shared").toArrow()
    frequent = (known[name].to_numpy() for name in ("hash", "n", "shared"))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(*frequent, alone))
    pairs = landed(pair_weights(learnt, vocabulary), "lm-pairs", TEXT_ROWS)
    mask = repeated_mask(pairs.select("group").distinct(), "group")
    usual, _ = by_frequency(pairs, "n", FREQUENT_PAIRS)
    usual = usual.select("key", (F.col("weight") - F.col("z")).alias("lift")).toArrow()
    order = np.argsort(usual["key"].to_numpy())
    usual = usual["key"].to_numpy()[order], usual["lift"].to_numpy()[order]
    sent = spark.sparkContext.broadcast((alone, table.astype(np.float32), mask, *usual))
    end_n = float(class_n[END])

    def scored(batches):
        alone, table, mask, usual, lifts = sent.value
        frequent = vocabulary.value
        reader, classes = WordReader(), ClassReader(alone)
        logs = np.log10(frequent.n + ADDED)
        for batch in batches:
            columns = [np.zeros(len(batch)) for _ in range(4)]
            rare, keys = [], []
            for words in reader.read(batch, 2):
                rows = slice(words.first, words.last)
                row, context, token = classes.tokens(words)
                model = np.bincount(row, table[context, token].astype(np.float64), words.rows)
                hashed = words.hash.view(np.int64)
                at, found = frequent.find(words)
                base = np.bincount(words.row[found], logs[at[found]], words.rows)
                columns[0][rows] = words.counts() + 1
                columns[1][rows] = np.bincount(words.row[found], minlength=words.rows) + (end_n > 0)
                columns[2][rows] = base + np.log10(end_n + ADDED)
                columns[3][rows] = model
                cuts = np.searchsorted(words.row[~found], np.arange(words.rows + 1))
                values = pa.array(hashed[~found])
                rare.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values))
                key, here = frequent.pairs(words, at, found)
                if len(usual):
                    at = np.minimum(np.searchsorted(usual, key), len(usual) - 1)
                    same = usual[at] == key
                    lift = np.bincount(words.row[here[same]], lifts[at[same]], words.rows)
                    columns[3][rows] += lift / np.log(10)
                    key, here = key[~same], here[~same]
                bit = mixed((key >> PLACE_BITS).view(np.uint64)) & np.uint64(8 * len(mask) - 1)
                set_ = mask[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)
                own = (set_ & 1).astype(bool)
                cuts = np.searchsorted(words.row[here[own]], np.arange(words.rows + 1))
                keys.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(key[own])))
            if not len(batch):
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(columns[0].astype(np.int64)),
                    pa.array(columns[1].astype(np.int64)),
                    pa.array(columns[2]),
                    pa.array(columns[3]),
                    pa.concat_arrays(rare),
                    pa.concat_arrays(keys),
                ],
                names=["doc_id", "held_out", "tokens", "known", "base", "model", "rare", "pairs"],
            )

    first = landed(
        plain.mapInArrow(
            scored,
            "doc_id long, held_out boolean, tokens long, known long, base double, model double,"
            "rare array<long>, pairs array<long>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "lm-frequent",
        TEXT_ROWS,
    )
    uncommon = (
        first.select("row", F.explode("rare").alias("hash"))
        .join(seldom.select("hash", "n"), "hash", "left")
        .select("row", F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED)).alias("rest"), "n")
    )
    lifts = pair_scores(first.select("row", F.explode("pairs").alias("key")), pairs)
    rest = (
        uncommon.unionByName(lifts, allowMissingColumns=True)
        .groupBy("row")
        .agg(F.sum("rest").alias("rest"), F.count("n").alias("more"), F.sum("lift").alias("lift"))
    )
    logs = F.col("base") + F.coalesce("rest", F.lit(0.0))
    denominator = float(np.log10(total + ADDED * (distinct + 1)))
    return first.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("tokens") * F.lit(denominator)).alias("base_score"),
        (logs + F.col("model") + F.coalesce("lift", F.lit(0.0)) / F.lit(float(np.log(10)))).alias("score"),
    )
