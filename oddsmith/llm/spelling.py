"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One inserted, deleted or replaced letter changes the letter counts by at most two in total: a
replacement takes one letter away and adds another, an insertion adds one. Words of each length lie
in a k-d tree over their counts; every word searches the tree of its own length and that of one
letter more, and leaves out each box that is further off than the edit reaches. Words met in a box
are verified letter by letter.

The upper levels of the trees are made from a bounded sample and decide which task gets a word: a
box with its words, and copies of the words that search it. Inside a task the words of a box get a
tree of their own. Every pair is met in one box only, so the boxes' figures are added up by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import join_groups, landed

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT = 7, 2
# A word's near word is its form if it is so many times as frequent.
MORE_FREQUENT = 10
SPOILT = 31
# Words that the upper trees are made of, at most, and the words that a box of theirs should hold.
SAMPLE, BOX = 1 << 17, 4096
# Words of a box that one task holds; a larger box is dealt over several.
PART = 1 << 16
# Words of a box in a task's own tree that are compared all at once, and pairs looked at together.
FEW, PAIRS = 48, 1 << 20
LETTERS = 26 + 64
# What a word searches: a box of its length, one of a letter more, its own box.
_SAME, _LONGER, _OWN = 0, 1, 2


def spelled_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: words of at least seven letters that occur at least twice, with their counts.

    Words are maximal runs of letters with A-Z lower-cased; an occurrence whose checksum with the id
    is divisible by 31 loses one letter. A null text has no words; a null id counts as empty.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"({RUN}{{{LEAST_LETTERS},}})"), 1)
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), runs.alias("runs"))
    each = named.select("id", F.explode("runs").alias("run")).select("id", low.alias("run"))
    checked = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("sum"))
    at = F.pmod("sum", F.length("run")).cast("int")
    shorter = F.concat(F.expr("left(run, `at`)"), F.expr("substring(run, `at` + 2)"))
    word = F.when(F.col("sum") % SPOILT == 0, shorter).otherwise(F.col("run"))
    counted = checked.withColumn("at", at).select(word.alias("word")).groupBy("word")
    return counted.agg(F.count("*").alias("n")).filter(
        (F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT)
    )


# -- words as arrays ----------------------------------------------------------------------------


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, one byte each, and the places where the words begin and end."""
    words = words.cast(pa.large_string())
    _, places, data = words.buffers()
    places = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[places[0] : places[-1]]
    # letters above z take two bytes, of which the first is always the same
    kept = raw != 0xC3
    letters = raw[kept].copy()
    letters[letters >= 0x80] += 0x40
    place = np.concatenate([[0], np.cumsum(kept)])
    return letters, place[places - places[0]]


def matrix_of(letters: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The letters of words of one length, a row each."""
    return letters[start[:, None] + np.arange(length)]


def counts_of(matrix: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row, up to 255, which keeps the distances too short."""
    which = np.where(matrix >= 0xC0, matrix.astype(np.int64) - 0xC0 + 26, matrix.astype(np.int64) - 0x61)
    flat = (np.arange(len(matrix))[:, None] * LETTERS + which).ravel()
    found = np.bincount(flat, minlength=len(matrix) * LETTERS).reshape(-1, LETTERS)
    return np.minimum(found, 255).astype(np.uint8)


# -- trees --------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A k-d tree: inner nodes split a letter's count at a threshold, leaves have numbers."""

    letter: list[int] = field(default_factory=list)
    threshold: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def over(counts: np.ndarray, most: int) -> tuple[Tree, list[np.ndarray]]:
        """A tree whose leaves hold ``most`` rows or equal ones, and the rows of each leaf."""
        tree, held = Tree(), []

        def grow(rows: np.ndarray) -> int:
            node = len(tree.letter)
            for column in (tree.letter, tree.threshold, tree.low, tree.high):
                column.append(-1)
            mine = counts[rows]
            if len(rows) > most and len(rows):
                spread = mine.std(axis=0)
                letter = int(spread.argmax())
                if spread[letter] > 0:
                    values = mine[:, letter]
                    at = min(int(np.median(values)), int(values.max()) - 1)
                    tree.letter[node], tree.threshold[node] = letter, at
                    tree.low[node] = grow(rows[values <= at])
                    tree.high[node] = grow(rows[values > at])
                    return node
            tree.low[node] = tree.leaves
            tree.leaves += 1
            held.append(rows)
            return node

        grow(np.arange(len(counts)))
        return tree, held

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        found = np.zeros(len(counts), np.int64)
        for leaf, rows in self.search(counts, 0, 0):
            found[rows] = leaf
        return found

    def search(self, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the rows of ``counts`` that a point of its box may be near to.

        Such a point has at most ``more`` letters that the row lacks, and lacks at most ``less``.
        The distance to a box is added up letter by letter on the way down.
        """
        start = np.zeros(len(counts), np.int16)
        todo = [(0, np.arange(len(counts)), start, start, {}, {})]
        while todo:
            node, rows, up, down, floors, tops = todo.pop()
            if not len(rows):
                continue
            letter = self.letter[node]
            if letter < 0:
                yield self.low[node], rows
                continue
            at = self.threshold[node]
            mine = counts[rows, letter].astype(np.int16)
            top = tops.get(letter, 255)
            further = np.maximum(mine - at, 0) - np.maximum(mine - top, 0)
            near = down + further <= less
            todo.append(
                (self.low[node], rows[near], up[near], (down + further)[near], floors, {**tops, letter: at})
            )
            floor = floors.get(letter, 0)
            further = np.maximum(at + 1 - mine, 0) - np.maximum(floor - mine, 0)
            near = up + further <= more
            todo.append(
                (self.high[node], rows[near], (up + further)[near], down[near], {**floors, letter: at + 1}, tops)
            )


def upper_trees(words: DataFrame, sample: int = SAMPLE, box: int = BOX) -> dict[int, Tree]:
    """A tree for each length of the words of ``words``, made of at most ``sample`` of them.

    The sample, chosen by a hash, only settles where boxes are cut; every word is in one.
    """
    total = words.count()
    share = min(1.0, sample / max(total, 1))
    rank = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    chosen = words.filter(rank < int(share * (1 << 30))).select("word").limit(2 * sample)
    lengths = words.select(F.length("word").alias("length")).distinct().toArrow()
    drawn = pa.concat_arrays([pa.array([], pa.string()), *chosen.toArrow().column("word").chunks])
    letters, place = letters_of(drawn)
    size = np.diff(place)
    trees = {}
    for length in lengths.column("length").to_pylist():
        start = place[:-1][size == length]
        counts = counts_of(matrix_of(letters, start, length))
        trees[length] = Tree.over(counts, max(1, int(box * share)))[0]
    return trees


# -- verification -------------------------------------------------------------------------------


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` become those of ``b`` by one edit; ``b`` is as long or one longer."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    front = np.cumprod(a == b[:, :length], axis=1).sum(axis=1)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= length


def _all_pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two letter-parity masks that differ in at most two letters."""
    step = max(1, PAIRS // max(len(b), 1))
    for first in range(0, len(a), step):
        apart = np.bitwise_count(a[first : first + step, None] ^ b[None, :])
        x, y = np.nonzero(apart <= 2)
        yield x + first, y


def _equal_halves(
    a: np.ndarray, b: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words that agree before the middle, and those that agree only behind it.

    One edit leaves one half as it is: the letters before the middle, or those from it on, where a
    longer word is read from one letter later.
    """
    half = a.shape[1] // 2
    longer = b.shape[1] - a.shape[1]
    for first in (True, False):
        x, y = (a[:, :half], b[:, :half]) if first else (a[:, half:], b[:, half + longer :])
        kind = np.dtype((np.void, x.shape[1]))
        _, back = np.unique(
            np.concatenate([np.ascontiguousarray(x), np.ascontiguousarray(y)]).view(kind).ravel(),
            return_inverse=True,
        )
        key, other = back[: len(x)], back[len(x) :]
        order = np.argsort(other, kind="stable")
        low = np.searchsorted(other[order], key, "left")
        n = np.searchsorted(other[order], key, "right") - low
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            rows = np.repeat(np.arange(at, stop), n[at:stop])
            inside = np.arange(len(rows)) - np.repeat(ends[at:stop] - n[at:stop], n[at:stop]) + (
                ends[at - 1] if at else 0
            )
            columns = order[np.repeat(low[at:stop], n[at:stop]) + inside]
            if not first:
                fresh = (a[rows, :half] != b[columns, :half]).any(axis=1)
                rows, columns = rows[fresh], columns[fresh]
            yield rows, columns
            at = stop


class Box:
    """The words of a box in a task, with a tree of their own, and what is found about them."""

    def __init__(self, words: pa.Array, n: np.ndarray, length: int):
        self.words, self.n, self.length = words, n, length
        letters, place = letters_of(words)
        self.matrix = matrix_of(letters, place[:-1], length)
        self.counts = counts_of(self.matrix)
        self.parity = parities(self.counts)
        self.tree, self.held = Tree.over(self.counts, FEW)

    def near(self, words: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (searching word, word of the box) that are one edit apart."""
        letters, place = letters_of(words)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for longer, less in ((0, 1), (1, 0)):
            mine = np.flatnonzero((kind == _LONGER) == bool(longer))
            matrix = matrix_of(letters, place[mine], self.length - longer)
            counts = counts_of(matrix)
            parity = parities(counts)
            for leaf, rows in self.tree.search(counts, 1, less):
                held = self.held[leaf]
                pairs = (
                    _all_pairs(parity[rows], self.parity[held])
                    if len(held) <= 4 * FEW
                    else _equal_halves(matrix[rows], self.matrix[held])
                )
                for x, y in pairs:
                    a, b = rows[x], held[y]
                    true = one_edit(matrix[a], self.matrix[b])
                    found.append((mine[a[true]], b[true]))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def parities(counts: np.ndarray) -> np.ndarray:
    """A bit for each letter, odd or even; letters 64 apart share a bit."""
    odd = (counts & 1).astype(np.uint64)
    bits = np.uint64(1) << (np.arange(LETTERS) % 64).astype(np.uint64)
    return np.bitwise_xor.reduce(odd * bits, axis=1) if len(counts) else np.zeros(0, np.uint64)


# -- the job ------------------------------------------------------------------------------------


def _routed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``length, box, kind, word, n``: each word in its box (kind below 0) and in those it searches.

    Of two boxes of one length the later is searched from the earlier.
    """
    sent = words.sparkSession.sparkContext.broadcast(trees)

    def routed(batches):
        for batch in batches:
            letters, place = letters_of(batch.column(0))
            size = np.diff(place)
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                counts = counts_of(matrix_of(letters, place[rows], length))
                tree = sent.value[int(length)]
                home = tree.home(counts)
                everything = np.arange(len(rows))
                visits = [(length, home, everything, -1), (length, home, everything, _OWN)]
                for box, near in tree.search(counts, 1, 1):
                    near = near[home[near] < box]
                    visits.append((length, np.full(len(near), box), near, _SAME))
                if int(length) + 1 in sent.value:
                    for box, near in sent.value[int(length) + 1].search(counts, 1, 0):
                        visits.append((length + 1, np.full(len(near), box), near, _LONGER))
                for of, box, near, kind in visits:
                    if not len(near):
                        continue
                    taken = pa.array(rows[near])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(near), of, np.int32)),
                            pa.array(box.astype(np.int64)),
                            pa.array(np.full(len(near), kind, np.int32)),
                            batch.column(0).take(taken),
                            batch.column(1).take(taken),
                        ],
                        names=["length", "box", "kind", "word", "n"],
                    )

    return words.select("word", "n").mapInArrow(
        routed, "length int, box long, kind int, word string, n long"
    )


def _figures(
    box: Box, words: pa.Array, n: np.ndarray, kind: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """How many near words each word has by this search, and the most frequent of them."""
    asking, met = box.near(words, kind)
    # two words of the box find each other from either side; all others are told both ways here
    back = kind[asking] != _OWN
    word = np.concatenate([asking, met[back] + len(words)])
    other = np.concatenate([met + len(words), asking[back]])
    names = pa.concat_arrays([words.cast(pa.string()), box.words.cast(pa.string())])
    count = np.concatenate([n, box.n])
    if not len(word):
        return
    order = np.lexsort([-count[other], word])
    word, other = word[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    number = np.diff(np.append(first, len(word)))
    # of equally frequent ones the first in code-point order is wanted
    top = np.repeat(count[other[first]], number) == count[other]
    group = np.repeat(np.arange(len(first)), number)[top]
    texts = np.array(names.take(pa.array(other[top])).to_pylist(), object)
    best: list = [None] * len(first)
    for g, text in zip(group, texts, strict=True):
        if best[g] is None or text < best[g]:
            best[g] = text
    yield pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(word[first])),
            pa.array(number.astype(np.int64)),
            pa.array(-count[other[first]].astype(np.int64)),
            pa.array(best, pa.string()),
        ],
        names=["word", "n_near", "less", "best"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of the words that have a near word; ``words`` is landed.

    ``best`` is the most frequent near word, of equally frequent ones the first in code-point order.
    """
    routed = landed(_routed(words, upper_trees(words)), "spelling-boxes")
    held = routed.filter("kind < 0").groupBy("length", "box").agg(F.count("*").alias("held"))
    large = held.filter(F.col("held") > PART)
    parts = F.broadcast(large.select("length", "box", F.ceil(F.col("held") / PART).cast("int").alias("parts")))
    dealt = routed.join(parts, ["length", "box"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.array(F.pmod(F.xxhash64("word"), "parts").cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("kind") < 0, mine).otherwise(everywhere)))

    def searched(batches):
        key, held, box = None, [], None
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(4)]
            cell = np.stack(columns[:3])
            new = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *new], [*new, len(batch)], strict=True):
                here = tuple(int(c[a]) for c in columns[:3])
                if here != key:
                    key, held, box = here, [], None
                own = a + int(np.searchsorted(columns[3][a:b], 0))
                if own > a:
                    held.append(batch.slice(a, own - a))
                if own == b or not held:
                    continue
                if box is None:
                    of_box = pa.Table.from_batches(held).combine_chunks()
                    box = Box(
                        of_box.column("word").chunk(0), of_box.column("n").to_numpy(), here[0]
                    )
                asking = batch.slice(own, b - own)
                yield from _figures(
                    box, asking.column(4), asking.column(5).to_numpy(), columns[3][own:b]
                )

    cells = dealt.select("length", "box", "part", "kind", "word", "n")
    found = (
        cells.repartition("length", "box", "part")
        .sortWithinPartitions("length", "box", "part", "kind")
        .mapInArrow(searched, "word string, n_near long, less long, best string")
    )
    totals = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("top")
    )
    return totals.select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``form, root, uses``: where the forms that are words' forms lead to, and how often one is.

    ``forms`` holds ``word, form``. A form is at least ten times as frequent as its word, so the chains are
    short and have no circle; each round doubles the steps that a form is followed.
    """
    used = forms.groupBy("form").agg(F.count("*").alias("uses"))
    own = forms.select(F.col("word").alias("form"), F.col("form").alias("root"))
    steps = landed(
        used.join(own, "form", "left").withColumn("root", F.coalesce("root", "form")), "spelling-steps"
    )
    while True:
        onward = steps.filter("root <> form").select(F.col("form").alias("root"), F.col("root").alias("onward"))
        further = steps.join(onward, "root", "left")
        if further.filter("onward is not null").isEmpty():
            return steps
        steps = landed(
            further.select("form", F.coalesce("onward", "root").alias("root"), "uses"), "spelling-steps"
        )


def variants(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of words with their counts ``word, n``.

    A word's form is its most frequent near word, if that is ten times as frequent; its root is the end
    of the forms that follow from it, the word itself if it has no form. Words are distinct and hold
    letters a-z and those from U+00C0 to U+00FF. No words give no rows.
    """
    words = landed(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    near = landed(near_words(words), "spelling-near")
    known = words.join(near, "word", "left")
    often = F.col("best_n") >= F.col("n") * MORE_FREQUENT
    formed = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best")).alias("form"),
        F.when(often, F.col("best_n")).alias("form_n"),
    )
    formed = landed(formed, "spelling-forms")
    with_form = formed.filter("form is not null")
    roots = landed(_roots(with_form.select("word", "form")), "spelling-roots")
    rooted = join_groups(with_form, roots, "form", "uses")
    alone = formed.filter("form is null").withColumn("root", F.col("word"))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return rooted.select(*columns).unionByName(alone.select(*columns))


def spelling_report(docs: DataFrame) -> DataFrame:
    """The variants among the words of all documents."""
    return variants(spelled_words(docs))
