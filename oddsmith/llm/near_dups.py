"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

A text's set holds its distinct word shingles. One permutation scatters the shingles over the
positions of a circle, a second one, shifted round the circle by k places, gives coordinate k of the
signature: two permutations make all coordinates. Texts with equal sets are one class. Classes that
agree in a band of coordinates are candidates; a pair is a link only if its whole sets say so.

No bucket is expanded into all its pairs. Every member is first compared with its bucket's hubs, the
few members that stand in the largest buckets. Members that the links found so far already connect
need no comparison with each other; what is left, members outside the main component against members
of other components, is compared block by block: a product of two matrices counts all common
shingles of two blocks, and only the links that join components leave the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm._links import components
from oddsmith.llm._shared import TEXT_ROWS, bit_mask, free_names, join_groups, landed
from oddsmith.llm._words import Words, WordReader, mixed

WORDS, SIMILARITY = 5, 0.8
ROWS = 5
# Chance that no band of two sets of just the wanted similarity agrees, and the standard deviations
# by which a signature may fall short of it before its pair is left out.
MISS, DEVIATIONS = 1e-5, 7
HUBS, BLOCK = 8, 256
MASK_BITS = 23
# Rows of whole sets that are handed to Python at once, and columns of a block's matrix.
SET_ROWS, COLUMNS = 512, 1 << 16
_CHUNK = 1 << 12
_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1) for k in range(16)]
_SHORT = np.uint64(0x5851F42D4C957F2D)


class Signer:
    """Shingle sets, signatures and band keys for one similarity."""

    def __init__(self, words: int, percent: int):
        wanted = percent / 100
        self.words = words
        self.bands = max(1, math.ceil(math.log(MISS) / math.log(1 - min(wanted, 0.999) ** ROWS)))
        self.size = self.bands * ROWS
        spread = math.sqrt(self.size * wanted * (1 - wanted))
        self.agreeing = max(0, math.floor(self.size * wanted - DEVIATIONS * spread))
        self.reader = WordReader()
        self._shifts = np.arange(self.size, dtype=np.uint32)

    def sets(self, words: Words) -> list[np.ndarray]:
        """The sorted distinct shingles of each text; of a shorter text its whole sequence."""
        n, counts = self.words, words.counts()
        cuts = np.concatenate([[0], np.cumsum(counts)])
        with np.errstate(over="ignore"):
            total = np.zeros(max(0, len(words.hash) - n + 1), np.uint64)
            for k in range(n):
                total += words.hash[k : k + len(total)] * _FACTORS[k]
            shingles = mixed(total)
            found = []
            for row in range(words.rows):
                low, high = cuts[row], cuts[row + 1]
                if high - low >= n:
                    found.append(np.unique(shingles[low : high - n + 1]))
                elif high > low:
                    whole = sum(
                        (h * f for h, f in zip(words.hash[low:high], _FACTORS, strict=False)), _SHORT
                    )
                    found.append(mixed(np.array([whole + np.uint64(high - low)], np.uint64)))
                else:
                    found.append(np.zeros(0, np.uint64))
        return found

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinate k is the least second permutation of the positions shifted by k."""
        least = np.full(self.size, 0xFFFFFFFF, np.uint32)
        positions = (shingles >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(positions), _CHUNK):
            x = positions[start : start + _CHUNK, None] + self._shifts
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(16)
            np.minimum(least, x.min(axis=0), out=least)
        return least

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k, column in enumerate(signature.reshape(self.bands, ROWS).T):
                total += mixed(column.astype(np.uint64) + np.uint64(k << 32))
                total = mixed(total)
        return total.view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share; none for an empty set."""
    if not len(shingles):
        return b""
    with np.errstate(over="ignore"):
        other = mixed(shingles ^ np.uint64(0xA24BAED4963EE407))
        return shingles.sum(dtype=np.uint64).tobytes() + other.sum(dtype=np.uint64).tobytes()


def _plain(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")


def signatures(docs: DataFrame, signer: tuple[int, int], text: str, doc_id: str) -> DataFrame:
    """``doc_id, content, key, n, bands, signature`` of every row; ``signature`` a byte a coordinate."""
    words, percent = signer

    def rows(batches):
        signer = Signer(words, percent)
        for batch in batches:
            for piece in signer.reader.read(batch, 2):
                keys, sizes, bands, signs = [], [], [], []
                for shingles in signer.sets(piece):
                    keys.append(set_digest(shingles))
                    sizes.append(len(shingles))
                    if len(shingles):
                        signature = signer.signature(shingles)
                        bands.append(signer.band_keys(signature))
                        signs.append((signature & np.uint32(0xFF)).astype(np.uint8).tobytes())
                    else:
                        bands.append(np.zeros(0, np.int64))
                        signs.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, piece.rows),
                        batch.column(1).slice(piece.first, piece.rows),
                        pa.array(keys, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(signs, pa.binary()),
                    ],
                    names=["doc_id", "content", "key", "n", "bands", "signature"],
                )

    content = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    return (
        _plain(docs, text, doc_id)
        .select("doc_id", content.alias("content"), "text")
        .mapInArrow(
            rows,
            "doc_id long, content binary, key binary, n long, bands array<long>, signature binary",
        )
    )


def _sets_of(docs: DataFrame, wanted: DataFrame, signer, text: str, doc_id: str) -> DataFrame:
    """``key, shingles`` of the classes in ``wanted`` (``key, id``), from the texts once more.

    A mask of fixed size over the classes' ids tells the tasks which texts to read; what passes by
    chance is dropped by the join.
    """
    words, percent = signer
    size = 1 << MASK_BITS
    spark = docs.sparkSession
    bit = F.expr(f"cast(xxhash64(id) & {size - 1}L as int)")
    marked = wanted.filter("id is not null").select(bit.alias("bit"))
    sent = spark.sparkContext.broadcast(bit_mask(marked, size))

    def read(batches):
        signer, chosen = Signer(words, percent), np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            bits = batch.column(0).fill_null(-1).to_numpy()
            take = (bits < 0) | chosen[np.maximum(bits, 0)]
            part = batch.filter(pa.array(take))
            for piece in signer.reader.read(part, 1):
                sets = signer.sets(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_digest(s) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["key", "shingles"],
                )

    masked = _plain(docs, text, doc_id).selectExpr(
        f"case when doc_id is not null then cast(xxhash64(doc_id) & {size - 1}L as int) end bit", "text"
    )
    found = masked.mapInArrow(read, "key binary, shingles binary")
    once = found.groupBy("key").agg(F.first("shingles").alias("shingles"))
    return once.join(wanted.select("key"), "key", "left_semi")


def _whole_sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, signer, text, doc_id):
    wanted = landed(keys.distinct().join(classes.select("key", "id"), "key"), "near-wanted")
    return landed(_sets_of(docs, wanted, signer, text, doc_id), "near-sets", TEXT_ROWS)


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, signer, text, doc_id):
    """Pairs ``a, b`` whose whole sets reach the similarity."""
    percent = signer[1]
    pairs = landed(pairs, "near-pairs")
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    sets = _whole_sets(docs, ends, classes, signer, text, doc_id)

    def exact(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b")), "b")
    joined = joined.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a")), "a")
    chosen = joined.select("a", "b", "of_a", "of_b")
    return landed(chosen.mapInArrow(exact, "a binary, b binary"), "near-links", SET_ROWS)


def _alike(pairs: DataFrame, classes: DataFrame, signer) -> DataFrame:
    """Pairs whose sizes and signatures allow the similarity."""
    words, percent = signer
    sides = [
        classes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"sign_{s}"))
        for s in ("a", "b")
    ]
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    joined = pairs.join(sides[1], "b").join(sides[0], "a").filter(fits)

    def agreeing(batches):
        least, size = Signer(words, percent).agreeing, Signer(words, percent).size
        for batch in batches:
            if not len(batch):
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, size)
                for k in (2, 3)
            )
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(keep)

    return joined.select("a", "b", "sign_a", "sign_b").mapInArrow(agreeing, "a binary, b binary")


def _rest(docs, members, hubs, classes, linked, signer, text, doc_id) -> DataFrame:
    """Links between components that the comparison with hubs has left open.

    Members outside the main component, that of the first hub, meet all members of other components.
    Both sides of a large bucket are dealt into blocks, and every pair of blocks is one comparison.
    """
    percent = signer[1]
    part_of = linked.select(F.col("node").alias("key"), "component")
    first = hubs.filter("place = 1").join(
        part_of.select(F.col("key").alias("hub"), F.col("component").alias("main")), "hub", "left"
    )
    first = first.select("band", F.coalesce("main", "hub").alias("main"))
    others = members.join(hubs.select("band", F.col("hub").alias("key")), ["band", "key"], "left_anti")
    placed = others.join(part_of, "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    outside = (F.col("component") != F.col("main")).alias("outside")
    placed = landed(
        placed.join(first, "band").select("band", "key", "component", outside), "near-placed"
    )
    sizes = placed.groupBy("band").agg(
        F.count_if("outside").alias("outer"),
        F.count("*").alias("every"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    open_ = sizes.filter("outer > 0 and every > 1 and low <> high").select(
        "band",
        F.ceil(F.col("outer") / BLOCK).cast("int").alias("left"),
        F.ceil(F.col("every") / BLOCK).cast("int").alias("right"),
    )
    dealt = landed(placed.join(landed(open_, "near-open"), "band"), "near-dealt")
    sets = _whole_sets(docs, dealt.select("key"), classes, signer, text, doc_id)
    place = F.shiftrightunsigned(F.xxhash64("key", "band"), 8)
    one, other = (place % F.col("left")).cast("int"), (place % F.col("right")).cast("int")
    inner = dealt.select(
        "band", "key", "component", F.lit(False).alias("first"),
        F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"), other.alias("j"),
    )
    outer = dealt.filter("outside").select(
        "band", "key", "component", F.lit(True).alias("first"), one.alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("j"),
    )
    rows = outer.unionByName(inner).join(sets, "key")
    blocks = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def compared(batches):
        for group in _groups(batches):
            found = _block_links(group, percent)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]
                )

    order = ["band", "i", "j", "key", "component", "first", "shingles"]
    found = blocks.select(*order).mapInArrow(compared, "a binary, b binary")
    return landed(found, "near-rest", SET_ROWS)


def _groups(batches):
    """Runs of rows that agree in the first three columns, across batches."""
    kept = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        marks = np.stack([table.column(k).to_numpy() for k in range(3)])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        start = 0
        for cut in cuts:
            yield table.slice(start, cut - start)
            start = cut
        kept = table.slice(start)
    if kept is not None:
        yield kept


def _block_links(group: pa.Table, percent: int) -> list[tuple[bytes, bytes]]:
    """Links of one pair of blocks, as many as join their components."""
    first = group.column(5).to_numpy()
    if first.all() or not first.any():
        return []
    keys, parts = group.column(3).to_pylist(), group.column(4).to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in group.column(6).to_pylist()]
    sizes = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at)[at] > 1  # a shingle of one member is common to none
    _, at = np.unique(at[shared], return_inverse=True)
    member = member[shared]
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, (low, low + COLUMNS))
        matrix = np.zeros((len(sets), min(COLUMNS, int(at[-1]) + 1 - low)), np.float32)
        matrix[member[a:b], at[a:b] - low] = 1
        both += matrix[left] @ matrix[right].T
    whole = sizes[left][:, None] + sizes[right] - both
    codes = {c: k for k, c in enumerate(dict.fromkeys(parts))}
    part = np.array([codes[c] for c in parts])
    good = (100 * both >= percent * whole) & (part[left][:, None] != part[right])
    above = list(range(len(codes)))
    found = []
    for x, y in zip(*np.nonzero(good), strict=True):
        u, v = part[left[x]], part[right[y]]
        while above[u] != u:
            above[u] = u = above[above[u]]
        while above[v] != v:
            above[v] = v = above[above[v]]
        if u != v:
            above[u] = v
            found.append((keys[left[x]], keys[right[y]]))
    return found


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = round(SIMILARITY * 100),
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, content, n_shingles, component_id, kept`` of every row; ``content`` is the text's MD5.

    Two texts are linked if 100 times their common shingles reach ``percent`` times all their
    shingles. A component carries its least id. Null, empty and blank texts are linked with nothing,
    not even with each other, and kept. Texts with fewer words than a shingle have one, the whole
    sequence. Repeated rows are linked as equal texts. A null id is never a component's id unless all
    ids are null, and its row is not kept. An empty table gives no rows; other columns are not
    looked at.
    """
    signer = (words, percent)
    signed = landed(signatures(docs, signer, text, doc_id), "near-signatures", TEXT_ROWS)
    classes = landed(
        signed.filter("n > 0")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        ),
        "near-classes",
    )
    spread = classes.select(F.explode("bands").alias("band"), "key")
    buckets = landed(
        spread.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "near-buckets"
    )
    members = landed(spread.join(buckets, "band"), "near-members")
    standing = members.groupBy("key").agg(F.sum("size").alias("standing"))
    best = Window.partitionBy("band").orderBy(F.desc("standing"), "key")
    hubs = landed(
        members.join(standing, "key")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= HUBS)
        .select("band", "place", F.col("key").alias("hub")),
        "near-hubs",
    )
    members = members.drop("size")
    pairs = members.join(hubs, "band").filter("key <> hub")
    pairs = pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    links = _verified(docs, _alike(pairs, classes, signer), classes, signer, text, doc_id)
    linked = landed(components(links), "near-linked")
    more = _rest(docs, members, hubs, classes, linked, signer, text, doc_id)
    if not more.isEmpty():
        linked = landed(components(links.unionByName(more)), "near-linked")
    whole = classes.select("key", "id", "copies").join(
        linked.select(F.col("node").alias("key"), "component"), "key", "left"
    )
    whole = landed(whole.withColumn("component", F.coalesce("component", "key")), "near-whole")
    least = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    groups = landed(whole.join(least, "component").select("key", "copies", "component_id"), "near-groups")
    rows = signed.select("doc_id", "content", "key", F.col("n").alias("n_shingles"))
    grouped = join_groups(rows.filter("n_shingles > 0"), groups, "key", "copies").drop("copies")
    alone = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return grouped.unionByName(alone).select(
        "doc_id",
        "content",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, percent: int = round(SIMILARITY * 100)
) -> DataFrame:
    """Rows of ``docs`` that stay, one document of each component, with their columns.

    The document with the least id stays. Rows alike in id and text stay together; rows whose id is
    null go only if their text is linked to a row with an id.
    """
    report = near_duplicates(docs, words, percent)
    gone = report.filter(~F.col("kept") & F.col("component_id").isNotNull())
    of_id, of_text = free_names(docs, "gone_id", "gone_text")
    gone = gone.select(F.col("doc_id").alias(of_id), F.col("content").alias(of_text)).distinct()
    content = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (content == F.col(of_text))
    return docs.join(landed(gone, "near-gone"), same, "left_anti")
