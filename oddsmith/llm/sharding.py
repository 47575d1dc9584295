"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form an indivisible group. Groups, largest first, enter the shard with the
tightest remaining capacity that still holds them; a balanced tree keeps the remaining capacities.
Groups of one size are interchangeable, so the packing runs over the histogram of sizes, whose
length is bounded, and each run of equal groups enters a shard in one step. Spark finds the groups,
the histogram, every group's place among its equals, and the slots.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import join_groups, landed, order_key, running, spread_key

SHARDS = 24
ROW_BYTES = 8
# Sizes below this are exact; larger ones are rounded up to 1/1024 of themselves, so that there are
# at most 65,536 + 1,024 per doubling of the size: under 120,000 for any group below 2**63 bytes.
EXACT_SIZES = 1 << 16
STEPS_PER_DOUBLING = 1 << 10
_LEAF = 256


class CapacityTree:
    """Remaining capacities in order: a B-tree of two levels whose leaves split when full."""

    def __init__(self, items: list[tuple[int, int]]):
        ordered = sorted(items)
        half = _LEAF // 2
        self._leaves = [ordered[i : i + half] for i in range(0, len(ordered), half)] or [[]]
        self._tops = [leaf[-1] if leaf else (0, -1) for leaf in self._leaves]

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the smallest remaining capacity of at least ``size``; ties by shard number."""
        at = bisect_left(self._tops, (size, -1))
        if at == len(self._leaves) or not self._leaves[at]:
            return None
        leaf = self._leaves[at]
        item = leaf.pop(bisect_left(leaf, (size, -1)))
        self._keep(at)
        return item

    def add(self, remaining: int, shard: int) -> None:
        at = min(bisect_left(self._tops, (remaining, shard)), len(self._leaves) - 1)
        leaf = self._leaves[at]
        insort(leaf, (remaining, shard))
        if len(leaf) > _LEAF:
            self._leaves[at : at + 1] = [leaf[: _LEAF // 2], leaf[_LEAF // 2 :]]
            self._tops.insert(at, leaf[_LEAF // 2 - 1])
            at += 1
        self._keep(at)

    def _keep(self, at: int) -> None:
        if self._leaves[at]:
            self._tops[at] = self._leaves[at][-1]
        elif len(self._leaves) > 1:
            del self._leaves[at], self._tops[at]
        else:
            self._tops[at] = (0, -1)


Run = tuple[int, int, int, int]  # size, first place among the groups of this size, shard, groups


def best_fit_decreasing(
    histogram: list[tuple[int, int]], capacity: int, shards: int | None = None
) -> list[Run] | None:
    """Pack ``(size, groups)`` pairs into shards of one capacity.

    Without ``shards``, a new shard is opened whenever no open one holds a group, and a group above
    the capacity gets a shard for itself; with it, the result is None if they do not suffice.
    """
    tree = CapacityTree([(capacity, s) for s in range(shards or 0)])
    opened, runs = shards or 0, []
    for size, groups in sorted(histogram, reverse=True):
        place = 0
        while place < groups:
            found = tree.pop_tightest(size)
            if found is None:
                if shards is not None:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            remaining, shard = found
            now = min(groups - place, remaining // size) if size else groups - place
            runs.append((size, place, shard, now))
            tree.add(remaining - size * now, shard)
            place += now
    return runs


def pack_evenly(histogram: list[tuple[int, int]], shards: int) -> list[Run]:
    """Pack into exactly ``shards`` shards at the least capacity for which best fit succeeds.

    A group of at least the mean of what is left gets a shard for itself first, so that it does
    not raise the capacity of the others.
    """
    left = dict(histogram)
    total = sum(size * groups for size, groups in left.items())
    runs, free = [], shards
    for size in sorted(left, reverse=True):
        place = 0
        while left[size] and free > 1 and size * free >= total:
            runs.append((size, place, shards - free, 1))
            total, free, place = total - size, free - 1, place + 1
            left[size] -= 1
        if place == 0 or left[size]:
            break
    first = {size: sum(r[3] for r in runs if r[0] == size) for size in {r[0] for r in runs}}
    rest = [(size, groups) for size, groups in left.items() if groups]
    if not rest:
        return runs
    low = max(-(-total // free), max(size for size, _ in rest))
    high = -(-total // free) + max(size for size, _ in rest)
    packed = best_fit_decreasing(rest, high, free)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle, free)
        if found is None:
            low = middle + 1
        else:
            high, packed = middle, found
    return runs + [
        (size, place + first.get(size, 0), shard + shards - free, groups)
        for size, place, shard, groups in packed
    ]


def _size_class(size):
    """Sizes as they are packed: exact below 65,536, above it rounded up by less than 1/1024."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 10)
    large = (F.ceil(size / step) * step).cast("long")
    return F.when(size < EXACT_SIZES, size).otherwise(large)


def _runs(hist: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    rows = [(int(r["__class"]), int(r["__groups"])) for r in hist.toLocalIterator()]
    packed = (
        pack_evenly(rows, shards) if capacity is None else best_fit_decreasing(rows, capacity, shards)
    )
    if packed is None:
        raise ValueError("the shards cannot hold the groups")
    frame = pd.DataFrame(packed, columns=["__size", "__first", "__shard", "__groups"]).astype("int64")
    return hist.sparkSession.createDataFrame(
        frame, "__size long, __first long, __shard long, __groups long"
    )


def shard(
    docs: DataFrame,
    shards: int | None = SHARDS,
    capacity: int | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, shard, slot``.

    Size is the text's UTF-8 bytes plus 8. With ``shards`` alone the capacity is the least that
    holds all groups, so that bytes are nearly equal; with ``capacity`` the number of shards is kept
    small. Equal texts share a shard even where the group is larger than the mean shard. A null
    text counts as an empty one. Rows alike in every column get slots of their own. An empty table
    gives no rows. Other columns are not looked at.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = landed(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(plain) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(plain).alias("text_crc32"),
            F.md5(plain).alias("__text"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("__text").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__copies"))
    groups = landed(
        groups.withColumn("__class", _size_class(F.col("__bytes"))).withColumn(
            "__order", order_key(F.col("__text"))
        ),
        "shard-groups",
    )
    runs = _runs(groups.groupBy("__class").agg(F.count("*").alias("__groups")), shards, capacity)
    ranked = running(groups, "__class", "__order", ["__text"], F.lit(1), "__place")
    inside = (F.col("__class") == F.col("__size")) & F.col("__place").between(
        F.col("__first"), F.col("__first") + F.col("__groups") - 1
    )
    # Bounded: one run for each size class, and one more whenever a shard fills within a class.
    placed = landed(
        ranked.join(F.broadcast(runs), inside).select("__text", "__copies", "__shard"), "shard-places"
    )
    kept = landed(
        join_groups(rows, placed, "__text", "__copies").withColumn("__spread", spread_key("__row")),
        "shard-rows-placed",
    )
    slots = running(kept, "__shard", "__spread", ["__row"], F.lit(1), "__slot")
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
    )
