"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a digest of id and text. A copy's virtual finish time is the
source's words up to and with it, over the source's weight; a second copy of every document queues
after the first ones. All copies are range-sorted by finish time and cut where the running total
would pass the budget. A source that runs out leaves its share to the others, which is what the
targets say in closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.llm._shared import WORD, landed, order_key, running

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
_NO_ID = -(1 << 63)
_KEYS = ("__source", "__size", "__order", "__id")


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.concat_ws(":", F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    return docs.withColumns(
        {
            "__source": F.col(source).cast("string"),
            "__size": words,
            "__order": order_key(F.md5(name)),
            "__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)),
        }
    )


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
) -> DataFrame:
    """Weight and target of each row of ``sizes`` (``__source``, ``source_size``), one a source.

    Weights repeat over the sources by code point, null last. Targets share ``budget`` times all
    sizes by weight; none passes ``repeats`` times its source, and the excess is reshared: with the
    sources ordered by cap over weight, the level is set by the first that stays below its cap. The
    windows see one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("__source").isNull(), "__source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights) + 1)
    listed = sizes.withColumn("__rank", rank).withColumn("weight", weight)
    by_fill = Window.orderBy(F.col("__cap") / F.col("weight"), "__rank")
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    filled = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        F.lit(float(budget)) * F.sum("source_size").over(every)
        - F.coalesce(F.sum("__cap").over(filled), F.lit(0))
    ) / F.sum("weight").over(rest)
    placed = (
        listed.withColumn("__cap", (F.col("source_size") * F.lit(repeats)).cast("double"))
        .withColumn("__level", level)
        .withColumn("__place", F.row_number().over(by_fill))
    )
    below = F.col("__level") < F.col("__cap") / F.col("weight")
    lowest = F.min(F.when(below, F.struct("__place", "__level"))).over(every)["__level"]
    target = F.least(F.col("__cap"), F.coalesce(lowest * F.col("weight"), F.col("__cap")))
    return placed.withColumn("target", target).drop("__cap", "__level", "__place")


def _queue(docs: DataFrame, weights, budget, repeats) -> tuple[DataFrame, tuple | None]:
    """Narrow rows with their place in the source's queue, and the last copy that the mix takes."""
    narrow = landed(docs.select(*_KEYS), "mix-sizes")
    sizes = narrow.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    targets = landed(source_targets(sizes, weights, budget, repeats), "mix-targets").alias("t")
    queued = running(narrow, "__source", "__order", ["__id", "__size"], F.col("__size"), "__before")
    known = queued.alias("q").join(
        targets, F.col("q.__source").eqNullSafe(F.col("t.__source")), "left"
    )
    queue = landed(
        known.select("q.*", "t.source_size", "t.weight", "t.target", "t.__rank"), "mix-queue"
    )
    copies = queue.filter("__size > 0").select(
        "__rank", "__order", "__id", "__size", "__before", "source_size", "weight",
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("__copy"),
    )
    place = ["__finish", "__rank", "__copy", "__order", "__id", "__size"]
    sorted_copies = landed(
        copies.withColumn("__finish", _finish(F.col("__copy")))
        .select(*place)
        .repartitionByRange(*place)
        .withColumn("__part", F.spark_partition_id()),
        "mix-order",
    )
    parts = sorted_copies.groupBy("__part").agg(F.sum("__size").alias("__sum"))
    so_far = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.lit(float(budget)) * F.lit(sizes.agg(F.sum("source_size")).first()[0] or 0)
    reached = parts.withColumn("__earlier", F.coalesce(F.sum("__sum").over(so_far), F.lit(0)))
    border = reached.filter(F.col("__earlier") <= limit).orderBy(F.desc("__part")).first()
    if border is None:
        return queue, None
    inside = Window.partitionBy("__part").orderBy(*place)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        sorted_copies.filter(F.col("__part") == border["__part"])
        .withColumn("__total", F.sum("__size").over(inside) + F.lit(border["__earlier"]))
        .filter(F.col("__total") <= limit)
        .agg(F.max(F.struct(*place)).alias("last"))
        .first()["last"]
    )
    if last is None:  # not even the first copy of the last range fits
        last = (
            sorted_copies.filter(F.col("__part") < border["__part"])
            .agg(F.max(F.struct(*place)).alias("last"))
            .first()["last"]
        )
    return queue, None if last is None else tuple(last)


def _finish(copy) -> F.Column:
    return (copy * F.col("source_size") + F.col("__before") + F.col("__size")) / F.col("weight")


def _taken_copies(last: tuple | None, repeats: int):
    """How many copies of a queued row lie at or before the last one taken."""
    if last is None:
        return F.lit(0)
    end = F.struct(
        F.lit(float(last[0])), F.lit(last[1]), F.lit(last[2]), F.lit(last[3]).cast("long"),
        F.lit(last[4]).cast("long"), F.lit(last[5]).cast("long"),
    )
    here = [
        F.struct(_finish(F.lit(k)), "__rank", F.lit(k), "__order", "__id", "__size") <= end
        for k in range(repeats)
    ]
    return sum((h.cast("int") for h in here), F.lit(0)) * (F.col("__size") > 0).cast("int")


def mix_report(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken``.

    ``taken`` is the document's words times its copies in the mix. Documents without words (null,
    empty or blank texts) are never taken. Rows alike in id and text enter together; documents
    without an id come before others of equal digest. A null source is a source. An empty table
    gives no rows. Other columns are not looked at.
    """
    queue, last = _queue(_keyed(docs, text, source, doc_id), weights, budget, repeats)
    return queue.select(
        F.when(F.col("__id") != _NO_ID, F.col("__id")).alias("doc_id"),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * _taken_copies(last, repeats)).cast("long").alias("taken"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    Texts are not shuffled: within a source the queue is a digest order, so the cut is one point a
    source, joined back by source. Cases as in ``mix_report``.
    """
    keyed = _keyed(docs, text, source, doc_id)
    queue, last = _queue(keyed, weights, budget, repeats)
    place = F.struct("__copy", "__order", "__id", "__size")
    ends = (
        queue.withColumn("__copy", _taken_copies(last, repeats))
        .filter(F.col("__copy") > 0)
        .groupBy(F.col("__source").alias("__of"))
        .agg(F.max(place).alias("__end"))
    )
    ends = landed(ends, "mix-ends")
    here = sum(
        (
            (F.struct(F.lit(k), "__order", "__id", "__size") <= F.col("__end")).cast("int")
            for k in range(1, repeats + 1)
        ),
        F.lit(0),
    )
    return (
        keyed.filter("__size > 0")
        .join(ends, F.col("__source").eqNullSafe(F.col("__of")))
        .withColumn("__times", here)
        .filter("__times > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*docs.columns)
    )
