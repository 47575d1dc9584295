"""What each filter of a chain removes, in every order of the filters.

Five filters, A to E, look at whole texts. A to D are conditions on the text alone. E is an
existential self-join: a row fails if a row with the same hash, the same text and a smaller id
exists. The failing rows of all filters are united, each row's failures become the bits of one
number, and rows are counted by part and number. Every figure of every order follows from these
counts, at most 32 a part, so the documents are not looked at again for another order.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm._shared import HOT_SHARES, WORD, landed, repeated_mask

LETTERS = "ABCDE"
COPY = "E"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ROW = ["doc_id", "part", "hash", "check"]


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def conditions(words: Column, text: Column) -> dict[str, Column]:
    """Whether a text fails A, B, C or D; ``words`` are its words, an array."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _rows(docs: DataFrame, text: str, doc_id: str, part: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        body.alias("text"),
        F.xxhash64(body).alias("hash"),
        F.xxhash64(F.lit(1), body).alias("check"),
    )


def copies(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Rows, without their texts, for which an equal text with a smaller id exists.

    ``narrow`` holds the rows' hashes and is landed. Only rows whose hash occurs twice take part: a
    mask of those hashes, of at most 16 MB, keeps the other texts out of the shuffle, and the join
    decides. Its right side is one row a text, the least id, combined before the shuffle. A text with
    more than a 512th of the rows is dealt over several tasks, and its row is copied to each.
    """
    counted = narrow.filter("doc_id is not null").groupBy("hash").agg(F.count("*").alias("n"))
    repeated = landed(counted.filter("n > 1"), "audit-repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    sent = rows.sparkSession.sparkContext.broadcast(repeated_mask(repeated, "hash"))

    @F.pandas_udf("boolean")
    def marked(hashes: pd.Series) -> pd.Series:
        mask = sent.value
        at = hashes.to_numpy().view(np.uint64) & np.uint64(len(mask) * 8 - 1)
        return pd.Series((mask[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1) > 0)

    likely = rows.filter(F.col("doc_id").isNotNull()).filter(marked("hash"))
    # fewer than 512 texts can have more than a 512th of these rows
    hot = repeated.filter(F.col("n") > total // HOT_SHARES).select(
        "hash", F.ceil(F.col("n") * F.lit(HOT_SHARES / max(total, 1))).cast("int").alias("parts")
    )
    dealt = likely.join(F.broadcast(hot), "hash", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1))
    )
    firsts = dealt.groupBy("hash", "parts", "text").agg(F.min("doc_id").alias("first_id"))
    spread = firsts.withColumn("deal", F.explode(F.sequence(F.lit(1), "parts")))
    right = spread.select(F.col("hash").alias("h"), "deal", F.col("text").alias("t"), "first_id")
    left = dealt.withColumn("deal", F.pmod(F.xxhash64("doc_id"), "parts").cast("int") + 1)
    same = (
        (F.col("hash") == F.col("h"))
        & (left["deal"] == right["deal"])
        & (F.col("text") == F.col("t"))
        & (F.col("first_id") < F.col("doc_id"))
    )
    return left.join(right, same, "left_semi").select(*_ROW)


def combinations(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    part: str = "source",
) -> DataFrame:
    """``part, bits, n, good, toxic``: how many rows fail exactly these filters.

    ``good`` and ``toxic`` count the rows whose id has a label ``quality`` 1 or ``toxic`` 1; several
    label rows of an id count as one. A null text counts as empty, a null part as the empty string,
    a null id is smaller than no other and has no label. Repeated rows count as often as they occur.
    """
    rows = _rows(docs, text, doc_id, part)
    fails = conditions(F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), 1), F.col("text"))
    bits = sum(F.when(failed, bit(letter)).otherwise(0) for letter, failed in fails.items())
    plain = landed(rows.select(*_ROW, bits.alias("bits"), F.lit(1).alias("n")), "audit-rows")
    copied = copies(rows, plain).select(*_ROW, F.lit(bit(COPY)).alias("bits"), F.lit(0).alias("n"))
    united = plain.unionByName(copied).groupBy(*_ROW)
    failing = united.agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    failing = landed(failing.select("doc_id", "part", "bits", "n"), "audit-failing")
    marks = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"),
    )
    # one row an id and text, so a join on the id meets no hot key but the null one, left out
    known = failing.filter("doc_id is not null").join(marks, "doc_id", "left")
    nameless = failing.filter("doc_id is null").selectExpr("*", "false is_good", "false is_toxic")
    return (
        known.unionByName(nameless)
        .groupBy("part", "bits")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def audit(counted: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of ``combinations``.

    ``kept`` after the step; ``removed`` in it; ``redundant`` fail its filter but went earlier;
    ``unique_fails`` fail only its filter; ``good_lost`` and ``toxic_lost`` are labelled rows removed;
    ``shapley`` is what its filter removes summed over all orders: of the 120 orders, the filter
    comes first among a row's m failing ones in 120 / m. No documents give no rows.
    """
    orders = ["".join(order) for order in permutations(LETTERS)]
    steps = counted.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    earlier = F.lit(0)
    mine = F.lit(0)
    for letter in LETTERS:
        place = F.instr("filter_order", letter)
        earlier += F.when(place < F.col("step"), bit(letter)).otherwise(0)
        mine += F.when(place == F.col("step"), bit(letter)).otherwise(0)
    fails = F.col("bits").bitwiseAND(F.col("mine")) != 0
    gone = F.col("bits").bitwiseAND(F.col("earlier")) != 0
    removed = fails & ~gone
    first_in = F.lit(len(orders)) / F.bit_count("bits")

    def count(condition: Column, n: Column | str = "n") -> Column:
        value = F.col(n) if isinstance(n, str) else n
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    return (
        steps.withColumns({"earlier": earlier, "mine": mine})
        .groupBy("part", "filter_order", "step")
        .agg(
            count(~fails & ~gone).alias("kept"),
            count(removed).alias("removed"),
            count(fails & gone).alias("redundant"),
            count(F.col("bits") == F.col("mine")).alias("unique_fails"),
            count(removed, "good").alias("good_lost"),
            count(removed, "toxic").alias("toxic_lost"),
            count(fails, F.col("n") * first_in.cast("long")).alias("shapley"),
        )
    )


def audit_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all documents by source."""
    return audit(landed(combinations(docs, labels), "audit-combinations"))
