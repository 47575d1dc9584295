"""Joins of rows to per-key tables that stay balanced when one key holds most of the rows.

The engine's own skew handling splits a join only where both sides come straight from an
exchange. A side that was just grouped by the key does not, so hot keys are salted here.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.workspace import shared_dir, stored

# A key with more rows than this is spread over several parts of about this many.
HOT_ROWS = 1_000_000

# Lists of up to this many keys are broadcast.
MAX_LISTED_ROWS = 500_000

# Lists of up to this many keys are also handed to the scan, as lists of at most as many values
# as Spark passes on to the files.
SCANNED_KEYS, KEYS_A_LIST = 100, 10

# Words of 64 bits in the mask of wanted keys, about 32 MB where it is broadcast.
MASK_WORDS = 1 << 20

_ROW_ID = ("race_id", "horse_number")
_SPREAD = 1 << 20


def hot_keys(
    rows: DataFrame, *keys: list[str], total: int | None = None, hot_rows: int | None = None
) -> list[DataFrame | None]:
    """For each list of key columns its frequent keys with their number of parts, or None.

    All lists are counted in one pass over ``rows``, combined before the shuffle; the frequent keys
    are stored, at most one in ``hot_rows`` rows for each list. ``total`` is the number of rows, if
    known: too few rows for any hot key are not counted.
    """
    limit = hot_rows or HOT_ROWS
    if total is not None and total <= limit:
        return [None] * len(keys)
    columns = list(dict.fromkeys(c for key in keys for c in key))
    sets = rows.groupingSets([tuple(F.col(c) for c in key) for key in keys], *columns)
    counted = sets.agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / limit).cast("int")
    frequent = counted.where(F.col("_n") > limit).select(*columns, "_set", parts.alias("_parts"))
    spark = rows.sparkSession
    kept = stored(frequent, f"{shared_dir(spark)}/hot-keys-{uuid.uuid4().hex}")
    few = kept.count() <= MAX_LISTED_ROWS
    lists = []
    for key in keys:
        number = sum(1 << n for n, c in enumerate(reversed(columns)) if c not in key)
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        # many rows without a key are to be spread as well, though they match nothing
        present = kept.where(F.col("_set") == number)
        mine = present.where(known).select(*key, "_parts")
        lists.append(None if present.isEmpty() else F.broadcast(mine) if few else mine)
    return lists


def join_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    total: int | None = None,
    hot_rows: int | None = None,
    hot: list[DataFrame | None] | None = None,
) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key.

    Rows of a hot key get a part number from their own values, and the key's row of ``table``
    is copied to each part; all other keys have one part, and without hot keys the join is a plain
    one. Rows without a key match nothing and are spread freely. ``hot`` may hold the one entry of
    ``hot_keys`` for these keys, where a caller has counted several at once.
    """
    (frequent,) = hot_keys(rows, keys, total=total, hot_rows=hot_rows) if hot is None else hot
    if frequent is None:
        return rows.join(table, keys, how)
    whole = all(c in rows.columns for c in _ROW_ID)
    row_id = _ROW_ID if whole else rows.columns
    has_key = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    choices = F.when(has_key, F.coalesce("_parts", F.lit(1))).otherwise(_SPREAD)
    part = F.pmod(F.xxhash64(*row_id), choices).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    left = rows.join(frequent, keys, "left").withColumn("_part", part).drop("_parts")
    right = table.join(frequent, keys, "left").withColumn("_part", F.explode(copies)).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def among(key: Column, values: list) -> Column:
    """Whether ``key`` is one of ``values``, in lists short enough to be passed on to the files."""
    known = sorted(v for v in values if v is not None)
    lists = [known[at : at + KEYS_A_LIST] for at in range(0, len(known), KEYS_A_LIST)]
    return reduce(lambda a, b: a | b, [key.isin(part) for part in lists], F.lit(False))


def keep_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``listed``: by a broadcast list if it is short, else by a join.

    Very short lists also become filters of the scan, so that a table with Bloom filters on the key
    (see ``write_by_race``) reads only the row groups that may hold one of them.
    """
    keys = listed.select(key).distinct()
    total = listed.count()
    if total <= SCANNED_KEYS:
        rows = rows.where(among(F.col(key), [r[0] for r in keys.collect()]))
    if total <= MAX_LISTED_ROWS:
        return rows.join(F.broadcast(keys), key, "left_semi")
    return join_by_key(rows, keys, [key], "left_semi")


def restrict_to(
    history: DataFrame, rows: DataFrame, key: str = "horse_name", total: int | None = None
) -> DataFrame:
    """Only the history of keys that occur in ``rows``, if there are few rows.

    Pricing a few races needs the features of their runners, not of every horse: a broadcast
    list of them keeps all other history out of the shuffles. With many rows there is little
    to gain, and the history is returned whole. ``total`` is their number, if known.
    """
    if (rows.count() if total is None else total) > MAX_LISTED_ROWS:
        return history
    return history.join(F.broadcast(rows.select(key).distinct()), key, "left_semi")


def thinned_to(history: DataFrame, rows: DataFrame, key: str, total: int) -> DataFrame:
    """The history of the keys that occur in ``rows``; of many keys some of the others' history, too.

    A list too long to broadcast (see :func:`restrict_to`) is made a mask of fixed size: a bit for
    the hash of each key. A key that is not wanted passes where its bit is taken, more often the more
    keys there are, so the result is for callers who join or group by the key afterwards. ``total``
    is the number of ``rows``.
    """
    if total <= MAX_LISTED_ROWS:
        return restrict_to(history, rows, key, total)
    place = F.pmod(F.xxhash64(key), F.lit(MASK_WORDS * 64))
    word, bit = F.shiftright(place, 6).alias("_word"), F.expr("shiftleft(1L, cast(_place & 63 AS int))")
    wanted = rows.where(F.col(key).isNotNull()).withColumn("_place", place).select(word, bit.alias("_bit"))
    mask = F.broadcast(wanted.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    marked = history.withColumn("_place", place)
    same = (F.shiftright("_place", 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return marked.join(mask, same, "left_semi").drop("_place")
