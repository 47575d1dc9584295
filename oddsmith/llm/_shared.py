"""Tables in the shared folder, joins that spread hot groups, and distributed running sums."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.workspace import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
HOT_SHARES = 512
ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 64
# Rows that are handed to Python at once where whole texts go there.
TEXT_ROWS = 1024
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, in the folder that all executors share."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        free.append(name)
    return free


@contextmanager
def _settings(spark: SparkSession, changed: dict[str, str]):
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession, rows_per_batch: int | None = None):
    """Jobs started inside give their shuffle files back as soon as they end.

    ``rows_per_batch`` bounds what is handed to Python at once, for rows that may be long.
    """
    changed = {_CLEANUP: "true"}
    if rows_per_batch is not None:
        changed[_BATCH] = str(rows_per_batch)
    return _settings(spark, changed)


def landed(df: DataFrame, name: str, rows_per_batch: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_dropped(spark, rows_per_batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def order_key(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest, as a number from 0."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def spread_key(*columns: Column | str) -> Column:
    """60 well-mixed bits of the columns' values, as a number from 0."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def bit_mask(bits: DataFrame, size: int) -> np.ndarray:
    """A mask of ``size`` bits, packed, with the numbers in the only column of ``bits`` set.

    Each of a few tasks packs a mask of its own; the driver sees those masks, of fixed size.
    """

    def packed(batches):
        mask = np.zeros(size, bool)
        for batch in batches:
            mask[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(mask).tobytes()])], names=["mask"])

    mask = np.zeros(size // 8, np.uint8)
    for row in bits.distinct().coalesce(4).mapInArrow(packed, "mask binary").collect():
        mask |= np.frombuffer(row["mask"], np.uint8)
    return mask


def grouped_mask(bits: DataFrame, size: int) -> np.ndarray:
    """As ``bit_mask``, united in Spark by words of 64 bits before anything is shuffled."""
    (column,) = bits.columns
    place = F.col(column).cast("long")
    words = bits.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("set")
    )
    return _packed(words, size)


def _packed(words: DataFrame, size: int) -> np.ndarray:
    """A mask from its words of 64 bits, packed as ``np.packbits`` does it."""
    mask = np.zeros(size // 64, "<u8")
    found = words.toArrow()
    mask[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return np.packbits(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def repeated_mask(hashes: DataFrame, column: str, most_bits: int = 1 << 27) -> np.ndarray:
    """A packed mask with a bit set for each 64-bit hash of ``column``: the hash modulo its size.

    The size, a power of two, is at least eight bits a hash and at most 16 MB. Bits are united in
    Spark, by words of 64; the driver sees one row a word that has any.
    """
    bits = 1 << 16
    while bits < min(8 * hashes.count(), most_bits):
        bits *= 2
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("set")
    )
    mask = np.zeros(bits // 64, "<u8")
    found = words.toArrow()
    mask[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return mask.view(np.uint8)


def by_frequency(counted: DataFrame, n: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``counted`` with the largest ``n``, at most ``most`` of them, and all others.

    Counts fall into 16 classes a doubling, so 1,024 at most; whole classes are taken.
    """
    level = F.floor(F.log2(n) * 16)
    classes = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, held = None, 0
    for row in sorted(classes, key=lambda r: -r["level"]):
        held += row["rows"]
        if held > most:
            break
        least = row["level"]
    if least is None:
        return counted.limit(0), counted
    return counted.filter(level >= least), counted.filter(level < least)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined to the landed table ``groups``, one row per ``key``.

    ``size`` holds how many rows share the key. Keys with more than a 512th of all rows, fewer than
    512 of them by counting, are broadcast, so that no task gathers the rows of a hot key; all
    other rows are joined by a shuffle. Both inputs are read twice and should be landed.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    above = F.col(size) > total // HOT_SHARES
    hot = groups.filter(above)
    kept = hot.select(key)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(kept), key, "left_anti").join(groups.filter(~above), key, "left")
    return few.unionByName(rest)


def running(
    rows: DataFrame, key: str, order: str, ties: list[str], weight: Column, name: str
) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over a key's rows before this one.

    Rows of a key are ordered by ``order`` (a spread 60-bit number), then ``ties``. Every key is cut
    into ranges of ``order`` of about 50,000 rows, so a hot key fills many tasks: the ranges' sums
    are added up over a small table, and only rows of one range meet in a window. ``rows`` is read
    twice and should be landed.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    ranges = F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.col("__rows") / ROWS_PER_BUCKET)).cast("long")
    sized = landed(counts.select(F.col(key).alias("__key"), ranges.alias("__ranges")), "ranges")
    part = F.floor(F.col(order) / F.lit(float(1 << 60)) * F.col("__ranges"))
    cut = (
        rows.join(sized, F.col(key).eqNullSafe(F.col("__key")), "left")
        .withColumn("__range", part)
        .drop("__key", "__ranges")
    )
    sums = cut.groupBy(key, "__range").agg(F.sum(weight).alias("__sum"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(key).alias("__key"),
        F.col("__range").alias("__at"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"),
    )
    inside = (
        Window.partitionBy(key, "__range")
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("__local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at"))
    return (
        local.join(offsets, same, "left")
        .withColumn(name, F.col("__offset") + F.col("__local"))
        .drop("__key", "__at", "__offset", "__local", "__range")
    )
