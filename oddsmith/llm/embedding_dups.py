"""Near-duplicate vectors by product quantisation with an exact rerank.

Unit vectors fall into coarse lists; what is left of a vector after its list's centre is coded by
subspace. A vector visits its own list and those that may hold a partner: of two partners in
different cells, at most r apart, one lies within r / 2 of the plane between the cells' centres, and
that one visits the other's list. How near to the planes partners really lie is measured: a sample of
vectors is compared with all others, and the widest distance that any of their N partners needs, and
half as much again, takes the place of r / 2: another pair needs more in one of N cases at most. With
too few partners to tell r / 2 stays. In a list the distance to every member is looked up from the codes
(asymmetric: the visitor itself is not coded) and, less the member's own coding error, is a lower
bound; what stays below r is reranked by exact cosine. Within the visited lists no pair at or above
the threshold is lost, and none below it passes.

Equal vectors are one class. Links are counted, not listed: a pair of blocks returns the number of
links of each class and only as many links as join what is connected.
"""

from __future__ import annotations

import pickle
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from oddsmith.llm._links import components
from oddsmith.llm._shared import join_groups, landed
from oddsmith.llm.near_dups import _groups as runs

COSINE = 0.9
# The index is fitted on so many classes at most, chosen by their digest; all are indexed.
FITTED = 20_000
MOST_LISTS = 1 << 14
SUBSPACE, CODES = 4, 256
# Classes that are compared with all others to measure how near to the planes partners lie, the least
# number of pairs that tells, and the allowance on top.
QUERIES, LEAST_PAIRS, ALLOWANCE = 4096, 200, 1.5
BLOCK = 1024
_PASSES = 8
_SLACK = 1e-4


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and its squared distance."""
    squared = (centres**2).sum(axis=1)
    at = np.empty(len(points), np.int64)
    apart = np.empty(len(points))
    step = max(1, (1 << 22) // len(centres))
    for start in range(0, len(points), step):
        part = points[start : start + step]
        scores = squared - 2 * part @ centres.T
        at[start : start + step] = best = scores.argmin(axis=1)
        apart[start : start + step] = scores[np.arange(len(part)), best] + (part**2).sum(axis=1)
    return at, np.maximum(apart, 0)


def _centres(points: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's means; starts at points spread over the sample, empty cells stay where they are."""
    k = min(k, len(points))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(_PASSES):
        at, _ = _nearest(points, centres)
        n = np.bincount(at, minlength=k)
        for axis in range(points.shape[1]):
            sums = np.bincount(at, points[:, axis], minlength=k)
            centres[n > 0, axis] = sums[n > 0] / n[n > 0]
    return centres


class Index:
    """Centres of the lists and the code books of the subspaces."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.padded = -(-self.width // SUBSPACE) * SUBSPACE
        self.centres = _centres(sample, lists)
        at, _ = _nearest(sample, self.centres)
        parts = self._split(sample - self.centres[at])
        self.books = [_centres(parts[k], CODES) for k in range(len(parts))]

    @classmethod
    def restored(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        vars(index).update(state)
        return index

    def _split(self, rest: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rest), self.padded))
        wide[:, : self.width] = rest
        return wide.reshape(len(rest), -1, SUBSPACE).transpose(1, 0, 2)

    def code(self, units: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector in its list, and how far they put it from where it is."""
        parts = self._split(units - self.centres[at])
        codes = np.empty((len(units), len(self.books)), np.uint8)
        error = np.zeros(len(units))
        for k, book in enumerate(self.books):
            codes[:, k], apart = _nearest(parts[k], book)
            error += apart
        return codes, np.sqrt(error)

    def visits(
        self, units: np.ndarray, at: np.ndarray, reach: np.ndarray, r: float, width: float | None = None
    ) -> list[np.ndarray]:
        """For each vector its own list and those beyond a near plane that may hold a partner.

        A plane is near within ``width``, by default the half of ``r``, which misses no partner.
        """
        found = []
        squared = (self.centres**2).sum(axis=1)
        step = max(1, (1 << 22) // len(self.centres))
        width = r / 2 if width is None else width
        for start in range(0, len(units), step):
            part, own = units[start : start + step], at[start : start + step]
            apart = np.maximum(1 + squared - 2 * part @ self.centres.T, 0)
            between = squared[own][:, None] + squared - 2 * self.centres[own] @ self.centres.T
            gap = apart - apart[np.arange(len(part)), own][:, None]
            near = gap <= 2 * (width + _SLACK) * np.sqrt(np.maximum(between, 0)) + _SLACK
            near &= np.sqrt(apart) <= r + reach + _SLACK
            near[np.arange(len(part)), own] = True
            found += [np.flatnonzero(row).astype(np.int32) for row in near]
        return found


def _lookup(parts: np.ndarray, books: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Squared distances of coded members (rows) to visitors (columns), summed over subspaces."""
    total = np.zeros((codes.shape[1], parts.shape[1]), np.float32)
    for part, book, code in zip(parts, books, codes, strict=True):
        table = -2 * book @ part.T
        table += (book**2).sum(axis=1)[:, None]
        table += (part**2).sum(axis=1)
        total += table.astype(np.float32)[code]
    return total


def _units(batch: pa.RecordBatch, column: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(batch.column(column).to_pylist()), kind)
    raw = raw.reshape(len(batch), -1).astype(np.float64)
    return raw, raw / np.sqrt((raw**2).sum(axis=1, keepdims=True))


def vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, width, key, raw``: the digest and the bytes of each usable vector.

    Null, zero and empty vectors and those with null or non-finite components have no key.
    """
    double = "double" in dict(rows.dtypes)[vector]
    kind = "<f8" if double else "<f4"

    def read(batches):
        for batch in batches:
            widths, keys, raws = [], [], []
            for value in batch.column(1):
                part = value.values
                usable = part is not None and len(part) and not part.null_count
                if usable:
                    numbers = part.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                    usable = np.isfinite(numbers).all() and numbers.any()
                widths.append(len(numbers) if usable else None)
                raws.append(numbers.astype(kind).tobytes() if usable else None)
                keys.append(blake2b(raws[-1], digest_size=16).digest() if usable else None)
            found = [pa.array(widths, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())]
            names = ["vec_id", "width", "key", "raw"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=names)

    chosen = rows.selectExpr(f"cast(`{vec_id}` as bigint) vec_id", f"`{vector}` vector")
    return chosen.mapInArrow(read, "vec_id long, width int, key binary, raw binary")


def fit(classes: DataFrame, kind: str, lists: int) -> dict:
    """An index, as plain arrays, fitted in one task on ``FITTED`` classes at most, by digest."""

    def fitted(batches):
        parts = [_units(b, 0, kind)[1] for b in batches if len(b)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps(vars(Index(np.concatenate(parts), lists)))], pa.binary())], names=["index"]
        )

    sample = classes.orderBy("key").limit(FITTED).select("raw")
    return pickle.loads(sample.repartition(1).mapInArrow(fitted, "index binary").first()["index"])


def _indexed(classes: DataFrame, sent, kind: str) -> DataFrame:
    """``key, copies, raw, list, apart, codes, error`` of every class."""

    def rows(batches):
        index = Index.restored(sent.value)
        for batch in batches:
            if not len(batch):
                continue
            _, units = _units(batch, 2, kind)
            at, apart = _nearest(units, index.centres)
            codes, error = index.code(units, at)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(at.astype(np.int32)),
                    pa.array(np.sqrt(apart)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error),
                ],
                names=["key", "copies", "raw", "list", "apart", "codes", "error"],
            )

    return classes.select("key", "copies", "raw").mapInArrow(
        rows, "key binary, copies long, raw binary, list int, apart double, codes binary, error double"
    )


def needed_width(
    index: Index, a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray
) -> np.ndarray:
    """For pairs of vectors in different lists: how far the nearer one is from the plane between."""
    ca, cb = index.centres[in_a], index.centres[in_b]
    between = np.sqrt(((ca - cb) ** 2).sum(axis=1))
    from_a = ((a - cb) ** 2).sum(axis=1) - ((a - ca) ** 2).sum(axis=1)
    from_b = ((b - ca) ** 2).sum(axis=1) - ((b - cb) ** 2).sum(axis=1)
    return np.minimum(from_a, from_b) / (2 * np.maximum(between, 1e-12))


def measured_width(indexed: DataFrame, sent, kind: str, cosine: float, r: float) -> float:
    """How near to a plane partners lie, from ``QUERIES`` classes against all; ``r / 2`` at most."""
    asked = indexed.orderBy("key").limit(QUERIES).select("key", "raw", "list").toArrow()
    queries = indexed.sparkSession.sparkContext.broadcast(
        (asked.column("key").to_pylist(), asked.column("raw").to_pylist(), asked.column("list").to_numpy())
    )

    def compared(batches):
        index = Index.restored(sent.value)
        keys, raws, homes = queries.value
        of = {key: n for n, key in enumerate(keys)}
        points = pa.record_batch([pa.array(raws, pa.binary())], names=["raw"])
        _, points = _units(points, 0, kind)
        most, pairs = 0.0, 0
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                _, units = _units(part, 1, kind)
                at = part.column(2).to_numpy()
                near = units @ points.T >= cosine
                for k, key in enumerate(part.column(0).to_pylist()):
                    if key in of:
                        near[k, of[key]] = False
                x, y = np.nonzero(near)
                pairs += len(x)
                apart = at[x] != homes[y]
                x, y = x[apart], y[apart]
                if len(x):
                    needed = needed_width(index, units[x], at[x], points[y], homes[y])
                    most = max(most, float(needed.max()))
        yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([pairs])], names=["most", "pairs"])

    found = indexed.select("key", "raw", "list").mapInArrow(compared, "most double, pairs long")
    most, pairs = found.agg(F.max("most"), F.sum("pairs")).first()
    return r / 2 if (pairs or 0) < LEAST_PAIRS else min(r / 2, most * ALLOWANCE)


def _visiting(indexed: DataFrame, sent, reach, kind: str, r: float, width: float) -> DataFrame:
    """``indexed`` with ``visits``, the lists that each class visits."""

    def rows(batches):
        index = Index.restored(sent.value)
        for batch in batches:
            if not len(batch):
                continue
            _, units = _units(batch, 2, kind)
            visits = index.visits(units, batch.column(3).to_numpy(), reach.value, r, width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(visits, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "visits"],
            )

    shape = StructType([*indexed.schema.fields, StructField("visits", ArrayType(IntegerType()))])
    return indexed.mapInArrow(rows, shape)


def compare(group: pa.Table, index: Index, kind: str, cosine: float, r: float):
    """Links of one pair of blocks: keys with their number of links, and joining links."""
    member = group.column(6).to_numpy(zero_copy_only=False)
    if member.all() or not member.any():
        return [], []
    rows = group.combine_chunks().to_batches()[0]
    raw, units = _units(rows, 5, kind)
    keys, copies = rows.column(3).to_pylist(), rows.column(4).to_numpy()
    inside, outside = np.flatnonzero(member), np.flatnonzero(~member)
    picked = rows.take(pa.array(inside))
    codes = np.frombuffer(b"".join(picked.column(7).to_pylist()), np.uint8).reshape(len(inside), -1)
    bound = (r + _SLACK + picked.column(8).to_numpy()) ** 2
    at = rows.column(0)[0].as_py()
    parts = index._split(units[outside] - index.centres[at])
    codes = np.ascontiguousarray(codes.T)
    left, right = [], []
    for start in range(0, len(outside), 256):
        near = _lookup(parts[:, start : start + 256], index.books, codes) <= bound[:, None]
        other, one = np.nonzero(near)
        left.append(outside[start + one])
        right.append(inside[other])
    left, right = np.concatenate(left), np.concatenate(right)
    if not len(left):
        return [], []
    lengths = np.sqrt((raw**2).sum(axis=1))
    good = np.zeros(len(left), bool)
    for start in range(0, len(left), 1 << 15):
        a, b = left[start : start + (1 << 15)], right[start : start + (1 << 15)]
        good[start : start + (1 << 15)] = (raw[a] * raw[b]).sum(axis=1) / (lengths[a] * lengths[b]) >= cosine
    left, right = left[good], right[good]
    # Two members of one list meet twice there; the visitor with the lesser key counts. Two members of
    # different lists meet in both if each visits the other's; the later list counts.
    home = rows.column(9).to_numpy()
    distinct = {k: n for n, k in enumerate(sorted(set(keys)))}
    rank = np.array([distinct[k] for k in keys])
    visits = rows.column(10).to_pylist()
    once = np.where(home[left] == at, rank[left] < rank[right], True)
    back = np.flatnonzero(home[left] > at)
    if len(back):
        lists = int(home.max()) + 1
        seen = [len(v or []) for v in visits]
        pairs = np.repeat(np.arange(len(seen)), seen) * lists + np.array([x for v in visits for x in v or []], np.int64)
        once[back] = ~np.isin(right[back] * lists + home[left[back]], pairs)
    left, right = left[once], right[once]
    counts = np.bincount(left, copies[right], len(keys)) + np.bincount(right, copies[left], len(keys))
    counted = [(keys[k], int(counts[k])) for k in np.flatnonzero(counts)]
    return counted, _joining(rank[left], rank[right], sorted(distinct, key=distinct.get))


def _joining(a: np.ndarray, b: np.ndarray, names: list[bytes]) -> list[tuple[bytes, bytes]]:
    """As many of the links as join what they connect."""
    above = list(range(len(names)))
    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = x, y
        while above[u] != u:
            above[u] = u = above[above[u]]
        while above[v] != v:
            above[v] = v = above[above[v]]
        if u != v:
            above[max(u, v)] = min(u, v)
            kept.append((names[x], names[y]))
    return kept


def _links(classes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """``a, b, n`` of the classes of one width: ``a`` has ``n`` more links; or ``a`` and ``b`` joined."""
    spark = classes.sparkSession
    r = float(np.sqrt(2 - 2 * cosine))
    lists = int(min(MOST_LISTS, max(1, classes.count() ** 0.5)))
    state = fit(classes, kind, lists)
    sent = spark.sparkContext.broadcast(state)
    indexed = landed(_indexed(classes, sent, kind), "vectors-indexed")
    per_list = indexed.groupBy("list").agg(F.max("apart").alias("reach"), F.count("*").alias("members"))
    per_list = landed(per_list, "vectors-lists")
    reach = np.full(len(state["centres"]), -np.inf)
    for row in per_list.toLocalIterator():  # one row a list
        reach[row["list"]] = row["reach"]
    reaches = spark.sparkContext.broadcast(reach)
    width = measured_width(indexed, sent, kind, cosine, r)
    visiting = landed(_visiting(indexed, sent, reaches, kind, r, width), "vectors-visits")
    visitors = visiting.select("key", "copies", "raw", F.col("list").alias("home"), F.explode("visits").alias("list"))
    visited = visitors.groupBy("list").agg(F.count("*").alias("visitors"))
    blocks = landed(
        per_list.join(visited, "list").select(
            "list",
            F.ceil(F.col("visitors") / BLOCK).cast("int").alias("left"),
            F.ceil(F.col("members") / BLOCK).cast("int").alias("right"),
        ),
        "vectors-blocks",
    )
    place = F.shiftrightunsigned(F.xxhash64("key", "list"), 8)
    outer = visitors.join(blocks, "list").select(
        "list", (place % F.col("left")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("right") - 1)).alias("j"),
        "key", "copies", "raw", F.lit(False).alias("member"), F.lit(None).cast("binary").alias("codes"),
        F.lit(0.0).alias("error"), "home", F.lit(None).cast("array<int>").alias("visits"),
    )
    inner = visiting.join(blocks, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("i"),
        (place % F.col("right")).cast("int").alias("j"),
        "key", "copies", "raw", F.lit(True).alias("member"), "codes", "error",
        F.col("list").alias("home"), "visits",
    )
    dealt = outer.unionByName(inner).repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")

    def compared(batches):
        index = Index.restored(sent.value)
        for group in runs(batches):
            counted, joining = compare(group, index, kind, cosine, r)
            if counted:
                a = [k for k, _ in counted] + [x for x, _ in joining]
                b = [None] * len(counted) + [y for _, y in joining]
                n = [c for _, c in counted] + [0] * len(joining)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                    names=["a", "b", "n"],
                )

    return landed(dealt.mapInArrow(compared, "a binary, b binary, n long"), "vectors-links")


def near_vectors(
    rows: DataFrame, cosine: float = COSINE, vector: str = "embedding", vec_id: str = "vec_id"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Null, zero and empty vectors and those with null or non-finite components link with nothing and
    are their own component. Vectors of different length do not link. Equal vectors, and repeated
    rows, link with each other. A null id is never a component's id unless all are null, and its row
    is not kept. An empty table gives no rows; other columns are not looked at.
    """
    kind = "<f8" if "double" in dict(rows.dtypes)[vector] else "<f4"
    read = landed(vectors(rows, vector, vec_id), "vectors")
    classes = landed(
        read.filter("key is not null")
        .groupBy("width", "key")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")),
        "vectors-classes",
    )
    found = None
    for width in classes.select("width").distinct().collect():  # lengths of vectors, a few
        part = _links(classes.filter(F.col("width") == width["width"]), kind, cosine)
        found = part if found is None else found.unionByName(part)
    whole = classes.select("key", "id", "copies")
    if found is None:
        whole = whole.withColumns({"more": F.lit(0).cast("long"), "component": F.col("key")})
    else:
        linked = components(found.filter("b is not null").select("a", "b"))
        counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more"))
        whole = whole.join(counts, "key", "left").join(
            linked.select(F.col("node").alias("key"), "component"), "key", "left"
        )
    whole = landed(whole.withColumn("component", F.coalesce("component", "key")), "vectors-whole")
    least = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    groups = whole.join(least, "component").select(
        "key", "copies", "component_id", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    usable = read.filter("key is not null").select("vec_id", "key")
    grouped = join_groups(usable, landed(groups, "vectors-groups"), "key", "copies")
    alone = read.filter("key is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        grouped.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
