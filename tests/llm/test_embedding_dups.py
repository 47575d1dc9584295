import numpy as np
import pytest

from oddsmith.llm import embedding_dups
from oddsmith.llm._shared import table


def plain(rows, cosine):
    """Links and least reachable id of each (id, vector), by all cosines in double precision."""
    usable = [
        k for k, (_, v) in enumerate(rows)
        if v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = {k: set() for k in range(len(rows))}
    for a in usable:
        x = np.array(rows[a][1], float)
        for b in usable:
            y = np.array(rows[b][1], float)
            if a < b and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    result = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        result.append((i, len(links[k]), min(ids) if ids else None))
    return sorted(result, key=str)


def check(frame):
    rows = [tuple(r) for r in frame.select("vec_id", "embedding").collect()]
    found = embedding_dups.near_vectors(frame).collect()
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in found], key=str)
    assert got == plain(rows, 0.9)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def clustered(count, width, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(count // 12, width))
    made = centres[random.integers(0, len(centres), count)] + random.normal(size=(count, width)) * 0.28
    return [[float(x) for x in v] for v in made.astype(np.float32)]


@pytest.mark.parametrize(("kind", "block"), [("float", embedding_dups.BLOCK), ("double", 16)])
def test_every_link_is_found(spark, monkeypatch, kind, block):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    made = clustered(400, 20, 3)
    rows = list(enumerate(made)) + [(1000 + k, made[7]) for k in range(40)]
    check(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [
        (1, one, 0), (2, [2 * x for x in one], 0), (2, [2 * x for x in one], 0), (3, None, 0), (4, [], 0),
        (5, [0.0] * 5, 0), (6, [float("nan"), 1.0, 1.0, 1.0, 1.0], 0), (7, [None, 1.0, 1.0, 1.0, 1.0], 0),
        (8, [float("inf")] * 5, 0), (None, one, 0), (9, [1.0, 2.0], 0), (10, [1.0, 2.0], 0), (None, None, 0),
        (11, [-x for x in one], 0), (12, [-0.0, 0.0, 1.0, 0.0, 0.0], 0), (13, [0.0, 0.0, 1.0, 0.0, 0.0], 0),
    ]
    schema = "vec_id long, embedding array<float>, n_links int"
    check(spark.createDataFrame(rows, schema))
    assert embedding_dups.near_vectors(spark.createDataFrame([], schema)).collect() == []


def test_table(spark):
    check(table(spark, "/root/testdata/sf0.01", "embeddings"))


@pytest.mark.parametrize(("width", "own"), [(64, 4), (256, 16), (384, 16), (768, 16)])
def test_partners_of_low_intrinsic_dimension_meet(width, own):
    """Of any two partners one visits the other's list, also if vectors fill few of their dimensions."""
    random = np.random.default_rng(width)
    basis = np.linalg.qr(random.normal(size=(width, own)))[0].T
    made = random.normal(size=(1500, own))
    made /= np.sqrt((made**2).sum(axis=1, keepdims=True))
    aside = random.normal(size=made.shape)
    aside -= (aside * made).sum(axis=1, keepdims=True) * made
    aside /= np.sqrt((aside**2).sum(axis=1, keepdims=True))
    cosine = random.uniform(0.9, 0.95, (len(made), 1))
    units = np.concatenate([made, cosine * made + np.sqrt(1 - cosine**2) * aside]) @ basis
    index = embedding_dups.Index(units, int(len(units) ** 0.5))
    at, apart = embedding_dups._nearest(units, index.centres)
    reach = np.full(len(index.centres), -np.inf)
    np.maximum.at(reach, at, np.sqrt(apart))
    visits = [set(v.tolist()) for v in index.visits(units, at, reach, float(np.sqrt(2 - 2 * 0.9)))]
    pairs = np.argwhere(np.triu(units @ units.T >= 0.9, 1))
    assert len(pairs) >= len(made)
    assert all(at[b] in visits[a] or at[a] in visits[b] for a, b in pairs.tolist())


@pytest.mark.parametrize("least", [embedding_dups.LEAST_PAIRS, 10**9])
def test_recall_of_planted_partners_by_a_measured_width(spark, monkeypatch, least):
    """The width comes from 300 of 3,000 vectors; the links of all are counted."""
    monkeypatch.setattr(embedding_dups, "QUERIES", 300)
    monkeypatch.setattr(embedding_dups, "LEAST_PAIRS", least)
    widths = []
    measured = embedding_dups.measured_width
    monkeypatch.setattr(embedding_dups, "measured_width", lambda *a: widths.append(measured(*a)) or widths[-1])
    random = np.random.default_rng(11)
    made = random.normal(size=(1000, 64))
    made = np.concatenate([made + random.normal(size=made.shape) * 0.25 for _ in range(3)])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(made.astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    units = np.array([v for _, v in rows])
    units /= np.sqrt((units**2).sum(axis=1, keepdims=True))
    want = (units @ units.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dups.near_vectors(frame).collect()}
    found = np.array([got[k] for k in range(len(rows))])
    assert (found <= want).all() and want.sum() > 2000
    half = float(np.sqrt(2 - 2 * 0.9)) / 2
    if least == 10**9:
        assert widths == [half] and (found == want).all()
    else:
        assert widths[0] < half and found.sum() >= 0.99 * want.sum()
