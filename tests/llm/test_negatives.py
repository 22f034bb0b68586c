"""Hard negatives against their SQL and against plain loops."""

import math
import random

import duckdb
import numpy as np
import pytest

from townledger.llm import negatives
from townledger.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, r long, cluster int, score string, v int"


def plain(rows, every=100, relabel=7, positives=5, negatives=5, low=80):
    rows = list({(i, l, tuple(v)): (i, v, l) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}.values())
    rows = [(i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i is not None and i % relabel == 0 else l) for i, v, l in rows]
    out = []
    for a, (i, v, l) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m == l) for b, (j, w, m) in enumerate(rows) if b != a), key=lambda x: x[:3])
        for s, none, j, _ in [x for x in scored if x[3]][:positives]:
            found = [x for x in scored if not x[3] and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, None if none else j, rank, None if y[1] else y[2], -s, -y[0]) for rank, y in enumerate(found, 1)]
    return sorted(out, key=str)


def got(df, **how):
    return sorted(map(tuple, negatives.hard_negatives(df, **how).collect()), key=str)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(6)
    rows = []
    for i in range(420):
        v = [rng.gauss(0, 1) for _ in range(8)] if i % 3 else [1.0 + rng.choice([0, 0.25]), 0.5, 0, 0, 0, 0, 0, rng.choice([-0.001, 0.001])]
        rows.append((i, [float(np.float32(x)) for x in v], rng.randrange(4)))
    rows += [(900, None, 1), (901, [1.0] * 8, None), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1), (904, [None] + [0.5] * 7, 1), (905, [0.0] * 8, 1), (1000, [0.0] * 8, 2),
             (1100, [], 1), (906, [2.0, 1.0], 3), (None, [1.0, 0.5] + [0.0] * 6, 0), (None, [1.0, 0.5] + [0.0] * 6, 1), (100, [3.0] * 8, 1), (300, rows[300][1], rows[300][2]), (5, rows[5][1], rows[5][2])]
    return rows


def test_against_loops(spark, table, monkeypatch):
    prepare(spark)
    df = spark.createDataFrame([(*r, 1, 2, "s", 3) for r in table], SCHEMA)
    want = plain(table)
    assert want and got(df) == want
    monkeypatch.setattr(negatives, "BLOCK", 32)
    monkeypatch.setattr(negatives, "GROUP", 2)
    monkeypatch.setattr(negatives, "CLUSTER", 2)
    assert got(df) == want
    assert got(df.limit(0)) == [] and got(df.filter("vec_id % 100 <> 0")) == [] and got(df.filter("vec_id = 100")) == []


def test_against_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    prepare(spark)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    result = negatives.hard_negatives(spark.read.parquet(path))
    want = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({negatives.SQL})").fetchall()
    assert sorted(map(tuple, result.collect()), key=str) == sorted(want, key=str)


def test_walks_end_early_and_lose_nothing(spark, monkeypatch):
    """Clusters far apart: members must be done before the last segment, with the same result."""
    prepare(spark)
    rng = np.random.default_rng(3)
    centres = np.eye(6)
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.02, 6)).astype(np.float32).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(1200)]
    asked = []
    plain_segment = negatives.Lists.segment
    monkeypatch.setattr(negatives.Lists, "segment", lambda self, s, active: (asked.append((s, len(active))), plain_segment(self, s, active))[1])
    monkeypatch.setattr(negatives, "CLUSTER", 2)
    monkeypatch.setattr(negatives, "SEGMENTS", (1 / 16, 1 / 4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(df) == plain(rows)
    assert max(s for s, _ in asked) < 2


def test_whole_numbers_beyond_doubles():
    a = np.array([[2.0 ** 40 + 1, 3.0]])
    b = np.array([[2.0 ** 41 + 1, 5.0], [1.0, 1.0]])
    assert negatives.inner(a, b).tolist() == [[(2 ** 40 + 1) * (2 ** 41 + 1) + 15, 2 ** 40 + 4]]
    none = np.zeros(2, bool)
    assert negatives.best(negatives.inner(a, b)[0], none, np.array([5, 4]), np.arange(2), 1).tolist() == [0]
    x = np.array([-3.5, -1e-9, 0.0, 1e-9, 0.1, 65536.0, 65700.0])
    r = negatives.rung(x)
    assert (np.diff(r) >= 0).all() and all(negatives.rung_floor(int(k)) <= v for k, v in zip(r, x))


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 50, (400, 16))
    c = negatives.centres(x[:40], 5)
    norm, angle = negatives.angles(x[:40], c)
    near = angle.argmin(axis=1)
    widest = np.array([angle[near == k, k].max() if (near == k).any() else 0 for k in range(5)])
    bound = negatives.upper_bounds(x, c, widest)
    for a in range(40):
        assert (x @ x[a] / norm[a] <= bound[:, near[a]]).all()
