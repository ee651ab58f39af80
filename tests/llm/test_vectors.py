import math

import numpy as np
import pytest

from grainscope.llm import itq, rpforest
from grainscope.llm.itq import link_near_vectors
from grainscope.llm.rpforest import search

KIND = "vec_id long, embedding array<float>, label int, vector int, leaf int, rank int, code int"
BAD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 15]


def table(spark, vectors):
    rows = [v if isinstance(v, tuple) else (i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 1, 1, 1, 1)
                                  for i, v in rows], KIND).repartition(3)


def clusters(n=240, size=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    return (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, size))).astype(np.float32)


def good(x):
    x = np.asarray(x, float)
    return x.shape == (16,) and np.isfinite(x).all() and x.any()


def test_search_against_brute_force(spark):
    x = clusters()
    x[30:45] = x[30]                                     # ties
    vectors = [list(map(float, v)) for v in x] + BAD
    rows = table(spark, vectors)
    got = {}
    for r in search(rows, rows.where("vec_id % 10 = 0"), k=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = x.astype(float)
    assert set(got) == set(range(0, 240, 10))
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(240), -s)) if i != q][:8]
        hits += len(set(order) & {v for v, _ in found})
        assert all(math.isclose(score, s[v], rel_tol=1e-12, abs_tol=1e-12) for v, score in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and q not in dict(found)
    assert hits / (8 * len(got)) >= 0.9


def test_search_in_blocks(spark, monkeypatch):
    x = [list(map(float, v)) for v in clusters(120)]
    rows = table(spark, x)
    asked = rows.where("vec_id % 5 = 0")
    whole = sorted(map(tuple, search(rows, asked, k=5).collect()))
    monkeypatch.setattr(rpforest, "BLOCK", 7)
    assert sorted(map(tuple, search(rows, asked, k=5).collect())) == whole


def test_search_edges(spark):
    few = table(spark, [[1.0] * 16, [2.0] * 16, [1.0] * 15 + [0.0], (None, [1.0] * 16)])
    assert [(r.query_id, r["rank"], r.vec_id) for r in search(few, few.where("vec_id = 0"), k=20).orderBy("rank").collect()] == [
        (0, 1, 1), (0, 2, 2)]
    assert search(few.limit(0), few.limit(0)).count() == 0
    assert search(table(spark, BAD), table(spark, BAD)).count() == 0
    one = table(spark, [[1.0] * 16])
    assert search(one, one).count() == 0


@pytest.mark.parametrize("hot", [256, 3])
def test_near_vectors_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(itq, "HOT", hot)
    monkeypatch.setattr(itq, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 16))
    x[50:90] = x[3] + 0.08 * rng.normal(size=(40, 16))
    x[90:100] = x[4]
    x[100:110] = x[5] + 0.02 * rng.normal(size=(10, 16))
    x[110] = 3 * x[6]
    x = x.astype(np.float32)
    vectors = [list(map(float, v)) for v in x] + BAD
    got = {r.vec_id: r for r in link_near_vectors(table(spark, vectors)).collect()}
    assert len(got) == len(vectors)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in range(150))
    label = list(range(150))
    for a, b in zip(*np.nonzero(links)):
        p, q = sorted((label[a], label[b]))
        label = [p if c == q else c for c in label]
    assert [got[i].component_id for i in range(150)] == label
    assert all(got[i].kept == (label[i] == i) for i in range(150))
    for i in range(150, len(vectors)):
        assert tuple(got[i]) == (i, 0, i, True)


def test_near_vectors_edges(spark):
    assert link_near_vectors(table(spark, [[1.0] * 16]).limit(0)).count() == 0
    rows = table(spark, [(1, [1.0] * 16), (1, [1.0] * 16), (2, [2.0] * 16), (None, [1.0] * 16)])
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in link_near_vectors(rows).collect()) == [
        (0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_meeting_place_is_the_same_in_both_forms(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    differ = [0, 1, 1 << 63, (1 << 16) + 3] + [int(sum(1 << int(b) for b in set(rng.integers(0, 64, k)))) for k in range(1, 12) for _ in range(20)]
    signed = [d - (1 << 64) if d >> 63 else d for d in differ]
    rows = spark.createDataFrame(list(enumerate(signed)), "i long, d long").select("i", itq.first_meeting(F.col("d")).alias("m"))
    got = {r.i: -1 if r.m is None else r.m for r in rows.collect()}
    assert [got[i] for i in range(len(differ))] == itq.first_meeting_np(np.array(differ, np.uint64)).tolist()


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.8])
def test_near_vectors_just_above_the_threshold(spark, shared):
    """Pairs of cosine 0.95 to 0.97 among vectors of which ``shared`` is the norm of the mean; all by brute force."""
    rng = np.random.default_rng(5)

    def units(x):
        return x / np.linalg.norm(x, axis=1)[:, None]

    x = math.sqrt(1 - shared ** 2) * units(rng.normal(size=(2000, 64)))
    x[:, 0] += shared
    x = units(x)
    side = rng.normal(size=x.shape)
    side = units(side - (side * x).sum(axis=1)[:, None] * x)
    c = rng.uniform(0.9501, 0.97, len(x))[:, None]
    x = np.concatenate([x, c * x + np.sqrt(1 - c * c) * side])
    assert itq.plan_tables(x, len(x), 0.95)[0] > 0       # there are tables
    got = {r.vec_id: r.n_links for r in link_near_vectors(table(spark, x)).collect()}
    u = units(x.astype(np.float32).astype(float))
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert all(got[i] <= links[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.995 * links.sum() and links.sum() >= 4000


def test_tables_follow_the_data():
    x = np.random.default_rng(3).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = x + 2 * x[0]
    off /= np.linalg.norm(off, axis=1)[:, None]
    assert itq.plan_tables(off, 10 ** 5, 0.95)[1] > itq.plan_tables(x, 10 ** 5, 0.95)[1]
    assert itq.plan_tables(x, 10 ** 6, 0.95)[0] > itq.plan_tables(x, 10 ** 4, 0.95)[0]
    assert itq.plan_tables(x[:1], 10 ** 5, 0.95) == itq.plan_tables(x, 10, 0.95) == (0, 1)
