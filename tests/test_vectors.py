"""Nearest vectors against all pairs, recall of the cells, fusion."""

import numpy as np
import pytest

from cairnlake.operators import vectors


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(x @ x[list(ids).index(q)], 9)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 16))
    x = middle[rng.integers(0, 12, 900) ** 2 % 12] + 0.4 * rng.normal(size=(900, 16))
    x[700:760] = x[700]  # ties
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block,cells", [(20_000, 16), (50, 5)])
def test_the_exact_way_equals_all_pairs_and_cells_find_most(spark, rows, monkeypatch, block, cells):
    monkeypatch.setattr(vectors, "BLOCK", block)
    odd = [(None, [1.0] * 16), (5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None, *[1.0] * 15])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(4)
    index = vectors.Cells(df, id_col="id", vector_col="v", cells=cells)
    asked = df.where("id % 20 = 0 OR id IN (701, 5001, 5002)")
    want = brute(rows, [i for i, _ in rows if i % 20 == 0 or i == 701], 10)

    def got(**how):
        found = {}
        for r in index.nearest(asked, 10, id_col="id", vector_col="v", **how).orderBy("query", "rank").collect():
            found.setdefault(r["query"], []).append(r.id)
        return found

    assert got(probe=1, exact=True) == want
    near = got(probe=4)
    assert sum(len({*near[q]} & {*w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_nothing_to_find_and_fewer_than_asked(spark):
    kind = "id long, v array<double>"
    none, two = spark.createDataFrame([], kind), spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], kind)
    near = lambda a, q: [tuple(r) for r in vectors.Cells(a, id_col="id", vector_col="v").nearest(q, 3, id_col="id", vector_col="v", exact=True).collect()]
    assert near(none, two) == [] == near(two, none)
    assert sorted(near(two, two)) == [(1, 2, 0.707106781, 1), (2, 1, 0.707106781, 1)]


def test_fused_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query long, id long, rank int")
    got = {r.id: r.score for r in vectors.fused([a, b]).collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61, 12: 1 / 62})
