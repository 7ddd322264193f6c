"""Nearest vectors by cosine, through coarse cells, with an exact way; fusion of rankings.

Centres are fitted on a sample of at most ``SAMPLE`` rows, the same ones on every
run (a documented bound); every row is then put into the cell of its nearest centre.
A query looks into the ``probe`` cells nearest to it. The exact way goes on: a cell
whose centre is further off than its radius and the k-th best distance so far can
hold nothing better (triangle inequality), all others are looked into as well.

Cells are cut into blocks of about ``BLOCK`` rows by a hash, and so are the queries
of a cell, so a task holds two bounded blocks and multiplies them, however full a
cell is; only a query's best ``k`` of a block leave it.

Vectors are compared by direction, in doubles; similarities are rounded to nine
places, so that ties are ties, and the lesser id comes first. Rows with a null id or
vector, a null or non-finite number, or the length zero are nobody's neighbours and
have none; vectors of another length than most of the sample's are an error. A row
isn't its own neighbour; rows of one id are told apart by nothing else.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairnlake.session import written

SAMPLE, ROUNDS, BLOCK, SEED = 10_000, 12, 20_000, 5
_FOUND = "query long, id long, similarity double"


def _directions(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that can be compared."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & v.isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def fit(rows: DataFrame, cells: int) -> np.ndarray:
    """Centres (cells x dimensions, at most as many as there are distinct sampled directions) by k-means on the sample."""
    share = max(1, rows.count() // SAMPLE)
    spot = F.xxhash64("id")
    sample = rows.where(F.pmod(spot, F.lit(share)) == 0).orderBy(spot, "id").limit(SAMPLE).select("v").toPandas().v
    if not len(sample):
        return np.zeros((0, 1))
    x = np.unique(_directions(sample), axis=0)
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


class Cells:
    """An index of vectors: every usable row in its cell, with the cells' radii and sizes."""

    def __init__(self, rows: DataFrame, *, id_col: str, vector_col: str, cells: int = 64) -> None:
        good = usable(rows, id_col, vector_col)
        self.centres = centres = fit(good, cells)

        def placed(frames):
            for f in frames:
                x = _directions(f.v)
                gap = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)) if len(x) else np.zeros((0, len(centres)))
                cell = gap.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
                yield pd.DataFrame({"id": f.id.to_numpy(), "v": pd.Series(list(x), dtype=object), "cell": cell.astype(np.int32), "gap": gap[np.arange(len(x)), cell]})

        self.rows = written(good.mapInPandas(placed, "id long, v array<double>, cell int, gap double")) if len(centres) else written(good.selectExpr("id", "v", "0 AS cell", "0D AS gap"))
        self.known = {r.cell: (r.n, r.radius) for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}  # a row a cell

    def nearest(self, queries: DataFrame, k: int, *, id_col: str, vector_col: str, probe: int = 8, exact: bool = False) -> DataFrame:
        """(query, id, similarity, rank): the best ``k`` rows of each query in the cells that it looks into, or of all rows."""
        asked = written(usable(queries, id_col, vector_col))
        centres, known = self.centres, self.known
        radii = np.array([known.get(c, (0, -np.inf))[1] for c in range(len(centres))])

        def looks(frames):
            for f in frames:
                x = _directions(f.v)
                gap = np.sqrt(np.maximum(1 - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)) if len(x) else np.zeros((0, len(centres)))
                near = np.argsort(gap, axis=1, kind="stable")[:, :probe]
                if "reach" in f:  # the exact way: all other cells that may hold something nearer
                    open_ = gap - radii - 1e-9 <= f.reach.to_numpy()[:, None]
                    np.put_along_axis(open_, near, False, axis=1)
                    of, cell = np.nonzero(open_ & np.isfinite(radii))
                else:
                    of, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
                yield pd.DataFrame({"id": f.id.to_numpy()[of], "v": pd.Series([x[i] for i in of], dtype=object), "cell": cell.astype(np.int32)})

        def best(rows: DataFrame) -> DataFrame:
            order = W.partitionBy("query").orderBy(F.desc("similarity"), "id")
            return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        if not len(centres):
            return best(queries.sparkSession.createDataFrame([], _FOUND))
        found = written(self._met(asked.mapInPandas(looks, "id long, v array<double>, cell int"), k))
        if exact:
            last = found.transform(best).groupBy("query").agg(F.min("similarity").alias("s"), F.count(F.lit(1)).alias("n"))
            reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("s"), F.lit(0.0)) + F.lit(1e-8))).otherwise(F.lit(3.0))  # no two directions are further apart than 2
            more = asked.join(last, F.col("id") == F.col("query"), "left").select("id", "v", F.coalesce(reach, F.lit(3.0)).alias("reach"))
            found = found.unionByName(self._met(more.mapInPandas(looks, "id long, v array<double>, cell int"), k))
        return best(found)

    def _met(self, looks: DataFrame, k: int) -> DataFrame:
        """(query, id, similarity): of each block that a query looks into the best ``k``."""
        blocks = F.create_map(*[F.lit(x) for cell, (n, _) in self.known.items() for x in (cell, -(-n // BLOCK))])
        spread = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
        rows = self.rows.withColumn("block", spread("id", blocks[F.col("cell")]))
        counts = written(looks)
        most = {r.cell: r.n for r in counts.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not most:
            return looks.sparkSession.createDataFrame([], _FOUND)
        groups = F.create_map(*[F.lit(x) for cell, n in most.items() for x in (cell, -(-n // BLOCK))])
        asked = counts.withColumn("part", spread("id", groups[F.col("cell")])).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
        each = rows.where(F.col("cell").isin(list(most))).withColumn("part", F.explode(F.sequence(F.lit(0), groups[F.col("cell")] - 1)))

        def multiplied(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(r):
                r = r.sort_values("id")
                ids, x = r.id.to_numpy(), np.stack(r.v.to_numpy())
                step = max(1, 4_000_000 // len(ids))
                for at in range(0, len(q), step):
                    own = q.iloc[at : at + step]
                    near = np.round(np.stack(own.v.to_numpy()) @ x.T, 9)
                    near[own.id.to_numpy()[:, None] == ids] = -np.inf
                    top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                    s = np.take_along_axis(near, top, axis=1)
                    of, _ = np.nonzero(np.isfinite(s))
                    out.append(pd.DataFrame({"query": own.id.to_numpy()[of], "id": ids[top][np.isfinite(s)], "similarity": s[np.isfinite(s)]}))
            return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

        key = ["cell", "block", "part"]
        return asked.groupBy(*key).cogroup(each.groupBy(*key)).applyInPandas(multiplied, _FOUND)


def fused(rankings: list[DataFrame], *, weight: float = 60.0) -> DataFrame:
    """(query, id, score) by reciprocal ranks: each ranking (query, id, rank) gives 1 / (weight + rank); a missing one gives nothing."""
    every = reduce(DataFrame.unionByName, [r.select("query", "id", (F.lit(1.0) / (F.lit(weight) + F.col("rank"))).alias("part")) for r in rankings])
    return every.groupBy("query", "id").agg(F.sum("part").alias("score"))
