"""Vector search: exact top-k, filtered before or after, and inverted cells for approximate search."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V

#: Distances that a task of nearest_to_each() holds at once.
TILE = 1 << 20


def with_distance(df: DataFrame, vector: str, query: Sequence[float], metric: str = "l2", into: str = "distance") -> DataFrame:
    """df with the distance of each vector from the query: "l2", "cosine" or "ip" (negative inner product)."""
    return df.withColumn(into, V.METRICS[metric](V.doubles(F.col(vector)), V.literal(query)))


def with_distance_arrow(df: DataFrame, vector: str, query: Sequence[float], metric: str = "l2", into: str = "distance") -> DataFrame:
    """The same for wide vectors, in batches of numpy arithmetic."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def away(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, len(q)))
            dot = x @ q
            if metric == "ip":
                d = -dot
            elif metric == "l2":
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
            else:
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
                d = np.where(size > 0, 1 - dot / np.where(size > 0, size, 1), np.nan)
            yield pd.Series(d)

    return df.withColumn(into, F.nanvl(away(F.col(vector)), F.lit(None).cast("double")))


def nearest(df: DataFrame, k: int, order: Sequence[Column | str]) -> DataFrame:
    """The first k rows by the order: a top-k in every task, then over all."""
    return df.orderBy(*order).limit(k)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x from rows of q, infinite where there is none."""
    dot = q @ x.T
    if metric == "ip":
        return -dot
    if metric == "l2":
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * dot, 0))
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    return np.where(size > 0, 1 - dot / np.where(size > 0, size, 1), np.inf)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keep(best: tuple[np.ndarray, np.ndarray, np.ndarray], d: np.ndarray, ids: np.ndarray, cell: np.ndarray) -> None:
    """Put what is nearer than the last of best (distance, id, cell by row of d, in order) into it; distances count with nine digits, ties by id."""
    k = best[0].shape[1]
    last = best[0][:, -1]
    if d.shape[1] > k and np.isinf(last).any():
        last = np.fmin(last, np.partition(d, k - 1, axis=1)[:, k - 1])
    at, col = np.nonzero((d <= last[:, None] + 1e-9) & np.isfinite(d))  # more than what counts after rounding
    if not len(at):
        return
    rows, which = np.unique(at, return_inverse=True)
    group = np.concatenate((np.repeat(np.arange(len(rows)), k), which))
    parts = [np.concatenate((b[rows].ravel(), new)) for b, new in zip(best, (np.round(d[at, col], 9), ids[col], cell[col]), strict=True)]
    order = np.lexsort((parts[1], parts[0], group))
    first = np.searchsorted(group[order], np.arange(len(rows)))
    taken = order[first[:, None] + np.arange(k)]
    for b, p in zip(best, parts, strict=True):
        b[rows] = p[taken]


def _nearest_in(batches: Iterator[pa.RecordBatch], own: np.ndarray, queries: np.ndarray, cells: Cells | None, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """(query, id, cell, distance): the k nearest to each query among batches of (id, vector, and cell if there is one)."""
    best = np.full((len(own), k), np.inf), np.zeros((len(own), k), np.int64), np.zeros((len(own), k), np.int32)  # distance, id, cell
    reads = None if cells is None else cells.read_by(queries)
    step = max(1, TILE // max(1, len(own)))
    for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
        i, x = part.column(0).to_numpy(), _matrix(part.column(1))
        cell = part.column(2).to_numpy() if part.num_columns > 2 else np.zeros(len(i), np.int32)
        d = distances(queries, x, metric)
        d[own[:, None] == i] = np.inf
        if reads is not None:
            d[~reads[:, cell]] = np.inf
        _keep(best, d, i, cell)
    query = np.repeat(own, k)
    d, i, c = (b.ravel() for b in best)
    ok = np.isfinite(d)
    yield pa.RecordBatch.from_arrays([pa.array(query[ok], pa.int64()), pa.array(i[ok]), pa.array(c[ok]), pa.array(d[ok])], names=["query", "id", "cell", "distance"])


def nearest_to_each(df: DataFrame, id_col: str, vector: str, ids: np.ndarray, q: np.ndarray, k: int, metric: str, cells: Cells | None = None) -> DataFrame:
    """(query, id, cell, distance, rank): the k rows of df nearest to each of a block of queries but the row of its own id; ties by id. cells: only in those that a search of them reads.

    The block goes to all tasks; each keeps k rows of a query, and holds TILE distances at once. Rows without a vector are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast((ids, q, cells))
    name = "cell" if "cell" in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _nearest_in(batches, *shared.value, k, metric)

    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long"), vector, *([name] if name else []))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return rows.mapInArrow(run, "query long, id long, cell int, distance double").withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Cells:
    """Inverted cells: vectors are listed under the nearest of some centroids (of unit vectors for cosine), and a search reads the `probes` lists nearest to the query."""

    centroids: np.ndarray
    metric: str
    probes: int

    @staticmethod
    def fit(df: DataFrame, id_col: str, vector: str, number: int = 100, metric: str = "l2", recall: float = 0.95, k: int = 10, sample: int = 10_000, asked: int = 256, rounds: int = 10, seed: int = 0) -> Cells:
        """Centroids by k-means on at most `sample` vectors chosen by hash; probes: the least number that finds the share `recall` of the k nearest rows of at most `asked` of them."""
        rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), V.doubles(F.col(vector)).alias("v")).orderBy(F.xxhash64("v")).limit(sample).toPandas()
        x = np.stack(rows["v"].to_numpy()) if len(rows) else np.zeros((1, 1))
        rng = np.random.default_rng(seed)
        u = _normed(x) if metric == "cosine" else x
        c = u[rng.choice(len(u), min(number, len(u)), replace=False)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(axis=1) - 2 * u @ c.T).argmin(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, u)
            n = np.bincount(near, minlength=len(c))
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        out = Cells(c, metric, len(c))
        if not len(rows):
            return out
        q = x[:asked]
        numbered = out.assigned(df, vector).withColumn("__id", F.monotonically_increasing_id())
        found = nearest_to_each(numbered, "__id", vector, -1 - np.arange(len(q)), q, k + 1, metric).where("rank > 1").collect()  # the first is the row itself
        ranks = out.order(q).argsort(axis=1)
        places = sorted(int(ranks[-1 - r["query"], r["cell"]]) for r in found)
        return Cells(c, metric, 1 + places[min(len(places) - 1, int(np.ceil(recall * len(places))))] if places else len(c))

    def _away(self, x: np.ndarray) -> np.ndarray:
        u = _normed(x) if self.metric == "cosine" else x
        return (self.centroids * self.centroids).sum(axis=1) - 2 * u @ self.centroids.T

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells by row of q, nearest first; for inner products, those of the greatest product with the centroid."""
        return (-(q @ self.centroids.T) if self.metric == "ip" else self._away(q)).argsort(axis=1, kind="stable")

    def read_by(self, q: np.ndarray) -> np.ndarray:
        """Whether a search reads each cell, by row of q."""
        out = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(out, self.order(q)[:, : self.probes], True, 1)
        return out

    def assigned(self, df: DataFrame, vector: str, into: str = "cell") -> DataFrame:
        """df with the number of the nearest centroid (null without a vector); write it sorted by that column to read few cells per search."""

        @F.pandas_udf("int")
        def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                out = pd.Series([None] * len(v), dtype="Int32", index=v.index)
                if (ok := v.notna()).any():
                    out[ok] = self._away(np.stack(v[ok].to_numpy()).astype(np.float64)).argmin(axis=1).astype("int32")
                yield out

        return df.withColumn(into, near(F.col(vector)))

    def probed(self, df: DataFrame, query: Sequence[float], cell: str = "cell") -> DataFrame:
        """Rows of the cells nearest to the query; the filter skips files and row groups of a table sorted by cell."""
        return df.where(F.col(cell).isin(*map(int, self.order(np.asarray([query], np.float64))[0, : self.probes])))

    def to_json(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "metric": self.metric, "probes": self.probes})

    @staticmethod
    def from_json(text: str) -> Cells:
        d = json.loads(text)
        return Cells(np.array(d["centroids"]), d["metric"], d["probes"])


def _normed(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)
