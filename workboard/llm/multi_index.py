"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves; each half is quantised with its own codebook of
CODES centroids (k-means, fitted on at most SAMPLE vectors, those with the
smallest hash of the id; every vector is indexed). The pair of centroids is the
vector's cell. For a query the pairs are traversed from the nearest on, by the
sum of the two halves' distances, with a heap over the two sorted lists, until
the cells hold SHARE of all vectors. What these cells hold is reranked with the
exact inner product. Distance is the negative inner product, so the sum over the
halves is that of the whole vector.

Cells are cut into parts of vectors and of queries, so that a common vector's
cell is spread over tasks and no task holds a whole group; a part sends its best
TOP for each of its queries.

Products are summed in order of the components in double precision, so that equal
vectors have equal scores whatever block they are in; ties go to the smaller id.

Defined results: a vector that is null, empty or zero, or holds a null or a
non-finite component, takes no part, nor does one whose length is not the most
common length of the sample; a row with a null id is left out; of rows that share
an id the smallest vector (by its first differing component) counts. Fewer
candidates than TOP: all of them are ranked. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workboard.llm.common import hash_sample, stored

CODES = 16
SHARE = 0.7
SAMPLE = 20_000
TOP = 20
#: Vectors, and queries, of one part of a cell.
PART_ROWS = 512


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from points spread over the sample (deterministic)."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        for j in range(len(centres)):
            if (own := near == j).any():
                centres[j] = points[own].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of ``d1[i] + d2[j]`` until they hold ``enough`` vectors.

    The multi-sequence walk: a pair enters the heap when it is next to a pair
    taken before. Empty cells are passed.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, seen, out, held = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(s2) + int(o2[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, each summed in order of the components."""
    out = np.zeros((len(queries), len(vectors)))
    for q, v in zip(queries.T, vectors.T):
        out += q[:, None] * v[None, :]
    return out


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` largest scores, ties to the smaller id."""
    if len(scores) > top:
        least = -np.partition(-scores, top - 1)[top - 1]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:top]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assign(books):
    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                half = books[0].shape[1]
                cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "vec", "cell"])

    return assign


def _visit(books, counts, enough):
    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            half = books[0].shape[1]
            d1, d2 = -x[:, :half] @ books[0].T, -x[:, half:] @ books[1].T
            cells = [traverse(a, b, counts, enough) for a, b in zip(d1, d2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["id", "vec", "cells"])

    return visit


def _rank(top: int):
    def rank(batches):
        """Rows come by part (cell, vpart, qpart), vectors before queries."""
        part, ids, vecs, queries, qvecs = None, [], [], [], []

        def flush():
            if not ids or not queries:
                return None
            found, matrix = np.array(ids), np.array(vecs)
            q, v, s = [], [], []
            for at in range(0, len(queries), 64):
                block = products(np.array(qvecs[at: at + 64]), matrix)
                for own, row in zip(queries[at: at + 64], block):
                    other = np.flatnonzero(found != own)
                    keep = other[best(row[other], found[other], top)]
                    q += [own] * len(keep)
                    v.append(found[keep])
                    s.append(row[keep])
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(v), pa.int64()),
                                               pa.array(np.concatenate(s))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            asks, names, x = batch.column(3).to_pylist(), batch.column(4).to_pylist(), _matrix(batch.column(5))
            for i, key in enumerate(keys):
                if key != part:
                    if (out := flush()) is not None:
                        yield out
                    part, ids, vecs, queries, qvecs = key, [], [], [], []
                (queries if asks[i] else ids).append(names[i])
                (qvecs if asks[i] else vecs).append(x[i])
        if (out := flush()) is not None:
            yield out

    return rank


def search(vectors: DataFrame, query_filter: Column, id_col: str = "vec_id", vec_col: str = "embedding",
           top: int = TOP, codes: int = CODES, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``top`` nearest found."""
    spark = vectors.sparkSession
    rows = (vectors.filter(_usable(F.col(vec_col)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                    F.coalesce(query_filter, F.lit(False)).alias("asks"))
            .groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")))
    sample = hash_sample(rows.select("id", "vec"), SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.diff(sample.offsets.to_numpy())
    width = int(np.bincount(sizes).argmax())
    fit = _matrix(sample.filter(pa.array(sizes == width)))
    half = max(width // 2, 1)
    books = (kmeans(fit[:, :half], codes), kmeans(fit[:, half:], codes) if width > 1 else np.zeros((1, 0)))
    rows = rows.filter(F.size("vec") == width)
    indexed = stored(rows.select("id", "vec").mapInArrow(_assign(books), "id long, vec array<double>, cell int"), "index")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row per cell: at most codes squared
        counts[r["cell"]] = r["count"]
    enough = max(int(np.ceil(share * counts.sum())), top + 1)
    visits = stored(rows.filter("asks").select("id", "vec").mapInArrow(
        _visit(books, counts, enough), "id long, vec array<double>, cells array<int>"), "visits")
    asked = np.zeros(len(counts), np.int64)
    for r in visits.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        asked[r["cell"]] = r["count"]
    parts = lambda n: F.array(*[F.lit(int(max(1, -(-x // PART_ROWS)))) for x in n])
    n_v = F.element_at(parts(counts), F.col("cell") + 1)
    n_q = F.element_at(parts(asked), F.col("cell") + 1)
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = indexed.withColumn("vpart", own(n_v)).withColumn("qpart", every(n_q)).withColumn("asks", F.lit(False))
    asks = (visits.select("id", "vec", F.explode("cells").alias("cell"))
            .withColumn("qpart", own(n_q)).withColumn("vpart", every(n_v)).withColumn("asks", F.lit(True)))
    names = ["cell", "vpart", "qpart", "asks", "id", "vec"]
    found = (held.select(*names).unionByName(asks.select(*names)).repartition("cell", "vpart", "qpart")
             .sortWithinPartitions("cell", "vpart", "qpart", "asks")
             .mapInArrow(_rank(top), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
