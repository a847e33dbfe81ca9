"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves, and each half gets the nearest of its own centroids, so
a pair of centroids names a cell, and few centroids make many cells. A query visits
cells in order of the summed distances of the two halves, by a heap over the two sorted
lists, until they hold enough vectors; those are ranked by their true similarity.

Centroids are fitted on a bounded sample of vectors; every vector is indexed. The cells'
sizes (centroids squared, a fixed number) are all that the driver gathers of the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinline.llm.flat import mix, runs
from twinline.session import ship, written

CENTROIDS = 256  # of each half, at most
CELL_ROWS = 6  # distinct vectors that a cell holds on average at least: a walk over emptier ones is long
SAMPLE = 8192  # vectors that the centroids are fitted on, at most
# Distinct vectors that the visited cells hold: this many at least, and this share of all. The
# share is what vectors without any structure need for a recall of 0.95; clustered ones need less.
CANDIDATES = 6000
SHARE = 0.45
PIECE_ROWS = 4096  # distinct vectors of a cell that are ranked together
UNIT_ROWS = 1024  # distinct vectors that a unit of cells and pieces holds on average
ROUNDS = 12


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists, all of one length, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, vector)`` as doubles, of the vectors that have a direction.

    Null and zero vectors, those with a null or non-finite component, those of another
    length than most, and rows without an id take no part.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (common["n"] if common else 0))


def fold(rows: DataFrame, k: int) -> DataFrame:
    """``(rep, ids, vector)``: distinct vectors with their k + 1 smallest ids, rep the first.

    Of equal vectors, no more can be among anybody's k nearest; the limit is applied
    before the shuffle, so a vector that fills the table is no hot key.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1)
    ids = F.sort_array(F.collect_list("vec_id"))
    return few.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector")


def _fit(sample: np.ndarray, centroids: int) -> np.ndarray:
    """Centroids of the sample's rows; starts from its first ones."""
    centers = sample[:centroids].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(sample, centers)
        sums, counts = np.zeros_like(centers), np.bincount(nearest, minlength=len(centers))
        np.add.at(sums, nearest, sample)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (centers**2).sum(1) - 2 * rows @ centers.T + (rows**2).sum(1)[:, None]


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return _distances(rows, centers).argmin(1)


class Cells:
    """Centroids of both halves."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return unit[:, : self.left.shape[1]], unit[:, self.left.shape[1] :]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.halves(vectors)
        return _nearest(a, self.left) * len(self.right) + _nearest(b, self.right)

    def nearest(self, vectors: np.ndarray, sizes: dict[int, int], enough: int) -> Iterator[list[int]]:
        """For each vector, its nearest cells in order, until they hold ``enough`` vectors.

        The heap holds the frontier of the grid of both halves' centroids, each sorted by
        distance; a pair is entered once both its predecessors have been taken.
        """
        a, b = self.halves(vectors)
        for to_left, to_right in zip(_distances(a, self.left), _distances(b, self.right)):
            by_left, by_right = np.argsort(to_left, kind="stable"), np.argsort(to_right, kind="stable")
            x, y = to_left[by_left].tolist(), to_right[by_right].tolist()
            by_left, by_right = by_left.tolist(), by_right.tolist()
            taken = [0] * (len(x) + 1)  # pairs taken in each row of the grid
            heap, cells, held = [(x[0] + y[0], 0, 0)], [], 0
            while heap and held < enough:
                _, i, j = heapq.heappop(heap)
                taken[i] = j + 1
                cell = by_left[i] * len(y) + by_right[j]
                if size := sizes.get(cell, 0):
                    cells.append(cell)
                    held += size
                if j + 1 < len(y) and (i == 0 or taken[i - 1] > j + 1):
                    heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
                if i + 1 < len(x) and taken[i + 1] == j:
                    heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            yield cells


def fit(classes: DataFrame, distinct: int, sample: int = SAMPLE) -> Cells:
    """Centroids from the ``sample`` vectors whose ids have the least hashes."""
    rows = classes.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow()
    vectors = _matrix(rows.column("vector"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    half = (unit.shape[1] + 1) // 2
    count = min(CENTROIDS, max(8, int((distinct / CELL_ROWS) ** 0.5)), len(unit))
    right = unit[:, half:] if half < unit.shape[1] else np.zeros((len(unit), 1))
    return Cells(_fit(unit[:, :half], count), _fit(right, count))


def nearest_neighbours(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    candidates: int = CANDIDATES,
    share: float = SHARE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each query by cosine, but for itself.

    ``queries`` are rows of ``df``. Nearest first, ties to the smaller id; fewer rows if
    there are fewer vectors. Cells are visited until they hold ``candidates`` distinct
    vectors and ``share`` of all, so the answer is exact for tables up to ``candidates``,
    and approximate beyond.
    Unusable vectors (:func:`usable`) take no part; a repeated row counts once; of an id
    with several vectors each counts; an empty table gives an empty one.
    """
    spark = df.sparkSession
    ship(spark)
    classes = written(fold(usable(df, vec_id, vector), k), "vectors")
    asked = usable(queries, vec_id, vector).distinct()
    distinct = classes.count()
    enough = max(candidates, int(share * distinct))
    out = "query_id long, rank int, vec_id long, score double"
    if not distinct:
        return spark.createDataFrame([], out)
    cells = spark.sparkContext.broadcast(fit(classes, distinct))
    units = -(-distinct // UNIT_ROWS)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells.value.of(_matrix(batch.column("vector")))
                yield batch.append_column("cell", pa.array(cell, pa.int64()))

    indexed = written(classes.mapInArrow(assign, "rep long, ids array<long>, vector array<double>, cell long"), "cells")
    # At most CENTROIDS squared rows, whatever the table holds.
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    held = spark.sparkContext.broadcast(sizes)

    def unit_of(cell: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (cell * 31 + piece) % units

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, rep = batch.column("cell").to_numpy(), batch.column("rep").to_numpy()
            pieces = np.array([-(-held.value[c] // PIECE_ROWS) for c in cell.tolist()], np.int64)
            unit = unit_of(cell, mix(rep.astype(np.uint64)).astype(np.int64) % np.maximum(pieces, 1))
            yield batch.append_column("unit", pa.array(unit, pa.int64()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, units_, cells_ = [], [], []
            for i, visited in enumerate(cells.value.nearest(_matrix(batch.column("vector")), held.value, enough)):
                by_unit: dict[int, list[int]] = {}
                for cell in visited:
                    for piece in range(-(-held.value[cell] // PIECE_ROWS)):
                        by_unit.setdefault(int(unit_of(np.int64(cell), np.int64(piece))), []).append(cell)
                rows += [i] * len(by_unit)
                units_ += by_unit.keys()
                cells_ += by_unit.values()
            if rows:
                vectors = batch.column("vector").take(pa.array(rows))
                number = batch.column("query").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(units_, pa.int64()), number, vectors, pa.array(cells_, pa.list_(pa.int64()))],
                    names=["unit", "query", "vector", "cells"],
                )

    def rank(asking: pa.Table, held_: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not asking.num_rows or not held_.num_rows:
            return empty
        wanted, vectors = _matrix(asking.column("vector")), _matrix(held_.column("vector"))
        wanted_norm, norm = np.sqrt((wanted**2).sum(1)), np.sqrt((vectors**2).sum(1))
        cell, rep = held_.column("cell").to_numpy(), held_.column("rep").to_numpy()
        order = np.lexsort((rep, cell))
        at = dict(zip(cell[order][(first := runs(cell[order]))].tolist(), np.split(order, first[1:])))
        query, place, scores = [], [], []
        for i, visited in enumerate(asking.column("cells").to_pylist()):
            here = [at[c] for c in set(visited) if c in at]
            if here:
                here = np.concatenate(here)
                score = vectors[here] @ wanted[i] / (norm[here] * wanted_norm[i])
                best = np.lexsort((rep[here], -score))[: k + 1]
                query += [i] * len(best)
                place.append(here[best])
                scores.append(score[best])
        if not query:
            return empty
        place = pa.array(np.concatenate(place))
        return pa.table({
            "query": asking.column("query").take(pa.array(query)),
            "rep": held_.column("rep").take(place),
            "ids": held_.column("ids").take(place),
            "score": np.concatenate(scores),
        })

    # Equal query vectors are searched once; a query is known by its smallest asker.
    distinct_queries = asked.groupBy("vector").agg(F.min("vec_id").alias("query"))
    # Their vectors are few MB, and their walks are what takes time: dealt by number, not by size.
    probes = distinct_queries.select("query", "vector").repartition(units, "query").mapInArrow(probe, "unit long, query long, vector array<double>, cells array<long>")
    data = indexed.mapInArrow(deal, "rep long, ids array<long>, vector array<double>, cell long, unit long")
    found = probes.groupBy("unit").cogroup(data.groupBy("unit")).applyInArrow(rank, "query long, rep long, ids array<long>, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k + 1)
    few = top.select("query", "score", F.explode("ids").alias("found"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    few = few.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k + 1)
    lists = few.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("found")))).alias("found"))
    askers = asked.join(distinct_queries, "vector").select(F.col("vec_id").alias("query_id"), "query")
    others = F.slice(F.filter("found", lambda x: x["found"] != F.col("query_id")), 1, k)
    return (
        askers.join(lists, "query")
        .select("query_id", F.posexplode(others).alias("rank", "one"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("one.found").alias("vec_id"), (-F.col("one.s")).alias("score"))
    )
