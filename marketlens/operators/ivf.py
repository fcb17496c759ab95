"""Nearest vectors by an inverted-file index: cells around centroids, probed from the nearest on, widening until a filter has
enough hits, or until no cell left can hold a better one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.retrieval import _best
from marketlens.session import written

#: Most cells of an index, and most rows of a cell, or queries, that one task holds.
CELLS, ROWS, QUERIES = 4096, 8192, 2048
#: Most rows of a batch that a task hands back, and most cosines to centroids that it has at once.
BATCH, SCORES = 4096, 1 << 20
#: The cell of vectors without a direction (null or all zero): it comes after all others.
NOWHERE = -1


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: all vectors with their ``cell``, stored by cell. ``reach``: for each cell the smallest cosine between its
    centroid and a member. ``probes``: the number of cells that reached the wanted recall on the sample."""

    rows: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    blocks: dict[int, int]
    probes: int


def _units(column: pa.Array) -> np.ndarray:
    """Lists as rows of unit length; zero rows for null, empty or all-zero vectors. Vectors of other lengths are an error."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if ((sizes > 0) & (sizes < width)).any():
        raise ValueError("vectors of different lengths")
    out = np.zeros((len(sizes), width))
    if width:
        out[sizes > 0] = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width), posinf=0.0, neginf=0.0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _pieces(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a table of their rows by ``cells`` has SCORES numbers at most (or is of one row)."""
    rows = max(1, SCORES // max(1, cells))
    return (batch.slice(k, rows) for batch in batches for k in range(0, batch.num_rows, rows))


def centroids_of(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids by k-means on unit vectors, started from rows spread over the sample. Empty cells keep their centroid."""
    x = x[(x * x).sum(axis=1) > 0]
    made = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else np.zeros((0, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        own = np.concatenate([(x[k : k + 4096] @ made.T).argmax(axis=1) for k in range(0, len(x), 4096)])
        sums = np.zeros_like(made)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        made = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), made)
    return made


def probes_for(x: np.ndarray, centroids: np.ndarray, recall: float, k: int, queries: int = 256) -> int:
    """How many of the nearest cells hold that share of the k nearest neighbours, by queries within the sample."""
    x = x[(x * x).sum(axis=1) > 0]
    if len(x) < 2 or not len(centroids):
        return 1
    own = (x @ centroids.T).argmax(axis=1)
    at = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    near = x[at] @ x.T
    near[np.arange(len(at)), at] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[at] @ centroids.T), axis=1), axis=1)
    ranks = np.take_along_axis(place, own[best], axis=1)
    return int(np.quantile(ranks, recall, method="higher")) + 1


def build(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, recall: float = 0.95, k: int = 10) -> VectorIndex:
    """An index of all ``vectors`` (vec_id, label, embedding, and whatever filters need).

    Centroids, and how many cells to probe, come from at most ``sample`` vectors, the first by a hash of their id; every
    vector is assigned and stored. The driver gets the sample and two numbers a cell. ``cells`` is about the root of the
    number of vectors, CELLS at most.
    """
    some = vectors.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample)
    x = _units(some.select("embedding").toArrow()["embedding"].combine_chunks())
    cells = min(CELLS, cells or max(1, int(vectors.count() ** 0.5)))
    centroids = centroids_of(x, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, cells):
            u = _units(batch.column("embedding"))
            if u.shape[1] != shared.value.shape[1] and u.any():
                raise ValueError("vectors of different lengths")
            there = u.any(axis=1) if u.shape[1] else np.zeros(len(u), bool)
            near = u @ shared.value.T if there.any() and len(shared.value) else np.zeros((len(u), 1))
            cell = np.where(there & bool(len(shared.value)), near.argmax(axis=1), NOWHERE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near.max(axis=1))], names=[*batch.schema.names, "cell", "near"])

    kept = vectors.drop("cell", "near")
    assigned = written(kept.mapInArrow(assign, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", cell int, near double"), "assigned")
    stats = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()
    reach = np.full(len(centroids), 1.0)
    for r in stats:
        if r["cell"] != NOWHERE:
            reach[r["cell"]] = r["near"]
    blocks = {r["cell"]: -(-r["n"] // ROWS) for r in stats}
    spread = F.pmod(F.xxhash64("vec_id"), _lookup(blocks, F.col("cell"))).cast("int")
    rows = written(assigned.drop("near").withColumn("vb", spread).repartition("cell", "vb"), "cells", by="cell")
    return VectorIndex(rows, centroids, reach, blocks, probes_for(x, centroids, recall, k))


def _lookup(blocks: dict[int, int], cell: Column) -> Column:
    """A cell's number of blocks, 1 for most: the others are listed, at most one cell for each ROWS rows and CELLS in all."""
    more = {c: n for c, n in blocks.items() if n > 1}
    if not more:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(v) for pair in more.items() for v in pair])[cell], F.lit(1))


def probes_of(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, reach: np.ndarray, first: int, last: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """``_probed`` of batches with a column ``query``. A query's vector goes with each of its cells, so rows are handed back
    BATCH at a time, however many cells there are."""
    n = len(centroids) + 1
    for batch in _pieces(batches, n):
        u = _units(batch.column("query"))
        there = u.any(axis=1) if u.shape[1] else np.zeros(len(u), bool)
        near = u @ centroids.T if there.any() and len(centroids) else np.zeros((len(u), len(centroids)))
        angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(reach - 1e-9, -1, 1))
        bound = np.where(there[:, None], np.cos(np.clip(angle, 0, None)) + 1e-7, 2.0)
        order = np.argsort(-(bound if exact else near), axis=1, kind="stable")
        cell = np.concatenate([order, np.full((len(u), 1), NOWHERE)], axis=1)[:, first:last]
        following = np.concatenate([np.sort(bound, axis=1)[:, ::-1], np.full((len(u), 1), -1.0)], axis=1)[:, last] if last < n else np.full(len(u), -2.0)
        at, cell = np.repeat(np.arange(len(u)), cell.shape[1]), cell.ravel().astype(np.int32)
        for k in range(0, len(at), BATCH):
            some = at[k : k + BATCH]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in batch.columns), pa.array(cell[k : k + BATCH]), pa.array(following[some])], names=[*batch.schema.names, "cell", "bound"])


def _probed(index: VectorIndex, queries: DataFrame, first: int, last: int, exact: bool) -> DataFrame:
    """Each query with the ``first`` to ``last`` of its cells, nearest first (in exact mode: highest bound first), and
    ``bound``, which no cosine in any later cell exceeds."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return probes_of(batches, *shared.value, first, last, exact)

    return queries.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in queries.dtypes) + ", cell int, bound double")


def search(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None, exact: bool = False) -> DataFrame:
    """(query_id, query_label, vec_id, label, similarity, rank): for every query (query_id, query_label, query) the k most
    similar other vectors among those where ``where`` holds; ties by id.

    The nearest ``probes`` cells are searched first. A query goes on, over twice as many cells each time, while it has fewer
    than k hits (a filter may leave few in a cell) and, if ``exact``, while a later cell could hold a better one: cells are
    then taken in the order of the highest cosine that the triangle inequality leaves possible. Vectors and queries without
    a direction come last, with null. Each round deals the open queries and the filtered rows of their cells to blocks of at
    most ROWS rows and about QUERIES queries, so no cell, however full, is one task.
    """
    v = index.rows if where is None else index.rows.where(where)
    v = v.where("vec_id is not null").select("vec_id", "label", "embedding", "cell", "vb")
    open_ = written(queries.where("query_id is not null").select("query_id", "query_label", "query"), "queries")
    kinds = {**dict(open_.dtypes), **dict(v.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "query_label", "vec_id", "label")) + ", similarity double"
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "vec_id")
    first, last, every, found = 0, index.probes, len(index.centroids) + 1, None
    left = open_.count()
    while left and first < every:
        last = min(last, every)
        many = -(-left // QUERIES)
        probed = written(_probed(index, open_, first, last, exact), "probed")
        asked = probed.select("query_id", "query_label", "query", "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int"))
        asked = asked.withColumn("vb", F.explode(F.sequence(F.lit(0), _lookup(index.blocks, F.col("cell")) - 1)))
        near = v if found is None else v.where(F.col("cell").isin([r[0] for r in probed.select("cell").distinct().collect()]))  # CELLS at most
        rows = near.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        hits = asked.groupBy("cell", "qb", "vb").cogroup(rows.groupBy("cell", "qb", "vb")).applyInArrow(lambda a, b: _best(a, b, k), schema)
        if found is not None:
            hits = hits.unionByName(found.drop("rank"))
        found = written(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        state = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"), F.count("similarity").alias("known"))
        bounds = probed.groupBy("query_id").agg(F.max("bound").alias("bound"))
        # similarities are rounded to six places, and equal ones are told apart by id
        short = F.coalesce(F.col("n"), F.lit(0)) < k
        unsure = (F.col("known") < F.col("n")) | (F.col("bound") >= F.col("least") - 1e-6)
        open_ = written(open_.join(bounds, "query_id").join(state, "query_id", "left").where(short | unsure if exact else short).select("query_id", "query_label", "query"), "queries")
        left, first, last = open_.count(), last, 2 * last
    if found is None:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    return found.select("query_id", "query_label", "vec_id", "label", "similarity", "rank")
