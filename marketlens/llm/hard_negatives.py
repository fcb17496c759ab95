"""Hard-negative mining with an orthogonal PCA rotation.

Vectors of integers are rotated so that leading components carry most of the energy. Products accumulate over groups of
leading components; what is left is bounded by the product of the residual norms plus a slack for rounding. Rows whose
bounds leave the wanted range of scores, or can't reach the k best, are discarded early, and the rest are verified by integer
products. The rotation decides how early rows go, never which rows come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rows, and anchors, that one task holds at once.
ROWS, ANCHORS = 65_536, 16_384
#: Anchors whose partial products with all rows of a task are made at once.
TILE = 64
#: Shares of the components after which bounds are taken.
STAGES = (0.25, 0.5, 0.75, 1.0)
_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Range:
    """The k best rows of another label with low * positive <= 100 * score <= high * positive, for each positive; without
    ``low``, the k best of the same label."""

    k: int
    low: int | None = None
    high: int | None = None


def integers(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: int) -> DataFrame:
    """(row, id, label, q): distinct rows with a label and a vector of finite components; each component x as floor(scale *
    x). ``row`` numbers them, in no order."""
    v, bad = F.col(embedding), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    whole = vectors.where(label.isNotNull() & v.isNotNull() & ~F.exists(v, bad))
    rows = whole.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale))).alias("q"))
    return materialise(rows.distinct().withColumn("row", F.monotonically_increasing_id()), "integers")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """Lists as the rows of a matrix, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(flat) == len(sizes) * width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions of all rows about zero, strongest first. Second
    moments are summed in each partition and then by entry: width squared numbers come to the driver, however many rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("q"), width, np.float64)
            total += x.T @ x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "x"])

    moments = np.zeros(width * width)
    for r in rows.select("q").mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        moments[r["at"]] = r["x"]
    moments = moments.reshape(width, width)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def _rotated(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    width, shared = len(turn), rows.sparkSession.sparkContext.broadcast(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), width, np.float64)
            r = (q @ shared.value).astype(np.float32)
            at = pa.array(np.arange(len(q) + 1, dtype=np.int32) * width)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (q.astype(np.int64), r)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), *lists], names=["row", "id", "label", "q", "r"])

    return materialise(rows.mapInArrow(run, "row long, id long, label long, q array<long>, r array<float>"), "rotated")


class Block:
    """Rows of one task: integer vectors, rotated ones, and the norms of what each stage leaves."""

    def __init__(self, table: pa.Table, width: int):
        self.row = table["row"].to_numpy()
        self.id = pc.fill_null(table["id"], _NO_ID).to_numpy()
        self.label = table["label"].to_numpy()
        self.q, self.r = _matrix(table["q"], width, np.int64), _matrix(table["r"], width, np.float32)
        self.stops = sorted({max(1, round(width * s)) for s in STAGES})
        squares = np.cumsum(self.r[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1] if width else np.zeros((len(self.row), 0))
        zero = np.zeros(len(self.row))
        self.norm = np.sqrt(squares[:, 0]) if width else zero
        self.left = [np.sqrt(squares[:, s]) if s < width else zero for s in self.stops]


def best(anchor: Block, a: int, rows: Block, partial: np.ndarray, within: Range, positives: list[int], seen: list[int] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(slot, places in ``rows``, scores) of the k best rows in each range of anchor ``a``; ``partial`` are its products with
    all rows over the first stage. ``seen`` gets the number of rows left after each stage."""
    same = within.low is None
    at = np.flatnonzero((rows.label == anchor.label[a]) == same if same else rows.label != anchor.label[a])
    at = at[rows.id[at] != anchor.id[a]]
    ranges = [(-np.inf, np.inf)] if same else [(within.low * p / 100, within.high * p / 100) for p in positives]
    product = partial[at].astype(np.float64)
    rounding = (rows.r.shape[1] + 16) * 2.0**-23 * anchor.norm[a]
    for stage, stop in enumerate(rows.stops):
        if stage:
            start = rows.stops[stage - 1]
            product = product + rows.r[at, start:stop] @ anchor.r[a, start:stop]
        spread = rows.left[stage][at] * (anchor.left[stage][a] * (1 + 2.0**-20)) + rounding * rows.norm[at] + 2.0**-20
        least, most, keep = product - spread, product + spread, np.zeros(len(at), bool)
        for low, high in ranges:
            slip = 2.0**-40 * max(abs(low), abs(high)) if not same else 0.0
            wanted = (most >= low - slip) & (least <= high + slip)
            sure = least[(least > low + slip) & (most < high - slip)] if not same else least
            if len(sure) > within.k:  # so many rows are in the range that the k-th of them is beaten by none that can't reach it
                wanted &= most >= np.partition(sure, -within.k)[-within.k]
            keep |= wanted
        at, product = at[keep], product[keep]
        if seen is not None:
            seen.append(len(at))
    score = rows.q[at] @ anchor.q[a]
    out = []
    for slot, p in enumerate([0] if same else positives):
        fit = np.arange(len(at)) if same else np.flatnonzero((100 * score >= within.low * p) & (100 * score <= within.high * p))
        first = fit[np.lexsort((rows.row[at[fit]], rows.id[at[fit]], -score[fit]))[: within.k]]
        out.append((slot, at[first], score[first]))
    return out


def _search(anchors: DataFrame, rows: DataFrame, keys: list[str], width: int, within: Range) -> DataFrame:
    """(row, slot, other, other_id, score): the k best of each pair of an anchors' and a rows' block, then of all blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            a, b = Block(left, width), Block(right, width)
            positives = left["positives"].to_pylist()
            stop = b.stops[0] if b.stops else 0
            for start in range(0, left.num_rows, TILE):
                partial = a.r[start : start + TILE, :stop] @ b.r[:, :stop].T
                for k in range(len(partial)):
                    n = start + k
                    for slot, at, score in best(a, n, b, partial[k], within, positives[n]):
                        found += zip([a.row[n]] * len(at), [slot] * len(at), b.row[at], b.id[at], score, strict=True)
        columns = [np.array(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        arrays = [pa.array(c.astype(np.int64)) for c in columns]
        arrays[3] = pc.if_else(pc.equal(arrays[3], _NO_ID), None, arrays[3])
        return pa.Table.from_arrays(arrays, names=["row", "slot", "other", "other_id", "score"])

    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # both come from one table: names of their own
    pairs = anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, "row long, slot long, other long, other_id long, score long")
    order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= within.k)


def _blocks(count: int, most: int, cores: int) -> int:
    """Blocks of at most ``most`` rows (about: rows are dealt by a hash), more where cores would be idle."""
    return max(1, -(-count // most), min(cores, count // 2048))


def mine(
    vectors: DataFrame, anchors: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """For each anchor (rows where ``anchors``, a condition on the columns ``id`` and ``label``, holds; default: ids divisible
    by 100) and each of its ``positives`` best other rows of its label, the ``negatives`` best rows of other labels whose score
    is ``low`` to ``high`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. A score is the inner product of floor(scale * component); higher first, ties by smaller id.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A vector with fewer components
    than others has zeros there. A row without an id is no anchor, and comes after all ids in ties. Rows repeated with id,
    label and vector are one row; rows of one id with other labels or vectors are rows of their own, but never an anchor's
    others. Anchors without positives, positives without fitting negatives (all with a negative score) and empty tables give
    no rows. Other columns are left behind. Components so large that scores leave 64 bits are an error.

    All anchors meet all rows, in pairs of blocks: a row is sent once for each block of ANCHORS anchors, an anchor once for
    each block of ROWS rows, and each pair of blocks sends the k best a range on. No label, id or copy makes a block large.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    label = F.col("label") if label is None else label
    anchors = F.col("id") % 100 == 0 if anchors is None else anchors
    plain = integers(vectors, vec_id, embedding, label, scale)
    size = plain.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))).alias("largest"), F.count(F.when(anchors, 1)).alias("anchors")).first()
    width = size["width"] or 0
    if (size["largest"] or 0) ** 2 * width * 100 >= 1 << 62:
        raise ValueError("components are too large for 64-bit scores")
    rows = _rotated(plain, rotation(plain, width))
    discard(plain)
    chosen = rows.where(anchors)
    crowd = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    number = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own, near = _blocks(size["anchors"], ANCHORS, 1), _blocks(crowd, ROWS, cores)
    empty = F.array().cast("array<long>")
    friends = _search(
        chosen.withColumns({"i": number(own), "positives": empty}).withColumn("j", every(near)),
        rows.withColumn("j", number(near)).withColumn("i", every(own)),
        ["label", "i", "j"], width, Range(positives),
    )
    friends = materialise(friends.select("row", (F.col("place") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = friends.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    far = _blocks(size["n"], ROWS, cores)
    found = _search(
        chosen.join(wanted, "row").withColumn("i", number(own)).withColumn("j", every(far)),
        rows.withColumn("j", number(far)).withColumn("i", every(own)),
        ["i", "j"], width, Range(negatives, low, high),
    )
    return (
        found.join(friends, ["row", "slot"])
        .join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
