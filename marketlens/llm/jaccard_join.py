"""Similarity join of documents on 5-word shingle sets by a count-vector R-tree.

A document's distinct shingles are hashed into groups, and the number in each group makes the document a point. Two sets
share at most the sum over groups of the smaller count, so an R-tree over the points finds every partner that can still
reach the threshold, by node maxima first. Surviving pairs are verified on the exact sets. Sets that are equal are one
node, whatever ids their rows have.

One tree over a corpus does not fit a worker, so nodes are first dealt to buckets that lose no pair. Linked sets of n and
m elements differ in at most ``d = (n + m) * (100 - percent) / (100 + percent)`` of them. A set is cut into bands by the
range of its hashes, and a band with all that it holds is one unit: at most d units of a set are missing from a linked one,
so in any fixed order the first d + 1 units of both have one in common. Units come by how common their rarest shingle is
and then by how many shingles they hold: two documents that share a passage hardly share a band's whole content, so few
of them meet, at any size of the corpus. Which bands there are depends on the size class (a power of two) of the larger
set; a set whose partners may be in the next class has units of that class too.

A few first rounds compare each node with the leader that it shares most units with; what they link needs no further
comparing. The trees then search the buckets that still join unconnected parts, members outside the main part only; larger
ones are searched in blocks, so no worker holds one. No group's pairs are all made.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, TEXTS, WHITE, discard, free_name, materialise, small_batches
from .components import connected_components

WIDTH = 5
#: Fewest and most groups of a point. A set of n shingles has the power of two from n on, 256 from 256 to 2048, and that
#: from n / 8 on beyond: sets that share no more than a passage differ in more groups than similar ones can, and short
#: sets, whose near copies are often just below the threshold, are told apart almost shingle by shingle.
FEWEST, MOST = 32, 4096
#: Rounds in which each node is compared with one leader.
ROUNDS = 3
_U = np.uint64
_MUL = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 17
with np.errstate(over="ignore"):
    #: A random number for each byte.
    _BYTES = _mixed(np.arange(1, 257, dtype=_U) * _MUL[1])


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as the longest piece of a text has needed."""

    up = down = np.ones(0, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _PIECE)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where each word of ``data`` starts, a 64-bit hash for it): a polynomial of its bytes' numbers, which sums up to
    words' ends give for all words at once. Long data goes in pieces that end where a word does."""
    if len(data) > _PIECE:
        parts, a = [], 0
        while a < len(data):
            b = len(data) if len(data) - a <= _PIECE else data.rfind(b" ", a, a + _PIECE) + 1 or data.find(b" ", a + _PIECE) + 1 or len(data)
            start, found = _hashes_of(data[a:b])
            parts.append((start + a, found))
            a = b
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    return _hashes_of(data)


def _hashes_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    np.not_equal(codes, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _Powers.upto(len(codes))
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(_BYTES[codes] * up[: len(codes)], out=sums[1:])
    return start, _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def shingle_sets(texts: Iterable[str | None], chars: int = 50_000) -> Iterator[np.ndarray]:
    """For each text its distinct 5-word shingles as sorted 64-bit hashes. Fewer words make one shingle, none make none.
    About ``chars`` characters of texts are hashed at once."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        some.append((text or "").encode("utf-8", "surrogatepass").translate(FOLD))
        size += len(some[-1])
        if size >= chars:
            yield from _sets_of(some)
            some, size = [], 0
    yield from _sets_of(some)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once. (numpy's own hashes them first, which takes ten times as long.)"""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _sets_of(some: list[bytes]) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(x) + 1 for x in some])
    start, w = word_hashes(b" ".join(some))
    n = max(0, len(w) - WIDTH + 1)
    total = np.zeros(n, _U)
    for k in range(WIDTH):
        total += w[k : n + k] * _MUL[k]
    total = _mixed(total)
    a = 0
    for text, b in zip(some, np.searchsorted(start, ends).tolist(), strict=True):
        if b - a >= WIDTH:
            yield distinct(total[a : b - WIDTH + 1])
        else:
            words = text.split()
            yield np.array([xxhash.xxh64_intdigest(b"%d " % len(words) + b" ".join(words))] if words else [], _U)
        a = b


def shingles(text: str | None) -> np.ndarray:
    """``shingle_sets`` of one text."""
    return next(shingle_sets([text]))


def groups_of(n: int) -> int:
    return min(MOST, max(FEWEST, 1 << (max(min(n, 256), -(-n // 8)) - 1).bit_length()))


def counts(found: np.ndarray, groups: int) -> np.ndarray:
    """The set's point: how many of its hashes fall into each group. Points of half as many groups are sums of two
    neighbours."""
    return np.bincount(((found >> _U(40)) & _U(MOST - 1)).astype(np.int64) // (MOST // groups), minlength=groups)


def least_overlap(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least intersection with which two sets of ``total`` elements together reach ``percent`` of their union."""
    return -(-total * percent // (100 + percent))


class CountTree:
    """R-tree over count vectors, packed by size and then by the coordinate that spreads most.

    Each node keeps the largest count of each group and the range of sizes below it.
    """

    def __init__(self, sizes: np.ndarray, points: np.ndarray, leaf: int = 16, fan: int = 8):
        slab = max(leaf, int(np.ceil(np.sqrt(len(sizes) / leaf))) * leaf)
        by_size = np.argsort(sizes, kind="stable")
        wide = int(np.argmax(points.var(axis=0))) if len(points) else 0
        parts = [by_size[a : a + slab] for a in range(0, len(by_size), slab)]
        self.order = np.concatenate([p[np.argsort(points[p, wide], kind="stable")] for p in parts]) if parts else by_size
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        low, high, top, width = self.sizes, self.sizes, self.points, leaf
        while len(low) > 1:
            at = np.arange(0, len(low), width)
            low, high, top = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at, axis=0)
            self.levels.append((low, high, top, width))
            width = fan

    def partners(self, size: int, point: np.ndarray, percent: int) -> np.ndarray:
        """Positions (in the order given) of all sets whose bound lets them reach ``percent`` with this one."""
        if not len(self.sizes):
            return np.zeros(0, np.int64)
        at = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            low, high, top, width = self.levels[k]
            if k < len(self.levels) - 1:
                step = self.levels[k + 1][3]
                at = (at[:, None] * step + np.arange(step)).ravel()
                at = at[at < len(low)]
            fits = (high[at] * 100 >= size * percent) & (low[at] * percent <= size * 100)
            bound = np.minimum(top[at], point).sum(axis=1)
            least = least_overlap(size + np.maximum(low[at], -(-size * percent // 100)), percent)
            at = at[fits & (bound >= least)]
            if not len(at):
                return at
        if self.levels:
            width = self.levels[0][3]
            at = (at[:, None] * width + np.arange(width)).ravel()
            at = at[at < len(self.sizes)]
        keep = np.minimum(self.points[at], point).sum(axis=1) >= least_overlap(size + self.sizes[at], percent)
        return self.order[at[keep]]


def _packed(found: np.ndarray) -> bytes:
    """The set's point in bytes; 255 stands for that many or more."""
    return np.minimum(counts(found, groups_of(len(found))), 255).astype(np.uint8).tobytes()


class _Points:
    """Packed points of several resolutions."""

    def __init__(self, column: pa.Array):
        self.rows = column.to_pylist()
        self.groups = np.array([len(r) for r in self.rows], np.int64)

    def at(self, which: np.ndarray, groups: int) -> np.ndarray:
        """The points ``which``, all of ``groups`` groups or twice as many, at ``groups`` groups."""
        out = np.zeros((len(which), groups), np.int64)
        for size in (groups, 2 * groups):
            if len(own := np.flatnonzero(self.groups[which] == size)):
                raw = np.frombuffer(b"".join([self.rows[k] for k in which[own]]), np.uint8).reshape(len(own), size).astype(np.int64)
                raw[raw == 255] = 1 << 40
                out[own] = raw if size == groups else raw.reshape(len(own), groups, 2).sum(axis=2)
        return out

    def bounds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The most that the sets of each pair can share. Sizes of a pair are so close that their groups are the same or
        twice as many."""
        out = np.zeros(len(i), np.int64)
        low = np.minimum(self.groups[i], self.groups[j])
        for g in np.unique(low):
            for a in range(0, len(own := np.flatnonzero(low == g)), 200_000 * FEWEST // g or 1):
                some = own[a : a + (200_000 * FEWEST // g or 1)]
                out[some] = np.minimum(self.at(i[some], int(g)), self.at(j[some], int(g))).sum(axis=1)
        return out


#: Counters of the sketch (a power of two), the rows they travel in, and how many of those one task adds up.
SKETCH, CHUNKS, FAN = 1 << 22, 64, 64


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """For each counter of the sketch how far it is above the mean, in steps of two standard deviations of a random
    count, up to 15: the higher, the more documents its shingles are in.

    Every document's distinct shingles are counted. The counters are of a fixed number and merged ``FAN`` parts at a
    time, so neither a task nor the driver holds more at any size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in small_batches(batches, text):
            found = np.sort(np.concatenate([np.zeros(0, _U), *shingle_sets(t.as_py() for t in batch.column(text))]) >> _U(42))
            at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
            total[found[at].astype(np.int64)] += np.diff(np.r_[at, len(found)])
        part = TaskContext.get().partitionId()
        rows = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(total, CHUNKS)]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "part": pa.array([part] * CHUNKS, pa.int32()), "counts": pa.array(rows, pa.binary())})

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int64) for x in group.column("counts"))
        row = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([row], pa.binary())})

    schema = "chunk int, part int, counts binary"
    step = docs.select(text).mapInArrow(count, schema)
    while True:
        step = materialise(step.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("chunk", "part").applyInArrow(add, schema), "sketch", TEXTS)
        if step.agg(F.max("part")).first()[0] in (0, None):
            break
    rows = {r["chunk"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), np.int64) for r in step.collect()}
    discard(step)
    total = np.concatenate([rows[k] for k in range(CHUNKS)]) if rows else np.zeros(SKETCH, np.int64)
    mean = total.mean()
    return np.clip((total - mean) / (2 * np.sqrt(mean) + 1), 0, 15).astype(np.uint8)


def most_apart(total: int, percent: int) -> int:
    """The most elements in which linked sets of ``total`` elements together can differ."""
    return total * (100 - percent) // (100 + percent)


def bands_of(low: int, percent: int) -> int:
    """How many bands sets of the size class from ``low`` on are cut into; 0: every shingle is a unit. So many that sets
    of the class have more bands with shingles than they can differ in, by seven standard deviations or more."""
    return 0 if low < 32 or percent < 80 else 3 * low // 2 if low < 64 else low if low < 128 else 2 * low // 3


def _units(found: np.ndarray, common: np.ndarray, low: int, first: int, percent: int) -> np.ndarray:
    """The ``first`` units of a set for the size class from ``low`` on, as hashes."""
    salt = _U(low * int(_MUL[4]) & 0xFFFFFFFFFFFFFFFF)
    bands = bands_of(low, percent)
    if not bands:
        return _mixed(found[np.argsort(common, kind="stable")[:first]] + salt)
    band = ((found >> _U(32)) * _U(bands)) >> _U(32)  # ascends with the hash
    at = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    size = np.diff(np.r_[at, len(found)])
    take = np.lexsort((-size, np.minimum.reduceat(common, at)))[:first]
    return _mixed(np.add.reduceat(_mixed(found ^ _MUL[3]), at)[take] + band[at][take] * _MUL[2] + salt)


def units(found: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The units that deal a set to buckets. ``common``: of each shingle, in steps that all sets agree on."""
    n = len(found)
    low, longest = 1 << (n.bit_length() - 1), n * 100 // percent
    if longest == n:  # only equal sets are similar enough
        return np.zeros(0, _U)
    out = _units(found, common, low, most_apart(n + min(longest, 2 * low - 1), percent) + 1, percent)
    if longest < 2 * low:
        return out
    apart = most_apart(n + min(longest, 4 * low - 1), percent)
    return np.concatenate([out, _units(found, common, 2 * low, apart + 1, percent)])


def _signatures(rows: DataFrame, percent: int) -> DataFrame:
    """(id, key, n, kind, point, units) of every row of (id, key, text)."""
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            n, kind, points, first = [], [], [], []
            for s in shingle_sets(t.as_py() for t in batch.column("text")):
                n.append(len(s))
                kind.append(xxhash.xxh3_128_digest(s.tobytes()))
                points.append(_packed(s) if len(s) else None)
                first.append(units(s, common.value[(s >> _U(42)).astype(np.int64)], percent).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(kind, pa.binary()), pa.array(points, pa.binary()), pa.array(first, pa.list_(pa.int64()))],
                names=["id", "key", "n", "kind", "point", "units"],
            )

    return rows.mapInArrow(run, "id long, key long, n long, kind binary, point binary, units array<long>")


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, list]]:
    """Rows of a partition sorted by bucket, in pieces that end where a bucket ends: (starts of buckets, columns)."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch]).select(columns)
        held = pa.concat_tables([held, part]) if held is not None and held.num_rows else part
        key = held.column("bucket").to_numpy()
        if not len(key) or key[0] == key[-1]:
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield _split(held.slice(0, cut))
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _split(held)


def _split(rows: pa.Table) -> tuple[np.ndarray, list]:
    rows = rows.combine_chunks()
    key = rows.column("bucket").to_numpy()
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), [rows.column(c).combine_chunks() for c in rows.column_names]


def _shared_buckets(tokens: DataFrame) -> DataFrame:
    """(bucket, lead, node) of the buckets with two or more nodes, from (bucket, node) sorted by both; lead: the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: bucket, node, its bucket's lead, how many other nodes the bucket had
        for batch in batches:
            key, node = batch.column("bucket").to_numpy(), batch.column("node").to_numpy()
            if not len(key):
                continue
            new = np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]]
            fresh = new | np.r_[last is None or node[0] != last[1], node[1:] != node[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))  # where the bucket starts; -1: in a batch before
            lead = np.where(at < 0, last[2] if last else 0, node[np.maximum(at, 0)])
            others = np.cumsum(fresh & ~new)
            others -= np.where(at < 0, -(last[3] if last else 0), others[np.maximum(at, 0)])
            member = fresh & ~new
            second = member & (others == 1)
            rows = [np.concatenate([x[member], x[second]]) for x in (key, lead)] + [np.concatenate([node[member], lead[second]])]
            last = key[-1], node[-1], lead[-1], others[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["bucket", "lead", "node"])

    return tokens.mapInArrow(run, "bucket long, lead long, node long")


def _near(n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent


def _lead_pairs(shared: DataFrame, parts: DataFrame | None, asked: DataFrame | None) -> DataFrame:
    """(a, b): each node b with the leader a of another part that it shares most buckets with, of those not asked yet: one
    pair a node, however many buckets and members there are."""
    rows = shared.where("lead <> node")
    if parts is not None:
        of = lambda x: parts.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}"))
        rows = rows.join(of("lead"), "lead", "left").join(of("node"), "node", "left")
        rows = rows.where(F.coalesce("part_lead", "lead") != F.coalesce("part_node", "node"))
    if asked is not None:
        rows = rows.join(asked.select(F.col("a").alias("lead"), F.col("b").alias("node")), ["lead", "node"], "left_anti")
    return rows.groupBy(F.col("node").alias("b")).agg(F.mode("lead", True).alias("a")).select("a", "b")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points let them reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "pb"):
            m = batch.num_rows
            n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            i, j = np.arange(m), np.arange(m, 2 * m)
            keep = np.flatnonzero(_near(n, i, j, percent))
            held = _Points(pa.concat_arrays([batch.column("pa"), batch.column("pb")]))
            keep = keep[held.bounds(i[keep], j[keep]) >= least_overlap(n[i[keep]] + n[j[keep]], percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep))

    of = lambda x: points.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a")
    return joined.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _mixed_blocks(shared: DataFrame, parts: DataFrame, most: int, leaf: int = 16) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, part, role) of the buckets with members of several parts, and the written table that it reads. role: 0
    is held by the tree, 1 searches it, 2 both. All search but a bucket's main part, which has most members in it.

    Buckets of one main part are searched as one, so that sets that share many buckets meet once: where they have no more
    than ``most`` members together, or more than ``leaf`` each. Beyond ``most`` members these are cut into blocks of about
    as many held and as many searching ones, a block for each pair of cuts. Small buckets of a large main part stay alone.
    """
    placed = shared.join(parts, "node", "left").select("bucket", "node", F.coalesce("part", "node").alias("part"))
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "part")).alias("main"))
    mixed = sizes.where("parts > 1").select("bucket", "size", F.col("main.part").alias("main"))
    rows = materialise(placed.join(mixed, "bucket").select("bucket", "node", "part", "main", (F.col("size") > leaf).alias("large")), "mixed")
    seeks = F.col("part") != F.col("main")
    each = rows.groupBy("main", "node", "part").agg(F.max("large").alias("large"))
    total = each.groupBy("main").agg(F.count(F.lit(1)).alias("all"), F.count_if("large").alias("size"), F.count_if(F.col("large") & seeks).alias("seeking"))
    each = each.join(total, "main")
    both = F.when(seeks, 2).otherwise(0).alias("role")
    once = each.where(F.col("all") <= most).select(F.xxhash64(F.lit("main"), "main").alias("bucket"), "node", "part", both)
    alone = rows.where("not large").join(total.where(F.col("all") > most), "main").select("bucket", "node", "part", both)
    many = each.where((F.col("all") > most) & F.col("large"))
    cuts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(most)).cast("int"))
    cut = lambda n: F.pmod(F.xxhash64("node", "main"), cuts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), cuts(n) - 1))
    held = many.withColumn("j", cut("size")).withColumn("i", every("seeking")).withColumn("role", F.lit(0))
    seek = many.where(seeks).withColumn("i", cut("seeking")).withColumn("j", every("size")).withColumn("role", F.lit(1))
    own = F.xxhash64("main", "i", "j").alias("bucket")
    return reduce(DataFrame.unionByName, [once, alone, *[x.select(own, "node", "part", "role") for x in (held, seek)]]), rows


def _tree_pairs(blocks: DataFrame, percent: int, leaf: int = 16) -> DataFrame:
    """(a, b): pairs of a block's members in different parts that the tree's bound lets reach the threshold."""
    names = ["bucket", "node", "part", "role", "n", "point"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, node, part, role, n, point) in _runs(batches, names):
            node, part, role, n, points = node.to_numpy(), part.to_numpy(), role.to_numpy(), n.to_numpy(), _Points(point)
            found = [np.zeros((0, 2), np.int64)]

            def told(i: np.ndarray, j: np.ndarray, node: np.ndarray = node, found: list = found) -> None:
                found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))

            ends = np.r_[starts[1:], len(node)]
            one_leaf = ends - starts <= leaf
            if one_leaf.any():  # trees of one leaf have no nodes to prune: their members' bounds, all of them at once
                sizes = (ends - starts)[one_leaf]
                pair_i, pair_j = [], []
                for m in np.unique(sizes):
                    x, y = np.triu_indices(m, 1)
                    base = starts[one_leaf][sizes == m][:, None]
                    pair_i.append((base + x).ravel())
                    pair_j.append((base + y).ravel())
                i, j = np.concatenate(pair_i), np.concatenate(pair_j)
                ok = (part[i] != part[j]) & _near(n, i, j, percent)
                i, j = i[ok], j[ok]
                ok = points.bounds(i, j) >= least_overlap(n[i] + n[j], percent)
                told(i[ok], j[ok])
            for a, b in zip(starts[~one_leaf], ends[~one_leaf], strict=True):
                own = np.arange(a, b)
                held, seek = own[role[own] != 1], own[role[own] != 0]
                for g in np.unique(points.groups[held]):
                    inside = held[points.groups[held] == g]
                    for coarse, of in ((g // 2, (g // 2,)), (g, (g, 2 * g))):  # sizes so close that groups are the same or twice as many
                        asks = seek[np.isin(points.groups[seek], of)]
                        if not len(asks):
                            continue
                        tree, at = CountTree(n[inside], points.at(inside, int(coarse)), leaf), points.at(asks, int(coarse))
                        for k, q in enumerate(asks):
                            near = inside[tree.partners(int(n[q]), at[k], percent)]
                            near = near[part[near] != part[q]]
                            told(np.full(len(near), q), near)
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select(*names).mapInArrow(run, "a long, b long").distinct()


def _sieve(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit map of ``bits`` bits with one set for each key: of a fixed size, whatever the number of keys."""
    slot = F.pmod(F.col("key"), F.lit(bits))
    rows = keys.select((slot / 32).cast("long").alias("k"), F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 32 as int))").alias("v")).groupBy("k").agg(F.bit_or("v").alias("v"))
    out = np.zeros(bits // 32, np.uint32)
    for r in rows.toLocalIterator():
        out[r["k"]] = r["v"]
    return out


def _sets(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node, kind, key): a bit map of fixed size keeps most other rows from
    being read into sets, the join drops the rest."""
    sieve = rows.sparkSession.sparkContext.broadcast(_sieve(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((sieve.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            for some in small_batches([batch], "text") if batch.num_rows else ():
                made = [s.tobytes() for s in shingle_sets(t.as_py() for t in some.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in made], pa.binary()), pa.array(made, pa.binary())], names=["kind", "shingles"])

    slotted = rows.select(F.pmod(F.col("key"), F.lit(bits)).alias("slot"), "text")
    some = slotted.mapInArrow(run, "kind binary, shingles binary")
    return some.join(wanted.select("node", "kind"), "kind").select("node", "shingles").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "sb"):
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(p) + len(q) - len(distinct(np.concatenate([p, q])))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = joined.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _release(spark: SparkSession, *frames: DataFrame) -> None:
    """Drop tables that nobody reads any more, and let Spark remove the shuffle files of finished steps."""
    for df in frames:
        discard(df)
    gc.collect()
    spark._jvm.System.gc()


def _key(doc_id: str, text: str) -> Column:
    """Tells rows of one id, or without one, apart by their texts."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def _labelled(docs: DataFrame, doc_id: str, text: str, percent: int, bits: int, most: int) -> DataFrame:
    """The written table (id, key, n, component) with a row for each of ``docs``. key: of id and text. component: a number
    that linked rows share and others don't, null for rows without shingles."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), _key(doc_id, text).alias("key"), F.col(text).cast("string").alias("text"))
    signed = materialise(_signatures(rows, percent), "signatures", TEXTS)
    named = materialise(signed.select("id", "key", "n", "kind"), "rows")
    kinds = signed.where("n > 0").groupBy("kind").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "point", "units")])
    kinds = materialise(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")  # written, so numbers stay
    _release(spark, signed)
    tokens = kinds.select("node", F.explode("units").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "node")
    shared = materialise(_shared_buckets(tokens), "shared")
    del tokens
    points = kinds.select("node", "n", "point")
    made, asked, links, parts = [], None, None, None
    for step in (*["lead"] * ROUNDS, "tree"):
        if step == "lead":
            pairs = materialise(_lead_pairs(shared, parts, asked), "asked")
            asked = pairs if asked is None else asked.unionByName(pairs)
            found = materialise(_bounded(pairs, points, percent), "pairs")
            made += [pairs, found]
        else:
            blocks, mixed = _mixed_blocks(shared, points.select("node", F.col("node").alias("part")) if parts is None else parts, most)
            found = materialise(_tree_pairs(blocks.join(points, "node"), percent).join(asked, ["a", "b"], "left_anti"), "pairs")
            made += [found, mixed]
        _release(spark)
        if found.isEmpty():
            continue
        ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialise(kinds.select("node", "kind", "key").join(ends, "node", "left_semi"), "wanted")
        sets = materialise(_sets(rows, wanted, bits), "sets", TEXTS)
        good = materialise(_verified(found, sets, percent), "links", TEXTS)
        links = good if links is None else links.unionByName(good)
        _release(spark, sets, wanted)
        parts = connected_components(links, "a", "b").select("node", F.col("component").alias("part"))
        made += [good, parts]
    out = named.join(kinds.select("kind", "node"), "kind", "left")
    if parts is not None:
        out = out.join(parts, "node", "left").withColumn("node", F.coalesce("part", "node"))
    out = materialise(out.select("id", "key", "n", F.when(F.col("n") > 0, F.col("node")).alias("component")), "components")
    _release(spark, named, kinds, shared, *made)
    return out


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, bits: int = 1 << 26, most: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, component) for every row of ``docs``.

    Two texts link when 100 * intersection >= percent * union of their sets (percent: 50 to 100); component_id is the
    smallest id that links reach, the row's own included. component is a number that linked rows share and no others: ids
    that repeat over different texts have a component for each, so it tells apart what component_id may not. Null and empty
    texts have no shingles, no component, and link with nothing but themselves. Rows without an id link like others;
    component_id is null where no linked row has one. Ids are long integers. Very long texts are read whole. Other columns
    of ``docs`` are not read, whatever their names. An empty table gives no rows. Sets are told apart by 64-bit shingle and
    128-bit set hashes. ``bits`` is the size of the bit map that spares reading candidate-free texts again: 8 MB at the
    default. ``most``: members that a tree holds at once.
    """
    rows = _labelled(docs, doc_id, text, percent, bits, most)
    first = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = rows.join(first, "component", "left")
    label = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), label.alias("component_id"), "component")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, bits: int = 1 << 26, most: int = 512) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id (rows without one come
    last; of different texts of that id the one with the least hash), once if it is repeated. Rows without words link with
    nothing and all stay."""
    rows = _labelled(docs, doc_id, text, percent, bits, most)
    best = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("best"))
    key, row = free_name(docs, "_key"), F.col(text).cast("string")
    blank = F.btrim(F.coalesce(row, F.lit("")), F.lit(WHITE)) == ""
    keyed = docs.withColumn(key, _key(doc_id, text))
    first = best.select(F.col("best.id").alias("_first_id"), F.col("best.key").alias("_first_key"))
    same = (keyed[key] == first["_first_key"]) & keyed[doc_id].cast("long").eqNullSafe(first["_first_id"])
    kept = keyed.where(~blank).join(first, same, "left_semi").dropDuplicates([key, doc_id])
    return kept.unionByName(keyed.where(blank)).select(*[F.col(f"`{c}`") for c in docs.columns])
