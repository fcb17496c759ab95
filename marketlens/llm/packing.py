"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Pieces of equal length are alike, so the plan is made on how many pieces of each length there are: at most as many
counts as a sequence has tokens, whatever the corpus holds. A sequence is filled greedily with the longest piece that
still fits; then its smallest piece is exchanged for two unpacked ones if they fill the gap it leaves more tightly. A
found pattern is repeated while its lengths last. Pieces then take the plan's places in the order of their rank.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import word_level
from .common import TEXTS, materialise, small_batches


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


def plan(counts: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that use up ``counts`` (pieces of each length from 1 to ``size``)."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out: list[Pattern] = []

    def longest(limit: int, used: Counter) -> int:
        """The longest length up to ``limit`` with a piece that the sequence being filled doesn't use; 0 if none."""
        at = bisect.bisect_right(lengths, limit)
        while at:
            at -= 1
            if left[lengths[at]] > used[lengths[at]]:
                return lengths[at]
        return 0

    while lengths:
        used: Counter = Counter()
        gap, chosen = size, []
        while gap and (n := longest(gap, used)):
            chosen.append(n)
            used[n] += 1
            gap -= n
        if gap and len(chosen) > 1:
            small = chosen[-1]
            used[small] -= 1
            best = small
            pair: tuple[int, int] | None = None
            for a in reversed(lengths[: bisect.bisect_right(lengths, gap + small - 1)]):
                if 2 * a <= best:
                    break
                if left[a] <= used[a]:
                    continue
                used[a] += 1
                b = longest(min(a, gap + small - a), used)
                used[a] -= 1
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == gap + small:
                        break
            chosen[-1:] = pair or (small,)
            used = Counter(chosen)
        times = min(left[n] // c for n, c in used.items())
        out.append(Pattern(tuple(chosen), times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                lengths.pop(bisect.bisect_left(lengths, n))
    return out


class Places:
    """For the k-th piece of a length: its sequence and its place there."""

    def __init__(self, patterns: list[Pattern]):
        rows: dict[int, list[tuple[int, int, list[int]]]] = {}
        sequence = 0
        for p in patterns:
            offsets: dict[int, list[int]] = {}
            at = 0
            for n in p.lengths:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, places in offsets.items():
                rows.setdefault(n, []).append((sequence, p.times, places))
            sequence += p.times
        self.sequences = sequence
        self.tables = {}
        for n, entries in rows.items():
            starts = np.cumsum([0] + [t * len(o) for _, t, o in entries])
            self.tables[n] = (starts, np.array([s for s, _, _ in entries]), [o for _, _, o in entries])

    def of(self, length: int, rank: int) -> tuple[int, int]:
        starts, first, offsets = self.tables[length]
        k = int(np.searchsorted(starts, rank, side="right")) - 1
        turn, which = divmod(rank - int(starts[k]), len(offsets[k]))
        return int(first[k]) + turn, offsets[k][which]


def pieces(docs: DataFrame, tokenizer: str, size: int, end: int, doc_id: str, text: str, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, part, rank): each document's ids and ``end``, cut after every ``size`` ids.
    ids: little-endian unsigned 32-bit integers, null unless asked for. rank: of the piece among those of its length in its
    part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, seen = TaskContext.get().partitionId(), word_level(tokenizer), Counter()
        stop, names = np.array([end], "<u4").tobytes(), ("at", "piece", "start", "length", "crc", "ids", "rank")
        for batch in small_batches(batches, text):
            rows: dict[str, list] = {k: [] for k in names}
            for k, ids in enumerate(encoder.encode(batch.column(text).to_pylist())):
                ids += stop
                for number, a in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[a : a + 4 * size]
                    n = len(cut) // 4
                    for name, v in zip(names, (k, number, a // 4, n, zlib.crc32(cut), cut if with_ids else None, seen[n]), strict=True):
                        rows[name].append(v)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()),
                    pa.array(rows["length"], pa.int64()), pa.array(rows["crc"], pa.int64()), pa.array(rows["ids"], pa.binary()), pa.array([part] * len(rows["at"]), pa.int32()), pa.array(rows["rank"], pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"],
            )

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias(text))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): every piece of every document with its place.

    ids are little-endian unsigned 32-bit integers, ids_crc32 their checksum. Where only places are asked for
    (``with_ids`` false), ids is left out and no id is written or shuffled. Null and empty texts are the end id alone. Only
    documents of more than ``size`` ids are cut, very long ones into many pieces; their last piece may be shorter.
    Sequences have no gap between pieces and at most ``size`` ids. Pieces of one length take their places in the order of
    their part of the table. Repeated rows are packed each, null ids are kept, other columns of ``docs`` are not read
    whatever their names; an empty table gives no rows. The piece table is written once, ranks come from counts per part
    and length, so no length, however common, is gathered in one task; the plan has a bound that ``size`` sets.
    """
    made = materialise(pieces(docs, tokenizer, size, end, doc_id, text, with_ids), "pieces", TEXTS)
    each = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column("rank").to_numpy() + batch.column("first").to_numpy()
            found = [places.value.of(n, k) for n, k in zip(batch.column("length").to_pylist(), ranks.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                names=[*kept, "sequence_id", "offset"],
            )

    kept = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = made.join(offsets, ["part", "length"]).select(*kept, "rank", "first")
    schema = ranked.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def fewest(total: int, size: int) -> int:
    """No packing of ``total`` ids uses fewer sequences."""
    return math.ceil(total / size)
