"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

Each block starts from nothing. Three predictions are mixed: the id last seen after the two ids before (order 2), the one
last seen after the id before (order 1), and the counts of the ids that neither foretold, over a prior that falls with the
id, as vocabularies list frequent pieces first (order 0). How far the two candidates have held lately, and whether they
agree, picks adaptive weights: counts of how often order 2, order 1 and neither was right there. A range coder writes which
of them is right, and, where neither is, the id by order 0.

A block is cut into lanes of ``STEPS`` ids, each with a range coder of its own. Every step codes one id of each lane,
vectorised over lanes, by one model that has seen all lanes up to the step before; of ids that lanes put into one place of
it in a step, the last lane's stays. Counts and weights turn into ranges of fixed sums (``_COUNTED``, ``_WEIGHED``) from
time to time, so that a step divides by none of them: counts when half as many more ids have been seen, weights every
``_EVERY`` steps.

A frame is ``MAGIC``, the counts of documents, ids and blocks, the ids before it and the bound of its ids (a multiple of
4096), then document ids (signed 64-bit) and lengths (unsigned 64-bit), then for each block its number of ids, checksum
(crc32 of the ids as little-endian unsigned 32-bit integers) and number of words, then all blocks' 16-bit words: of each
lane how many words it has, then the lanes' words. All integers are little-endian.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import EndedTexts
from .common import TEXTS, gathered_batches, materialise, small_batches
from .ordered import LOWEST, dealt_by, parts_by_id, parts_for

MAGIC = b"IDX3"
BLOCK, STEPS = 1 << 21, 1024
_SCALE = 1 << 16  # ids are below this
_U = np.uint64
_TOP, _WORD = _U(1 << 48), _U(16)
#: Bits of the sums of order 0's ranges, of the weights', and of both.
_COUNTED, _WEIGHED = 20, 12
_BOTH = _U(_COUNTED + _WEIGHED)
#: What an id seen adds to its count, and the prior's share that falls with the id.
_STEP, _PRIOR, _EARLY = 600, 16_384, 512
#: Steps between new weights, bits of order 2's contexts, and bits of how often a candidate has held.
_EVERY, _PLACES, _HELD = 32, 18, 2
_SURE = (1 << _HELD) - 1


class _Counts:
    """Order 0: the counts of ids, as ranges that sum up to ``1 << _COUNTED``, each of 1 at least."""

    def __init__(self, bound: int, decoding: bool):
        self.bound, self.decoding = bound, decoding
        self.counts = 1 + _PRIOR // (np.arange(bound) + _EARLY)
        self.raise_by(np.zeros(0, np.int64))

    def raise_by(self, ids: np.ndarray) -> None:
        """Count ids; those that equal the bound don't count."""
        self.counts += np.bincount(ids, minlength=self.bound + 1)[: self.bound] * _STEP
        sums = self.counts.cumsum()
        upto = sums * ((1 << _COUNTED) - self.bound) // sums[-1] + np.arange(1, self.bound + 1)
        self.starts = np.concatenate(([0], upto[:-1]))
        self.widths = upto - self.starts
        if self.decoding:
            self.ids = np.repeat(np.arange(self.bound, dtype=np.uint16), self.widths)


def _cells() -> tuple[np.ndarray, ...]:
    """For each cell of the weights (whether the candidates differ, how often order 2 has held, how often order 1) and case
    how often order 2 and order 1 have held after it; and for each cell the cases that can be."""
    cell = np.repeat(np.arange(2 << 2 * _HELD), 3)
    case, other, held2, held1 = np.tile([0, 1, 2], len(cell) // 3), cell >> 2 * _HELD, cell >> _HELD & _SURE, cell & _SURE
    next2 = np.where(case == 0, np.minimum(held2 + 1, _SURE), 0) << _HELD
    next1 = np.where((case == 1) | (case + other == 0), np.minimum(held1 + 1, _SURE), 0)
    return next2, next1, ((case != 1) | (other == 1)).reshape(-1, 3)


_NEXT2, _NEXT1, _CAN = _cells()


class _Model:
    """The adaptive state of a block. A candidate is kept as its id, then ``_HELD`` bits each of how often it has held as
    order 2's and as order 1's; what was never seen foretells id 0."""

    def __init__(self, lanes: int, bound: int, decoding: bool):
        self.o1, self.o2 = np.zeros(_SCALE, np.int64), np.zeros(1 << _PLACES, np.int64)
        self.p1, self.p2, self.step = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), 0
        self.counts, self.bound = _Counts(bound, decoding), bound
        self.lanes, self.due = lanes, lanes
        self.missed: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.right = np.full(_CAN.shape, 2, np.int64)
        self.weigh()

    def weigh(self) -> None:
        """New ranges of the weights: of each cell where those of order 2, order 1 and neither start, and how wide they are."""
        if self.keys:
            self.right += np.bincount(np.concatenate(self.keys), minlength=self.right.size).reshape(-1, 3) * 8
            self.keys.clear()
            self.right = np.where(self.right.sum(axis=1, keepdims=True) > 1 << 18, (self.right + 1) >> 1, self.right)
        sums, least = np.where(_CAN, self.right, 0).cumsum(axis=1), _CAN.cumsum(axis=1)
        upto = sums * ((1 << _WEIGHED) - least[:, 2:]) // sums[:, 2:] + least
        starts = np.concatenate([np.zeros((len(upto), 1), np.int64), upto[:, :2]], axis=1)
        widths = upto - starts
        self.w0 = widths[:, 2].astype(_U)
        self.starts, self.from1, self.from0 = (starts << _COUNTED).ravel(), (starts[:, 1] << _COUNTED).astype(_U), (starts[:, 2] << _COUNTED).astype(_U)
        # a range is a case's own width, or a multiple of order 0's where neither is right
        self.times = np.where([False, False, True], widths, 0).ravel()
        self.widths = (np.where([True, True, False], widths, 0) << _COUNTED).ravel()

    def predict(self, k: int) -> None:
        """For the first ``k`` lanes the candidates ``c2`` and ``c1`` and the cell of the weights."""
        self.at1 = self.p1[:k]
        self.at2 = at2 = self.at1 * 40503
        at2 += self.p2[:k]
        at2 &= (1 << _PLACES) - 1
        e1, e2 = self.o1.take(self.at1), self.o2.take(at2)
        self.cell = cell = e1 | e2
        cell &= (1 << 2 * _HELD) - 1
        e1 >>= 2 * _HELD
        e2 >>= 2 * _HELD
        other = (e1 != e2).astype(np.int64)
        other <<= 2 * _HELD
        cell |= other
        self.c1, self.c2 = e1, e2

    def ranges(self, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the range of each lane's case and id starts, and how wide it is."""
        times = self.times.take(key)
        start, width = self.counts.starts.take(ids), self.counts.widths.take(ids)
        start *= times
        width *= times
        start += self.starts.take(key)
        width += self.widths.take(key)
        return start.view(_U), width.view(_U)

    def key(self, case: np.ndarray) -> np.ndarray:
        """The place of each lane's cell and case: 0, 1 or 2 where order 2, order 1 or neither is right."""
        key = self.cell * 3
        key += case
        return key

    def update(self, ids: np.ndarray, key: np.ndarray, none: np.ndarray) -> None:
        """``none``: where neither was right."""
        k = len(ids)
        self.keys.append(key)
        self.missed.append(np.where(none, ids, self.bound))
        fresh = ids << 2 * _HELD
        self.o1[self.at1] = _NEXT1.take(key) + fresh
        fresh += _NEXT2.take(key)
        self.o2[self.at2] = fresh
        self.p2[:k] = self.p1[:k]
        self.p1[:k] = ids
        self.step += 1
        if self.step % _EVERY == 0 or self.step < _EVERY:
            self.weigh()
        if self.step * self.lanes >= self.due:
            self.counts.raise_by(np.concatenate(self.missed))
            self.missed.clear()
            self.due = self.step * self.lanes * 3 // 2


def bound_of(ids: np.ndarray) -> int:
    """The least multiple of 4096 above all ids."""
    top = int(ids.max()) if len(ids) else 0
    if top >= _SCALE:
        raise ValueError("ids must be below 65536")
    return (top // 4096 + 1) * 4096


def _lanes(n: int) -> tuple[int, int, int]:
    """Of a block of ``n`` ids: the lanes, the steps, and how many of the lanes have an id in the last step. All have one in
    each step before."""
    steps = min(n, STEPS)
    lanes = -(-n // steps)
    steps = -(-n // lanes)
    return lanes, steps, n - (steps - 1) * lanes


def _encode(ids: np.ndarray, bound: int) -> np.ndarray:
    """A block's words."""
    lanes, steps, last = _lanes(len(ids))
    model = _Model(lanes, bound, False)
    low, span = np.zeros(lanes, _U), np.full(lanes, _U(0xFFFFFFFFFFFFFFFF))
    # a row for each word of the lanes, as lanes are about equally far
    words, at = np.zeros((steps * 2 + 8) * lanes, np.uint16), np.arange(lanes)
    grid = _grid(ids.astype(np.uint16), lanes, steps, last)
    for t in range(steps):
        k = lanes if t < steps - 1 else last
        value = grid[t, :k].astype(np.int64)
        model.predict(k)
        case = (model.c2 != value).view(np.int8)
        none = case.view(bool) & (model.c1 != value)
        key = model.key(case + none.view(np.int8))
        start, width = model.ranges(key, value)
        unit = span[:k] >> _BOTH
        start *= unit
        low[:k] += start
        carry = low[:k] < start
        if carry.any():
            over = at[:k][carry] - lanes
            while len(over):  # a carry goes into the words before
                words[over] += np.uint16(1)
                over = over[words[over] == 0] - lanes
        np.multiply(width, unit, out=span[:k])
        # every lane puts its next word down, and keeps it where its range got narrow
        by = (span < _TOP).astype(np.int64)
        words[at] = low >> _U(48)
        at += by * lanes
        by = by.view(_U) << _U(4)
        low <<= by
        span <<= by
        out = np.flatnonzero(span < _TOP)
        while len(out):
            high, place = low[out], at[out]
            words[place] = high >> _U(48)
            at[out] = place + lanes
            low[out] = high << _WORD
            span[out] = wide = span[out] << _WORD
            out = out[wide < _TOP]
        model.update(value, key, none)
    for _ in range(4):
        words[at] = low >> _U(48)
        at += lanes
        low <<= _WORD
    sizes = at // lanes
    rows = words.reshape(-1, lanes)[: sizes.max()].T
    return np.concatenate([sizes.astype(np.uint16), rows[np.arange(rows.shape[1]) < sizes[:, None]]])


def _grid(ids: np.ndarray, lanes: int, steps: int, last: int) -> np.ndarray:
    """A row for each step: lanes are runs of ids, of ``steps`` ids the first ``last`` and of one less the others."""
    grid = np.zeros((lanes, steps), ids.dtype)
    grid[:last] = ids[: last * steps].reshape(last, steps)
    grid[last:, : steps - 1] = ids[last * steps :].reshape(lanes - last, steps - 1)
    return np.ascontiguousarray(grid.T)


def _decode(n: int, words: np.ndarray, bound: int) -> np.ndarray:
    """The ids of a block; ValueError where the lanes' words don't fit. A damaged block gives wrong ids."""
    lanes, steps, last = _lanes(n)
    sizes = words[:lanes].astype(np.int64)
    if len(sizes) < lanes or sizes.min() < 4 or lanes + sizes.sum() != len(words):
        raise ValueError("a damaged block of token ids")
    model, words = _Model(lanes, bound, True), words.astype(np.uint16)
    at = lanes + sizes.cumsum() - sizes
    span, code = np.full(lanes, _U(0xFFFFFFFFFFFFFFFF)), np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _WORD) | words.take(at)
        at += 1
    grid = np.zeros((steps, lanes), np.uint16)
    for t in range(steps):
        k = lanes if t < steps - 1 else last
        model.predict(k)
        unit = span[:k] >> _BOTH
        place = code[:k] // unit
        from0 = model.from0.take(model.cell)
        not2, none = place >= model.from1.take(model.cell), place >= from0
        place -= from0
        place //= model.w0.take(model.cell)
        value = np.where(none, model.counts.ids.take(place.view(np.int64), mode="clip"), np.where(not2, model.c1, model.c2))
        key = model.key(not2.view(np.int8) + none.view(np.int8))
        start, width = model.ranges(key, value)
        start *= unit
        code[:k] -= start
        np.multiply(width, unit, out=span[:k])
        by = (span < _TOP).astype(np.int64)
        further = words.take(at, mode="clip") * by
        at += by
        by = by.view(_U) << _U(4)
        code <<= by
        code |= further.view(_U)
        span <<= by
        out = np.flatnonzero(span < _TOP)
        while len(out):
            place = at[out]
            code[out] = (code[out] << _WORD) | words.take(place, mode="clip")
            at[out] = place + 1
            span[out] = wide = span[out] << _WORD
            out = out[wide < _TOP]
        grid[t, :k] = value
        model.update(value, key, none)
    whole = grid.T
    return np.concatenate([whole[:last].ravel(), whole[last:, : steps - 1].ravel()]).astype("<u4")


def encode_blocks(ids: np.ndarray, block: int = BLOCK, bound: int = _SCALE) -> list[tuple[int, int, np.ndarray]]:
    """(ids, crc32, words) of each of the blocks, all of about ``block`` ids below ``bound``."""
    if bound_of(ids) > bound:
        raise ValueError(f"ids must be below {bound}")
    if not len(ids):
        return []
    parts = np.array_split(np.asarray(ids), max(1, round(len(ids) / block)))
    return [(len(part), zlib.crc32(part.astype("<u4").tobytes()), _encode(part, bound)) for part in parts]


def decode_blocks(blocks: list[tuple[int, int, np.ndarray]], bound: int = _SCALE) -> np.ndarray:
    """The ids of blocks that were coded with ``bound``; ValueError where a checksum does not fit."""
    out = [np.zeros(0, "<u4")]
    for i, (n, crc, words) in enumerate(blocks):
        out.append(_decode(n, words, bound) if n else out[0])
        if zlib.crc32(out[-1]) != crc:
            raise ValueError(f"block {i}: the checksum does not fit")
    return np.concatenate(out)


def write_frame(doc_ids: list[int], lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    bound = bound_of(ids)
    blocks = encode_blocks(ids, bound=bound)
    head = struct.pack("<QQQQQ", len(doc_ids), len(ids), len(blocks), before, bound)
    table = b"".join(struct.pack("<III", n, crc, len(w)) for n, crc, w in blocks)
    return MAGIC + head + np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + table + b"".join(w.astype("<u2").tobytes() for *_, w in blocks)


def read_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document ids, lengths, ids, ids before the frame) of a frame; ValueError where it is damaged."""
    if data[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    docs, n, blocks, before, bound = struct.unpack_from("<QQQQQ", data, 4)
    at = 44
    if not 0 < bound <= _SCALE or bound % 4096 or at + 16 * docs + 12 * blocks > len(data):
        raise ValueError("a damaged frame of token ids")
    doc_ids, lengths = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u8", docs, at + 8 * docs)
    at += 16 * docs
    table = [struct.unpack_from("<III", data, at + 12 * k) for k in range(blocks)]
    at += 12 * blocks
    parts = []
    for count, crc, size in table:
        parts.append((count, crc, np.frombuffer(data, "<u2", size, at)))
        at += 2 * size
    ids = decode_blocks(parts, bound)
    if len(ids) != n or int(lengths.sum()) != n:
        raise ValueError("a frame's counts do not fit")
    return doc_ids, lengths, ids, before


def narrowed(ids: np.ndarray) -> bytes:
    """Ids as 16-bit integers; larger ones are an error."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids of 65536 or more do not fit")
    return ids.astype("<u2").tobytes()


@functools.lru_cache(1)
def _encoder(tokenizer: str, end: int) -> EndedTexts:
    """One for all tasks of a Python worker, so that its words are remembered."""
    return EndedTexts(tokenizer, end)


def write_files(docs: DataFrame, tokenizer: str, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table (part, frame, n_ids, data): each document's ids and ``end``, in ascending id order, in frames of
    about ``BLOCK`` ids. A document lies in one frame, a very long one in a frame of its size. Null and empty texts
    are the end id alone; null document ids come first, written as the lowest integer; repeated rows are written each;
    other columns of ``docs`` are not read, whatever their names; an id of 65536 or more is an error; an empty table gives
    no frames."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end)
        for batch in gathered_batches(small_batches(batches, "text"), "text"):
            made = [narrowed(x) for x in encoder.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("key"), pa.array(made, pa.binary())], names=["part", "key", "ids"])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = None, 0, 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def frame() -> pa.RecordBatch:
            nonlocal number, before, size
            ids = np.concatenate([x for _, x in held])
            data = write_frame([k for k, _ in held], [len(x) for _, x in held], ids, before)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "frame": pa.array([number], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})
            number, before, size = number + 1, before + len(ids), 0
            held.clear()
            return out

        for batch in batches:
            for p, key, ids in zip(*(batch.column(c) for c in ("part", "key", "ids")), strict=True):
                if part != p.as_py():
                    if held:
                        yield frame()
                    part, number, before = p.as_py(), 0, 0
                held.append((key.as_py(), np.frombuffer(ids.as_py(), "<u2")))
                size += len(held[-1][1])
                if size >= BLOCK:
                    yield frame()
        if held:
            yield frame()

    placed, parts = parts_by_id(rows, "id", parts_for(docs), "text")
    dealt = placed.select("part", "key", "text").mapInArrow(tokenise, "part int, key long, ids binary")
    dealt = dealt_by(dealt, parts).sortWithinPartitions("part", "key")
    return materialise(dealt.mapInArrow(frames, "part int, frame int, n_ids long, data binary"), "token-files", TEXTS)


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in files: its ids as little-endian unsigned 32-bit integers and
    the number of ids of all documents before it. Each part's total, one number a part, comes to the driver."""
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, at = {}, 0
    for part in sorted(totals):
        first[part], at = at, at + totals[part]
    shared = files.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part"), batch.column("data"), strict=True):
                doc_ids, lengths, ids, before = read_frame(data.as_py())
                lengths = lengths.astype(np.int64)
                starts = lengths.cumsum() - lengths
                cuts = np.append(starts, len(ids)) * 4
                if len(ids) < 1 << 29:
                    made = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids)])
                else:
                    made = pa.array([ids[a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True)], pa.binary())
                keys = [None if k == LOWEST else k for k in doc_ids.tolist()]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts + before + shared.value[part.as_py()]), "n_tokens": pa.array(lengths), "ids": made}
                )

    return files.select("part", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
