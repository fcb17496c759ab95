"""Language-model scoring by prediction by partial matching over bytes.

A text is taken as its words (A-Z lower-cased) joined by single spaces and closed by an end byte, so the model gives
probabilities to the same word sequences that a word model would. Contexts are the last ``order`` bytes down to none. A
context predicts a seen byte by its count over counts plus distinct bytes, and leaves the rest to the next shorter
context (escape by the number of distinct bytes), in which the bytes already excluded have no share (symbol exclusion).
Below the empty context all bytes not excluded are equally likely.

The trie of a corpus does not fit a worker. Documents are dealt to blocks; a block needs the code lengths only of the
grams it holds. Gram counts meet in shards (all contexts with the same three last bytes lie in one), merged over few blocks
at a time, each shard builds its part of the trie, and each block gets the code lengths of its own grams back. Only the
three lowest orders are known everywhere: at most 252 ** 3 grams, whatever the corpus, and some hundred thousand in text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, discard, materialise, small_batches, words_of
from .ordered import dealt_by

END = 10  # a byte that no word holds closes a text
ALPHABET = 252  # byte values without tab, vertical tab, form feed and carriage return
_U = np.uint64
_WORD = _U(1 << 63)


def grams_of(words: list[bytes], order: int) -> np.ndarray:
    """One integer for each byte of the text and its end: the byte (lowest) with the ``order`` bytes before it."""
    data = np.frombuffer(b" " * order + b" ".join(words) + b"\n", np.uint8)
    n = len(data) - order
    out = np.zeros(n, _U)
    for k in range(order + 1):
        out <<= _U(8)
        out |= data[k : k + n]
    return out


def tokens_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word and the end token, apart from all grams by the top bit."""
    return np.array([*map(xxhash.xxh3_64_intdigest, words), END], _U) | _WORD


class ContextTrie:
    """The trie of a set of contexts, one sorted array of grams a level, with their counts.

    ``grams`` (context and byte) and ``counts`` are those of the highest order; lower orders are sums of them.
    ``lower``: the trie of the orders below ``least``, which goes on where these contexts escape.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, least: int = 0, lower: ContextTrie | None = None):
        self.order, self.least, self.lower = order, least, lower
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        for k in range(order, least - 1, -1):
            grams, where = np.unique(grams & _U((1 << (8 * (k + 1))) - 1), return_inverse=True)
            counts = np.bincount(where, counts, len(grams))
            contexts, at = np.unique(grams >> _U(8), return_inverse=True)
            self.levels[k] = (grams, counts, contexts, np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts)), at)
        # of each context: the counts that the bytes seen in it have in the next shorter context
        self.excluded = {k: np.bincount(x[5], self._counts(k - 1, x[0]), len(x[2])) for k, x in self.levels.items() if k > 0}

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _owner(self, k: int) -> ContextTrie:
        return self if k >= self.least else self.lower

    def _counts(self, k: int, grams: np.ndarray) -> np.ndarray:
        keys, counts = self._owner(k).levels[k][:2]
        at, there = self._find(keys, grams & _U((1 << (8 * (k + 1))) - 1))
        return np.where(there, counts[at] if len(keys) else 0.0, 0.0)

    def code(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its context."""
        out = np.zeros(len(grams))
        live = np.arange(len(grams))
        gone, gone_kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for k in range(self.order, -1, -1):
            owner = self._owner(k)
            keys, counts, contexts, totals, kinds, _ = owner.levels[k]
            own = grams[live] & _U((1 << (8 * (k + 1))) - 1)
            c, known = self._find(contexts, own >> _U(8))
            some, c, own = live[known], c[known], own[known]
            share, left = totals[c] - gone[some], kinds[c] - gone_kinds[some]
            at, hit = self._find(keys, own)
            part = np.where(hit, counts[at] if len(keys) else 0.0, left)
            open_ = part > 0  # no byte left to escape to costs nothing: all were excluded
            out[some[open_]] += np.log10(part[open_] / (share + left)[open_])
            gone_kinds[some] = kinds[c]
            gone[some] = owner.excluded[k][c] if k else 0
            done = np.zeros(len(grams), bool)
            done[some[hit]] = True
            live = live[~done[live]]
        out[live] -= np.log10(ALPHABET - gone_kinds[live])
        return out


class AdaptiveModel:
    """The same model over one text at a time, learning each byte after it has been predicted."""

    def __init__(self, order: int = 5):
        self.order = order
        self.trie: list[dict[bytes, dict[int, int]]] = [{} for _ in range(order + 1)]

    def code(self, words: list[bytes], learn: bool = True) -> float:
        """log10 of the text's probability."""
        data, order, total = b" " * self.order + b" ".join(words) + b"\n", self.order, 0.0
        for i in range(order, len(data)):
            byte, excluded, found = data[i], frozenset(), False
            for k in range(order, -1, -1):
                if not (seen := self.trie[k].get(data[i - k : i])):
                    continue
                share = sum(n for b, n in seen.items() if b not in excluded)
                left = sum(b not in excluded for b in seen)
                if byte in seen:
                    total += math.log10(seen[byte] / (share + left))
                    found = True
                    break
                if left:
                    total += math.log10(left / (share + left))
                excluded = frozenset(seen)
            if not found:
                total -= math.log10(ALPHABET - len(excluded))
            if learn:
                for k in range(order + 1):
                    seen = self.trie[k].setdefault(data[i - k : i], {})
                    seen[byte] = seen.get(byte, 0) + 1
        return total


def score_adaptive(docs: DataFrame, order: int = 5, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the log10 probability of each whole text under a model that starts empty with every document.

    Null and empty texts cost their end byte only. Rows are scored each for itself, so nothing is shuffled.
    """
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    schema = docs.select(*keep).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [AdaptiveModel(order).code(words_of(t.as_py())) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)


class Lookup:
    """Values of 64-bit keys: a slot table answers most, a binary search the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = _U(64 - max(4, int(len(keys)).bit_length() + 1))
        self.slots = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(wanted)]
        miss = np.flatnonzero(self.keys[at] != wanted)
        at[miss] = np.searchsorted(self.keys, wanted[miss])
        return self.values[at]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    step = np.diff(keys, prepend=_U(0))  # sorted: differences are small
    return _pack(step.view(np.uint8).reshape(-1, 8).T.tobytes()), _pack(counts.astype(np.int64).tobytes())


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    box = zstandard.ZstdDecompressor()
    step = np.frombuffer(box.decompress(keys), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(step).view(_U).ravel(), dtype=_U), np.frombuffer(box.decompress(counts), np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([p[0] for p in parts] or [np.zeros(0, _U)]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([p[1] for p in parts] or [np.zeros(0)]), len(keys))
    return keys, counts.astype(np.int64)  # exact below 2**53


@dataclass(frozen=True)
class Settings:
    """``block_bytes``: text a block holds. ``shards``: parts of the trie and of the words; 0: ``base`` for every 1024
    blocks, up to 4096. ``fan``: blocks (then merged parts) that one task merges of one shard. ``span``: blocks that one
    copy of a shard serves, so that copies take little beside what is asked of them. None of them changes a score."""

    order: int = 5
    block_bytes: int = 32 << 20
    shards: int = 0
    base: int = 256
    fan: int = 64
    span: int = 1024

    def sized(self, blocks: int) -> Settings:
        return self if self.shards else replace(self, shards=min(4096, self.base * math.ceil(blocks / 1024)))

    @property
    def low(self) -> int:
        """The highest order that is known everywhere."""
        return min(2, self.order - 1)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        suffix = (keys >> _U(8)) & _U((1 << (8 * (self.low + 1))) - 1)
        mixed = np.where(keys >= _WORD, keys, suffix) * _U(0xD6E8FEB86659FD93) >> _U(40)
        return (mixed % _U(self.shards)).astype(np.int64) + np.where(keys >= _WORD, self.shards, 0)


def _block_counts(s: Settings):
    """Of a partition, which is a block: one row a shard with its keys and their training counts (0 where only scored),
    sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0

        def flush() -> None:
            for trained, arrays in waiting.items():
                if arrays:
                    keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                    parts.append((keys, n if trained else np.zeros(len(n), np.int64)))
                    arrays.clear()
            if len(parts) > 8:
                parts[:] = [_merged(parts)]

        for batch in small_batches(batches, "text"):
            number = batch.column("block")[0].as_py()
            for text, trained in zip(batch.column("text"), batch.column("trained"), strict=True):
                words = words_of(text.as_py())
                made = waiting[trained.as_py()]
                made += [grams_of(words, s.order), tokens_of(words)]
                size += len(made[-2]) + len(made[-1])
                if size > 3_000_000:
                    flush()
                    size = 0
        if number is None:
            return
        flush()
        keys, counts = _merged(parts)
        shard = s.shard(keys)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        rows = [(int(shard[order[a]]), *_packed(keys[order[a:b]], counts[order[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        yield pa.RecordBatch.from_pydict({"shard": [r[0] for r in rows], "block": pa.array([number] * len(rows), pa.int32()), "keys": [r[1] for r in rows], "counts": [r[2] for r in rows]})

    return run


def _merge_group(key: tuple, group: pa.Table) -> pa.Table:
    parts = [_unpacked(k.as_py(), c.as_py()) for k, c in zip(group.column("keys"), group.column("counts"), strict=True)]
    keys, counts = _merged([(k[c > 0], c[c > 0]) for k, c in parts])
    k, c = _packed(keys, counts)
    return pa.table({"shard": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "keys": [k], "counts": [c], "kinds": [len(keys)], "total": [int(counts.sum())]})


def _low_counts(order: int):
    """(gram, n): the grams of ``order`` of merged shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys"), batch.column("counts"), strict=True):
                keys, counts = _unpacked(k.as_py(), c.as_py())
                low, at = np.unique(keys & _U((1 << (8 * (order + 1))) - 1), return_inverse=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(low.astype(np.int64)), "n": pa.array(np.bincount(at, counts, len(low)).astype(np.int64))})

    return run


def score(docs: DataFrame, trained: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    The model learns from the rows where ``trained`` holds (null: it does not) and scores all whole texts. score: log10
    of the text's probability. n_tokens: words and one end. base_score: add-one word model, known tokens and unknown ones
    sharing one more count each. Null and empty texts are the end token alone. Repeated rows are learnt and scored each,
    null ids are scored like others; an empty table gives no rows, and no training rows leave the uniform model. Words
    are told apart by 63-bit hashes. Other columns of ``docs`` are read only where ``trained`` names them. Blocks hold about
    ``block_bytes`` of text by a hash of id and text; a longer document is read whole in its block. Block tasks hold the
    distinct grams of a block; shard tasks hold a shard of the trie, whose size grows with the corpus's distinct grams over
    ``shards``. What is gathered grows with the blocks.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / settings.block_bytes))
    s = settings.sized(blocks)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    counted = materialise(dealt_by(placed, blocks, "block").mapInArrow(_block_counts(s), "shard long, block int, keys binary, counts binary"), "ppm-counts", TEXTS)
    parts, merged, step = blocks, None, counted.withColumn("part", (F.col("block") / s.fan).cast("int"))
    while True:
        following = materialise(step.groupBy("shard", "part").applyInArrow(_merge_group, "shard long, part int, keys binary, counts binary, kinds long, total long"), "ppm-merged")
        if merged is not None:
            discard(merged)
        merged, parts = following, math.ceil(parts / s.fan)
        if parts <= 1:
            break
        step = merged.withColumn("part", (F.col("part") / s.fan).cast("int"))
    words = merged.where(F.col("shard") >= s.shards).agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    total, kinds = words["n"] or 0, words["v"] or 0
    low = merged.where(F.col("shard") < s.shards).mapInArrow(_low_counts(s.low), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((low.column("gram").to_numpy().astype(_U), low.column("n").to_numpy().astype(np.float64)))

    def values(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        """For each block of the group: its keys of the shard with code lengths (grams) or counts (words)."""
        keys, counts = _unpacked(known.column("keys")[0].as_py(), known.column("counts")[0].as_py()) if known.num_rows else (np.zeros(0, _U), np.zeros(0, np.int64))
        trie = None
        if key[0].as_py() < s.shards:
            trie = ContextTrie(keys, counts.astype(np.float64), s.order, s.low + 1, ContextTrie(*shared.value, s.low))
        out: dict[str, list] = {"block": [], "keys": [], "values": []}
        for block, k, c in zip(asked.column("block"), asked.column("keys"), asked.column("counts"), strict=True):
            wanted = _unpacked(k.as_py(), c.as_py())[0]
            if trie:
                found = trie.code(wanted)
            else:
                at, there = ContextTrie._find(keys, wanted)
                found = np.where(there, counts[at] if len(keys) else 0, 0).astype(np.float64)
            out["block"].append(block.as_py())
            out["keys"].append(k.as_py())
            out["values"].append(_pack(found.tobytes()))
        return pa.table({"block": pa.array(out["block"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "values": pa.array(out["values"], pa.binary())})

    groups = math.ceil(blocks / s.span)
    asked = counted.withColumn("part", (F.col("block") / s.span).cast("int"))
    known = merged.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "keys", "counts")
    coded = asked.groupBy("shard", "part").cogroup(known.groupBy("shard", "part")).applyInArrow(values, "block int, keys binary, values binary")
    unit = math.log10(total + kinds + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a block the values of its keys, which come first, and then its texts, a slice at a time."""
        empty, box = zstandard.ZstdCompressor().compress(b""), zstandard.ZstdDecompressor()
        keys, found, look = [np.zeros(0, _U)], [np.zeros(0)], None
        for batch in small_batches(batches, "text"):
            codes, texts = batch.filter(batch.column("values").is_valid()), batch.filter(batch.column("values").is_null())
            for k, v in zip(codes.column("keys"), codes.column("values"), strict=True):
                keys.append(_unpacked(k.as_py(), empty)[0])
                found.append(np.frombuffer(box.decompress(v.as_py())))
            if not texts.num_rows:
                continue
            if look is None:
                look = Lookup(np.concatenate(keys), np.concatenate(found))
                keys, found = [], []
            made: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
            for text in texts.column("text"):
                words = words_of(text.as_py())
                c = look(tokens_of(words))
                made["n_tokens"].append(len(c))
                made["n_known"].append(int((c > 0).sum()))
                made["base_score"].append(float(np.log10(c + 1).sum()) - len(c) * unit)
                made["score"].append(float(look(grams_of(words, s.order)).sum()))
            yield pa.RecordBatch.from_pydict({"id": texts.column("id"), "held_out": pa.array([not x.as_py() for x in texts.column("trained")], pa.bool_())} | made)

    id_type = rows.schema["id"].dataType.simpleString()
    both = coded.unionByName(placed, allowMissingColumns=True)
    both = dealt_by(both, blocks, "block").sortWithinPartitions(F.col("values").isNull())
    out = both.mapInArrow(scored, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    result = materialise(out, "ppm-scores", TEXTS)
    discard(counted)
    discard(merged)
    return result.select(F.col("id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
