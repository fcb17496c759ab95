"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the encoder stores the one token that ends the prefix's encoding. A sequence of
tokens is an encoding exactly when each neighbouring pair is its own encoding, so a prefix's last token follows from
the shorter prefixes' last tokens alone. That makes appends exact (nothing before the end is touched) and lets an edit
re-encode only from its start until the stored tokens agree again.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import LineChunks
from .common import small_batches


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    """Encoder of single pieces. ``memo`` bounds what is remembered of pairs and of prefixes; forgetting it never
    changes a result."""

    def __init__(self, ranks: dict[bytes, int], memo: int = 400_000):
        self.ranks, self.memo = ranks, memo
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._known: dict[bytes, int] = {}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        #: The lengths of the tokens that end in a given pair of bytes, longest first; single bytes come last.
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self._ends = {k: sorted(v, reverse=True) for k, v in ends.items()}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by repeated merging of the lowest-ranked neighbours; only for short inputs and tests."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _is_own(self, token: int, data: bytes) -> bool:
        if (ok := self._own.get(token)) is None:
            ok = self._own[token] = self.merge(data) == [token]
        return ok

    def _is_pair(self, left: int, right: int) -> bool:
        ok = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        if len(self._pairs) >= self.memo:
            self._pairs.clear()
        self._pairs[left << 32 | right] = ok
        return ok

    def _last(self, data: bytes, last: list[int], end: int) -> int:
        """The last token of the encoding of ``data[:end]``, given those of all shorter prefixes."""
        ranks, pairs = self.ranks, self._pairs
        for n in self._ends.get(data[end - 2 : end], ()) if end > 1 else ():
            if n > end:
                continue
            token = ranks.get(part := data[end - n : end])
            if token is None:
                continue
            if n == end:
                if self._is_own(token, part):
                    return token
                continue
            before = last[end - n]
            ok = pairs.get(before << 32 | token)
            if ok or (ok is None and self._is_pair(before, token)):
                return token
        return ranks[data[end - 1 : end]]

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix (index = length; index 0 unused). ``last`` holds those already known."""
        last = [-1] if last is None else last
        for end in range(len(last), len(data) + 1):
            last.append(self._last(data, last, end))
        return last

    def _shared(self, data: bytes) -> list[int]:
        """``prefixes(data)`` for a word, with the prefixes that other words had taken from memory."""
        known, last, n = self._known, [-1], len(data)
        for end in range(1, n + 1):
            token = known.get(data[:end])
            if token is None:
                break
            last.append(token)
        if len(known) >= self.memo:
            known.clear()
        for end in range(len(last), n + 1):
            token = self._last(data, last, end)
            last.append(token)
            known[data[:end]] = token
        return last

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The tokens of a prefix, read back from its last token."""
        out, end, tokens = [], len(last) - 1 if end is None else end, self.tokens
        while end:
            out.append(last[end])
            end -= len(tokens[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk(self._shared(data) if len(data) <= 32 else self.prefixes(data))

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """``data[start:stop]`` replaced by ``new``: the new bytes and prefix table. Only prefixes from the edit until the
        tables agree over a longest token's length are computed; the rest is taken over."""
        edited, out = data[:start] + new + data[stop:], last[: start + 1]
        shift, same = len(new) - (stop - start), 0
        while len(out) <= len(edited):
            end = len(out)
            if same >= self.longest:
                out.extend(last[end - shift :])
                break
            out.append(self._last(edited, out, end))
            old = end - shift
            same = same + 1 if end > start + len(new) and last[old] == out[end] else 0
        return edited, out


class TextEncoder:
    """Whole texts: pieces by ``pattern``, each encoded separately, as the usual encoders do without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe, self.pattern = PrefixBPE(ranks), regex.compile(pattern)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_text(self, text: str) -> list[int]:
        if text.isascii() and (text[1:] if text[:1] == " " else text).isalpha():
            return self.bpe.encode_piece(text.encode())
        return [t for p in self.pieces(text) for t in self.bpe.encode_piece(p.encode("utf-8", "replace"))]

    def decode(self, ids) -> bytes:
        tokens = self.bpe.tokens
        return b"".join([tokens[i] for i in ids])


class EditableText:
    """A text with its pieces and prefix tables, so that appends and edits re-encode near the change only.

    The piece pattern looks one piece back at most (an apostrophe joins with what follows) and only ahead over white
    space, so scanning restarts two pieces before a change and stops where an old piece boundary is met again.
    """

    BACK = 3

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.spans: list[tuple[int, int]] = []
        self.tables: list[tuple[bytes, list[int]]] = []
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> None:
        shift, end = len(new) - (stop - start), start + len(new)
        text = self.text[:start] + new + self.text[stop:]
        first = max(0, next((k for k, (_, b) in enumerate(self.spans) if b >= start), len(self.spans)) - self.BACK)
        starts = {a + shift: k for k, (a, _) in enumerate(self.spans) if a >= stop}
        spans, tables = self.spans[:first], self.tables[:first]
        old = {self.text[a:b]: t for (a, b), t in zip(self.spans[first:], self.tables[first:], strict=True)}
        for m in self.encoder.pattern.finditer(text, spans[-1][1] if spans else 0):
            if m.start() > end and (k := starts.get(m.start())) is not None:
                spans += [(a + shift, b + shift) for a, b in self.spans[k:]]
                tables += self.tables[k:]
                break
            spans.append(m.span())
            tables.append(old.get(m[0]) or self._table(m[0], self.tables[len(tables)] if len(tables) < len(self.tables) else None))
        self.text, self.spans, self.tables = text, spans, tables

    def _table(self, piece: str, before: tuple[bytes, list[int]] | None) -> tuple[bytes, list[int]]:
        """The piece's prefix table; where the piece grew from ``before``, its prefixes are taken over."""
        data, bpe = piece.encode("utf-8", "replace"), self.encoder.bpe
        if before and data.startswith(before[0]):
            return data, bpe.prefixes(data, list(before[1]))
        return data, bpe.prefixes(data)

    def ids(self) -> list[int]:
        bpe = self.encoder.bpe
        return [t for data, last in self.tables for t in ([bpe.ranks[data]] if data in bpe.ranks else bpe.walk(last))]


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in column ``ids`` (array<int>), in place of the text.

    Null and empty texts give an empty list. Other columns pass through; a column that already has the name ``ids`` is
    replaced. Very long texts are encoded whole. Rows, their order within a partition and repeated rows stay. One narrow pass, no shuffle: each executor
    process keeps a bounded memory of encoded words, which never changes a result.
    """
    keep = [c for c in docs.columns if c.lower() not in (ids.lower(), text.lower())]
    schema = _with(docs.select(*keep).schema, ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        encoder = TextEncoder(read_ranks(ranks_path), pattern)

        def many(parts: list[str]) -> list[bytes]:
            return [array("I", encoder.encode_text(p)).tobytes() for p in parts]

        chunks = LineChunks(many)
        for batch in small_batches(batches, text):
            parts = chunks.encode(batch.column(text).to_pylist())
            ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), values)], names=[*keep, ids])

    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for in column ``out`` (binary); null ids give null.

    An id outside the vocabulary raises KeyError: a damaged id list must not pass as text. Very long lists are decoded
    whole.
    """
    keep = [c for c in encoded.columns if c.lower() != out.lower()]
    schema = _with(encoded.select(*keep).schema, out, T.BinaryType())

    def run(batches):
        ranks = read_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        known, lengths = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        first = np.cumsum(lengths) - lengths
        for batch in small_batches(batches, ids):
            column = batch.column(ids)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy()[ends[0] : ends[-1]]
            if len(values) and not (0 <= values.min() and values.max() < len(tokens) and lengths[values].all()):
                raise KeyError("an id is outside the vocabulary")
            size = lengths[values]
            upto = np.r_[0, np.cumsum(size)]
            data = known[np.repeat(first[values] - upto[:-1], size) + np.arange(upto[-1])]  # every token's bytes in turn
            offsets = upto[ends - ends[0]].astype(np.int64)
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
            made = pc.if_else(column.is_valid(), made, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, out])

    return encoded.select(*keep).mapInArrow(run, schema)
