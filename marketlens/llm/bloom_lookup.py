"""Document fingerprints by invertible Bloom lookup tables.

A text is cut into paragraphs, each hashed to a digest, and every digest is added to three cells of a small table that
keep a count, the exclusive or of the digests and that of their check sums. Subtracting two tables leaves what the texts
do not share, and peeling cells that hold a single digest recovers those digests. A fingerprint has cells in proportion to
the text, and folds to any smaller size, so two stored ones can be compared without their texts. Where that fails, tables of
twice the cells are peeled, again and again until it succeeds.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import dealt_by, parts_by_id, parts_for

#: Least number of cells; others are this times a power of two, so that a table folds to half its size.
CELLS = 24
_U = np.uint64
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+\s?|\n|$)")


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def paragraphs(text: str, longest: int = 120) -> list[str]:
    """The text cut after each line end, lines of over ``longest`` code points also after sentences and, where a sentence
    is longer, after every ``longest``. Joined they are the text again."""
    out = []
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        for part in _SENTENCE.findall(line) if len(line) > longest else (line,):
            out += [part[a : a + longest] for a in range(0, len(part), longest)]
    return out


def digests(text: str) -> np.ndarray:
    """A 64-bit digest for each paragraph, sorted; a repeated one is hashed with its number, so repeats count."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        k = seen[p] = seen.get(p, -1) + 1
        data = p.encode("utf-8", "surrogatepass")
        out.append(xxhash.xxh64_intdigest(data + b"\x00%d" % k if k else data))
    found = np.sort(np.array(out, _U))
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


_THIRDS = np.array([[0], [1], [2]])


#: What tells the three cells of a digest apart, in tables of every size.
_SALTS = np.array([[5], [6], [7]], _U) * _U(0x9E3779B97F4A7C15)


def _check(x: np.ndarray) -> np.ndarray:
    return _mixed(x, 99) & _U(0xFFFFFFFF)


def cells_for(paragraphs: float) -> int:
    """The least size of table with that many cells."""
    cells = CELLS
    while cells < paragraphs:
        cells *= 2
    return cells


class LookupTable:
    """Counts, digests and 32-bit check sums of ``cells`` cells (CELLS times a power of two)."""

    def __init__(self, found: np.ndarray, cells: int = CELLS, sign: int | np.ndarray = 1):
        """The table of ``found``; with signs -1 for those of a text that is to be subtracted."""
        self.cells = cells
        self.counts, self.keys, self.checks = np.zeros(cells, np.int64), np.zeros(cells, _U), np.zeros(cells, _U)
        self._add(found, sign)

    def _add(self, found: np.ndarray, sign: int | np.ndarray) -> None:
        third = self.cells // 3
        at = ((_mixed(found ^ _SALTS, 7) % _U(third)).view(np.int64) + _THIRDS * third).ravel()
        np.add.at(self.counts, at, sign if isinstance(sign, int) else np.concatenate([sign, sign, sign]))
        np.bitwise_xor.at(self.keys, at, np.concatenate([found, found, found]))
        check = _check(found)
        np.bitwise_xor.at(self.checks, at, np.concatenate([check, check, check]))

    def _of(self, counts: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> LookupTable:
        made = LookupTable.__new__(LookupTable)
        made.cells, made.counts, made.keys, made.checks = len(counts), counts, keys, checks
        return made

    def folded(self, cells: int) -> LookupTable:
        """The same digests in fewer cells: a digest's place in a third modulo a half of it is its place in a half."""
        counts, keys, checks = self.counts.copy(), self.keys.copy(), self.checks.copy()
        while len(counts) > cells:
            counts = counts.reshape(3, 2, -1).sum(axis=1).ravel()
            keys, checks = (np.bitwise_xor.reduce(x.reshape(3, 2, -1), axis=1).ravel() for x in (keys, checks))
        return self._of(counts, keys, checks)

    def minus(self, other: LookupTable) -> LookupTable:
        """The table of what the two texts do not share, cell by cell, at the smaller size of both."""
        cells = min(self.cells, other.cells)
        a, b = self.folded(cells), other.folded(cells)
        return self._of(a.counts - b.counts, a.keys ^ b.keys, a.checks ^ b.checks)

    def peeled(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests that were added only and those that were subtracted only, taken from a table of differences; None
        where peeling gets stuck."""
        mine, theirs = [], []
        while True:
            pure = np.flatnonzero(np.abs(self.counts) == 1)
            if len(pure):
                pure = pure[_check(self.keys[pure]) == self.checks[pure]]
            if not len(pure):
                break
            keys, at = np.unique(self.keys[pure], return_index=True)
            signs = self.counts[pure[at]]
            mine.append(keys[signs > 0])
            theirs.append(keys[signs < 0])
            self._add(keys, -signs)
        if self.counts.any() or self.keys.any() or self.checks.any():
            return None
        none = np.zeros(0, _U)
        return np.concatenate([none, *mine]), np.concatenate([none, *theirs])

    def differences(self) -> float:
        """About how many digests a table of differences holds, told by its empty cells; infinite where hardly any is empty,
        which is more than peeling can take out."""
        empty = np.count_nonzero((self.counts == 0) & (self.keys == 0)) / self.cells
        return -self.cells / 3 * float(np.log(empty)) if empty > 0.04 else float("inf")

    def text(self, size: int) -> str:
        """The table as a string that equal texts share: the number of paragraphs, then all cells."""
        raw = self.counts.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u4").tobytes()
        return f"{size:x}:" + base64.b64encode(raw).decode()

    @classmethod
    def parsed(cls, fingerprint: str) -> tuple[int, LookupTable]:
        """The number of paragraphs and the table of a fingerprint."""
        size, raw = fingerprint.split(":")
        raw = base64.b64decode(raw)
        n = len(raw) // 16
        made = cls.__new__(cls)
        made.cells, made.counts = n, np.frombuffer(raw, "<i4", n).astype(np.int64)
        made.keys, made.checks = np.frombuffer(raw, "<u8", n, 4 * n).astype(_U), np.frombuffer(raw, "<u4", n, 12 * n).astype(_U)
        return int(size, 16), made


def sketch(found: np.ndarray) -> LookupTable:
    """The table of a fingerprint: a cell for every two digests, CELLS at least."""
    return LookupTable(found, cells_for(len(found) / 2))


def stored_likeness(a: str, b: str) -> float | None:
    """The likeness of two texts from their fingerprints alone; None where they differ by more than those can tell."""
    (m, one), (n, two) = LookupTable.parsed(a), LookupTable.parsed(b)
    found = one.minus(two).peeled()
    if found is None or m - len(found[0]) != n - len(found[1]):
        return None
    return (m - len(found[0])) / (m + len(found[1])) if m + n else 1.0


def differing(a: np.ndarray, b: np.ndarray, first: tuple[LookupTable, LookupTable] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The digests of ``a`` only and of ``b`` only (both sorted). Their fingerprints are subtracted and peeled first. Where
    that gets stuck, or no cell is left empty, a table of two cells for each digest of both is made; its empty cells tell how
    many digests differ, it is folded to the size that those need, and to twice as many again and again until peeling
    succeeds."""
    one, two = first or (sketch(a), sketch(b))
    left, cells, whole = one.minus(two), 0, None
    while True:
        found = left.peeled() if left.differences() < left.cells else None
        if found is not None and len(a) - len(found[0]) == len(b) - len(found[1]):
            return found
        if whole is None:
            both, sign = np.concatenate([a, b]), np.repeat([1, -1], [len(a), len(b)])
            whole = LookupTable(both, max(2 * left.cells, cells_for(2 * len(both))), sign)
            cells = max(2 * left.cells, cells_for(2 * min(whole.differences(), len(both))))
        else:
            cells *= 2
        if cells > whole.cells:
            whole = LookupTable(both, cells, sign)
        left = whole.folded(cells)


def likeness(a: np.ndarray, b: np.ndarray, first: tuple[LookupTable, LookupTable] | None = None) -> float:
    """Shared paragraphs over all of both; 1 for two texts without paragraphs."""
    if not len(a) + len(b):
        return 1.0
    mine, theirs = differing(a, b, first)
    return (len(a) - len(mine)) / (len(a) + len(theirs))


def edit_of(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the start of the following text as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The next document is the one with the next larger id; after the last comes the first. Repeated ids follow each other
    in the order of their texts, or, where an id has so many rows that they are spread over several parts, of a hash of
    those; null ids come first, a single row follows itself. Null texts are empty; two empty texts
    are alike (1), an empty and another are not (0). Ids and texts that are both equal are interchangeable. Very long texts
    are read whole, one at a time with the next. Other columns of ``docs`` are not read, whatever their names. An empty table
    gives no rows. Texts are shuffled once, to parts that ascend with the id; each part's first document is also sent to the
    part before.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt, parts = parts_by_id(rows, "id", parts_for(docs), "text")
    heads = dealt.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("least")).orderBy("part").collect()
    before = [(*h["least"], heads[k - 1]["part"]) for k, h in enumerate(heads)]
    # one row a part
    back = docs.sparkSession.createDataFrame(before, "key long, tie long, before int")
    sent = dealt.join(F.broadcast(back), ["key", "tie"], "left")
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("extra")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))))
    sent = sent.select("id", "key", "tie", "text", F.explode(places).alias("at")).select("at.part", "at.extra", "key", "tie", "id", "text")
    sent = dealt_by(sent, parts).sortWithinPartitions("part", "extra", "key", "tie", "text")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: part, extra, id, text, digests, table
        out: dict[str, list] = {k: [] for k in ("id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        size = 0
        for batch in batches:
            for part, extra, row_id, value in zip(*(batch.column(c) for c in ("part", "extra", "id", "text")), strict=True):
                part, extra, value = part.as_py(), extra.as_py(), value.as_py()
                if held and held[0] == part and held[1]:
                    continue  # only the first of the rows sent back is the next document
                found = digests(value)
                table = sketch(found)
                if held and held[0] == part:
                    edited = edit_of(held[3], value)
                    other = digests(edited)
                    changed = sketch(other)
                    for k, v in (
                        ("id", held[2]), ("n_chars", len(held[3])), ("edited", edited), ("fingerprint", held[5].text(len(held[4]))),
                        ("edited_fingerprint", changed.text(len(other))), ("near_edited", likeness(held[4], other, (held[5], changed))),
                        ("near_next", likeness(held[4], found, (held[5], table))),
                    ):
                        out[k].append(v)
                    size += len(edited)
                held = (part, extra, row_id.as_py(), value, found, table)
                if size > 4_000_000:
                    yield made(out)
                    size = 0
        yield made(out)

    def made(out: dict[str, list]) -> pa.RecordBatch:
        kinds = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "id": arrow_id}
        batch = pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})
        for v in out.values():
            v.clear()
        return batch

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(rows.schema["id"].dataType)
    schema = f"id {id_type}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


