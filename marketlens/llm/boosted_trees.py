"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned statistics of a bounded, labelled sample on the driver, and flattened into
arrays; documents are scored where they lie by vectorised traversal of all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .quality_rules import COMMON_WORDS

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SIGNS, _MARKS, _WIDE = b"#*$%&|<>{}[]\\^_~@=+/", b".,;:'\"()-", bytes(range(128, 256))
_FUNCTION_WORDS = frozenset(w.encode() for words in COMMON_WORDS.values() for w in words.split())
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "lower", "digits", "signs", "marks", "wide", "exclaimed", "bars",
    "distinct_words", "top_word", "repeats", "function_words", "log_lines", "distinct_lines", "line_words", "long_words", "signed_words",
)


def statistics(text: str | None) -> list[float]:
    """The document's statistics, in the order of ``STATISTICS``; all zero for null and empty texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, size = data.split(), max(1, len(data))
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return (len(data) - len(data.translate(None, chars))) / size

    found = Counter(words)
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / n, share(_UPPER), share(_LOWER), share(_DIGITS), share(_SIGNS),
        share(_MARKS), share(_WIDE), data.count(b"!") / n, data.count(b"|") / n, len(found) / n, max(found.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, sum(c for w, c in found.items() if w.lower() in _FUNCTION_WORDS) / n, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), sum(c for w, c in found.items() if len(w) > 12) / n,
        sum(c for w, c in found.items() if w[-1] in _SIGNS) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays: a node splits ``feature`` at ``threshold``; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boosted trees for the logistic loss. One label only, or no rows, gives a forest without trees at the smoothed rate."""
    rate_of_one = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    if len(y) and 0 < y.sum() < len(y):
        width = x.shape[1]
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
        cells = binned + np.arange(width) * bins
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p)
            roots.append(add(0.0))
            open_ = {roots[-1]: np.arange(len(y))}
            for level in range(depth + 1):
                following: dict[int, np.ndarray] = {}
                for node, rows in open_.items():
                    g, h = gradient[rows].sum(), weight[rows].sum()
                    nodes["value"][node] = rate * g / (h + ridge)
                    if level == depth or len(rows) < 2 * least:
                        continue
                    flat = cells[rows].ravel()
                    size = width * bins
                    hg = np.bincount(flat, np.repeat(gradient[rows], width), size).reshape(width, bins).cumsum(axis=1)
                    hh = np.bincount(flat, np.repeat(weight[rows], width), size).reshape(width, bins).cumsum(axis=1)
                    hn = np.bincount(flat, minlength=size).reshape(width, bins).cumsum(axis=1)
                    gain = hg**2 / (hh + ridge) + (g - hg) ** 2 / (h - hh + ridge) - g**2 / (h + ridge)
                    gain[(hn < least) | (len(rows) - hn < least)] = -np.inf
                    j, b = divmod(int(np.argmax(gain)), bins)
                    if not gain[j, b] > 1e-9 or b >= len(cuts[j]):
                        continue
                    low = binned[rows, j] <= b
                    nodes["feature"][node], nodes["threshold"][node] = j, float(cuts[j][b])
                    nodes["left"][node], nodes["right"][node] = add(0.0), add(0.0)
                    following[nodes["left"][node]], following[nodes["right"][node]] = rows[low], rows[~low]
                for node, rows in open_.items():
                    if node == nodes["left"][node]:
                        margin[rows] += nodes["value"][node]
                open_ = following
    return Forest(*(np.array(nodes[k], t) for k, t in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float))), np.array(roots, np.int64), depth, base)


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 20_000, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Forest:
    """A forest from the labelled rows where ``learn`` (a condition on ``labels``) holds, at most ``rows`` labels and as many
    documents, taken in the order of a hash of the id: the bound is on what the driver collects. Labels other than 0 and 1
    are left out; a document with two labels counts with both, and so does each row of an id that repeats."""
    marked = labels.where(learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    sample = marked.orderBy(F.xxhash64("id", F.lit(17)), "id", "y").limit(rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            made = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(made, pa.list_(pa.float64()))], names=["h", "y", "x"])

    found = texts.join(F.broadcast(sample), "id").select(F.xxhash64("id", F.lit(17)).alias("h"), "y", "text")
    got = found.mapInArrow(run, "h long, y int, x array<double>").orderBy("h", "y", "x").limit(rows).collect()
    got.sort(key=lambda r: (r["x"], r["y"]))  # the order in which rows arrive must not matter
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r["y"] for r in got], float))


def classify(docs: DataFrame, forest: Forest, limit: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 if score >= limit, else 0); input
    columns of these names are replaced.

    Null and empty texts are scored by their zero statistics, very long ones by those of the whole. A score at the limit
    predicts 1. Repeated rows score alike; an empty table gives no rows. Rows stay where they are.
    """
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            x = np.array([statistics(t.as_py()) for t in batch.column(text)], float).reshape(batch.num_rows, len(STATISTICS))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= limit).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)
