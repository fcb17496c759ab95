"""Filtered cosine retrieval, reranking, per-theme batches and the translation glossary. Searches are exact."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.session import written
from marketlens.sources.bucketed import BucketTable, Version


@dataclass(frozen=True)
class RetrievalFilters:
    category: str | None = None
    state: str | None = None
    first_month: int | None = None
    last_month: int | None = None
    max_score: int | None = None
    theme: str | None = None

    def predicate(self) -> Column:
        parts = []
        if self.category:
            parts.append(F.col("product_category") == self.category)
        if self.state:
            parts.append(F.upper("customer_state") == self.state.upper())
        if self.first_month is not None:
            parts.append(F.col("purchase_month_index") >= self.first_month)
        if self.last_month is not None:
            parts.append(F.col("purchase_month_index") <= self.last_month)
        if self.max_score is not None:
            parts.append(F.col("review_score") <= self.max_score)
        if self.theme:
            parts.append(F.array_contains("themes", self.theme))
        return reduce(Column.__and__, parts, F.lit(True))


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(vec_id, similarity, rank): the k most similar vectors; ties by id. Filters run before the similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    some = vectors.where(where) if where is not None else vectors
    best = some.select("vec_id", "label", F.round(S.cosine(F.col("embedding"), q), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")))  # k rows


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """One row for each vector, NaN for null ones; vectors of different lengths are an error."""
    lengths = column.combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dims = int(lengths.max(initial=0))
    there = lengths == dims
    if (lengths[~there] > 0).any():
        raise ValueError("vectors of different lengths")
    out = np.full((len(lengths), dims), np.nan)
    if dims:
        out[there] = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return out


def _best(queries: pa.Table, vectors: pa.Table, k: int, at_once: int = 256) -> pa.Table:
    """The k best of a block of vectors for each of a block of queries, by rounded cosine and then id. Pairs without a
    cosine come last, with null."""
    vectors = vectors.sort_by("vec_id")
    q, v, ids = _matrix(queries["query"]), _matrix(vectors["embedding"]), vectors["vec_id"].to_numpy()
    if len(q) and len(v) and q.shape[1] != v.shape[1] and q.shape[1] and v.shape[1]:
        raise ValueError("vectors of different lengths")
    if q.shape[1] != v.shape[1]:  # one side is all null
        q, v = np.full((len(q), 1), np.nan), np.full((len(v), 1), np.nan)
    own, norms = queries["query_id"].to_numpy(), (v * v).sum(axis=1)
    rows, found, values = [], [], []
    for first in range(0, len(q) if len(v) else 0, at_once):
        some = q[first : first + at_once]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round(some @ v.T / np.sqrt((some * some).sum(axis=1)[:, None] * norms), 6) + 0.0
        score = np.where(np.isfinite(score), score, -5.0)
        score[own[first : first + at_once, None] == ids] = -9.0  # the query itself
        least = np.partition(score, max(0, len(v) - k), axis=1)[:, max(0, len(v) - k)]
        for r, line in enumerate(score):
            near = np.flatnonzero((line >= least[r]) & (line > -9.0))
            near = near[np.argsort(-line[near], kind="stable")][:k]
            rows.append(np.full(len(near), first + r))
            found.append(near)
            values.append(line[near])
    row, at, value = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((rows, int), (found, int), (values, float)))
    left, right = queries.select(["query_id", "query_label"]).take(pa.array(row)), vectors.select(["vec_id", "label"]).take(pa.array(at))
    return pa.table({**{c: left[c] for c in left.column_names}, **{c: right[c] for c in right.column_names}, "similarity": pa.array(value, mask=value < -4)})


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, block: tuple[int, int] = (4096, 2048)) -> DataFrame:
    """(query_id, query_label, vec_id, label, similarity, rank): for every query the k most similar other vectors; ties by id.

    Queries and vectors are dealt to blocks of about ``block`` rows by a hash of their id, and each pair of blocks is one
    group, so no task or broadcast holds all of either side. A group keeps its k best for each query. Rows without an id
    make no pair.
    """
    v = vectors.where("vec_id is not null").select("vec_id", "label", "embedding")
    q = queries.where("query_id is not null").select("query_id", "query_label", "query")
    of_q, of_v = (max(1, -(-side.count() // size)) for side, size in zip((q, v), block, strict=True))

    def dealt(side: DataFrame, key: str, own: str, own_blocks: int, other: str, others: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int")).withColumn(other, each)

    left, right = dealt(q, "query_id", "qb", of_q, "vb", of_v), dealt(v, "vec_id", "vb", of_v, "qb", of_q)
    kinds = {**dict(q.dtypes), **dict(v.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "query_label", "vec_id", "label")) + ", similarity double"
    best = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(lambda a, b: _best(a, b, k), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_overlap(text: Column, query: str) -> Column:
    """Share of the query's words in the text: the scorer used where no model is given."""
    words = F.array_distinct(F.split(F.lower(F.lit(query)), " "))
    return F.round(F.size(F.array_intersect(F.array_distinct(F.split(S.letters_only(text), " ")), words)).cast("double") / F.size(words), 6)


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """Candidates by score, then similarity, then id; the first k with their new rank."""
    w = Window.orderBy(F.desc("rerank_score"), F.desc("similarity"), "vec_id")  # candidates are few
    return candidates.withColumn("rerank_score", score).withColumn("reranked_rank", F.row_number().over(w)).where(F.col("reranked_rank") <= k)


def per_theme(candidates: DataFrame, per: int = 2, themes: int = 3) -> DataFrame:
    """For the first themes the best documents each; a document of several themes stays with the first."""
    w = Window.partitionBy("theme").orderBy(F.desc("similarity"), "document_id")
    top = candidates.where(F.col("theme_rank") <= themes).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per)
    first = Window.partitionBy("document_id").orderBy("theme_rank", "rn")
    return top.withColumn("seen", F.row_number().over(first)).where("seen = 1").drop("seen")


def embed_hashed(text: Column, dims: int = 128) -> Column:
    """Bag of hashed words, L2-normalised: the offline embedder. A word's slot is its SHA-256's first four bytes modulo dims."""
    slots = F.transform(F.filter(F.split(S.letters_only(text), " "), lambda w: w != ""), lambda w: F.pmod(F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long"), F.lit(dims)))

    def bound(value: Column, f: Callable[[Column], Column]) -> Column:
        """``f`` of a value that is computed once, by a one-element array."""
        return F.element_at(F.transform(F.array(value), f), 1)

    def step(at: Column, x: Column) -> Column:
        """Sorted slots in one pass: a new slot ends the count of the last one, and slots between them count 0."""
        ended = F.concat(at["done"], F.array(at["n"]), F.array_repeat(F.lit(0.0), (x - at["slot"] - 1).cast("int")))
        same = x == at["slot"]
        return F.struct(x.alias("slot"), F.when(same, at["n"] + 1.0).otherwise(1.0).alias("n"), F.when(same, at["done"]).otherwise(ended).alias("done"))

    start = F.struct(F.lit(0).cast("long").alias("slot"), F.lit(0.0).alias("n"), F.array().cast("array<double>").alias("done"))
    raw = F.aggregate(F.sort_array(slots), start, step, lambda at: F.concat(at["done"], F.array(at["n"]), F.array_repeat(F.lit(0.0), (F.lit(dims - 1) - at["slot"]).cast("int"))))
    both = bound(raw, lambda r: F.struct(r.alias("r"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))
    return bound(both, lambda b: F.transform(b["r"], lambda x: F.when(b["norm"] > 0, x / b["norm"]).otherwise(0.0)))


def glossary_fix(source: Column, translation: Column) -> Column:
    """The Italian word for ``cobre-leito`` put right where the source has it; a capital stays."""
    lower = F.regexp_replace(translation, r"\br(?i:ame(?:-|\s+)letto)\b", "copriletto")
    both = F.regexp_replace(lower, r"\bR(?i:ame(?:-|\s+)letto)\b", "Copriletto")
    return F.when(source.rlike(r"(?i)\bcobre(?:-|\s+)leito\b"), both).otherwise(translation)


def translate(rows: DataFrame, cache: DataFrame, translator: Callable[[str], str], version: str, target: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with their translation, new cache rows). Cached by id, target, version and source hash; a failing
    translation keeps the original and says so. What the translator gives is written to ``to``, a new path, before anything
    reads it: it is called once for each row that is not cached, and a lost executor costs its own rows only."""
    keyed = rows.withColumns({"target_language": F.lit(target), "translator_version": F.lit(version), "source_hash": F.sha2("source_text", 256)})
    keys = ["review_id", "target_language", "translator_version", "source_hash"]
    hit = keyed.join(cache.select(*keys, "translated_text"), keys, "left")

    def run(frames):
        for f in frames:
            def one(t: str) -> tuple[str | None, str]:
                try:
                    return translator(t), "translated"
                except Exception:  # noqa: BLE001  any backend failure keeps the original
                    return None, "failed_original_available"

            made = [one(t) for t in f["source_text"]]
            yield f.assign(translated_text=[m[0] for m in made], status=[m[1] for m in made])

    misses = hit.where(F.col("translated_text").isNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in misses.schema.fields) + ", status string"
    misses.mapInPandas(run, schema).write.mode("errorifexists").parquet(to)
    fresh = rows.sparkSession.read.schema(schema).parquet(to)
    done = hit.where(F.col("translated_text").isNotNull()).withColumn("status", F.lit("cached"))
    return done.unionByName(fresh), fresh.where("status = 'translated'").select(*keys, "translated_text")


def translate_stored(rows: DataFrame, cache: BucketTable, translator: Callable[[str], str], version: str, target: str) -> tuple[DataFrame, Version | None]:
    """All ``rows`` (source_text and others) with translated_text and status, and the cache's version after it.

    The cache is a table by ``source_hash``, whatever row a text comes from: the translator is asked once for each distinct
    text that it does not hold for this target and version, and what it says is written before anything reads it. Only
    buckets with new texts are written anew; of an entry that two versions of the translator made, the later stays. A failing
    translation is not stored, keeps the original and says so; null texts are not translated (status ``empty``). Rows of a
    hot text are not shuffled by it: the distinct texts are made by partial aggregation, and the join on them is left to
    adaptive execution, which splits a skewed hash.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("source_hash", F.sha2("source_text", 256))
    base = cache.version()
    entry = "source_hash string, target_language string, translator_version string, translated_text string"
    held = cache.read(base) if base else spark.createDataFrame([], entry)
    same = (F.col("target_language") == target) & (F.col("translator_version") == version)
    hits = held.where(same).select("source_hash", F.col("translated_text"))
    texts = keyed.where("source_hash is not null").groupBy("source_hash").agg(F.first("source_text").alias("source_text"))
    misses = texts.join(hits, "source_hash", "left_anti")

    def run(frames):
        for f in frames:
            made = []
            for t in f["source_text"]:
                try:
                    made.append(translator(t))
                except Exception:  # noqa: BLE001  any backend failure keeps the original
                    made.append(None)
            yield f[["source_hash"]].assign(translated_text=made)

    fresh = written(misses.mapInPandas(run, "source_hash string, translated_text string"), "translations")
    new = fresh.where("translated_text is not null").withColumns({"target_language": F.lit(target), "translator_version": F.lit(version)})
    buckets = base.buckets if base else cache.buckets
    touched = sorted(r[0] for r in new.select(cache.bucket_of(buckets)).distinct().collect())  # at most one number a bucket
    if touched:
        new = new.select("source_hash", "target_language", "translator_version", "translated_text")
        if base:
            # one entry a text and language: the later translator's, so the table does not grow with versions
            old = cache.read(base, touched).join(new.select("source_hash", "target_language"), ["source_hash", "target_language"], "left_anti")
            base = cache.replace(old.unionByName(new), touched, base)
        else:
            base = cache.replace(new, None, None)
    known = hits.withColumn("status", F.lit("cached")).unionByName(fresh.withColumn("status", F.when(F.col("translated_text").isNull(), "failed_original_available").otherwise("translated")))
    done = keyed.join(known, "source_hash", "left").withColumn("status", F.coalesce("status", F.lit("empty")))
    return done, base
