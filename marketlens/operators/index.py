"""A stored vector table as index: reading its fingerprints, and bringing it up to date by one join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import documents as D
from marketlens.session import written
from marketlens.sources.bucketed import BucketTable, Version
from marketlens.sources.connectors import is_complete

#: Columns that every stored vector has beside its metadata.
STORED = ("document_id", "document_hash", "metadata_hash", "document_text", "embedding", "model", "model_version")


@dataclass(frozen=True)
class Collection:
    """Where a model's vectors lie. A table of another model or version is never mixed in."""

    path: str
    model: str
    version: str

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The stored rows, or None where nothing is stored; ValueError if they are another model's."""
        if not is_complete(spark, self.path):
            return None
        rows = spark.read.parquet(self.path)
        others = rows.where((F.col("model") != self.model) | (F.col("model_version") != self.version))
        if not others.isEmpty():
            raise ValueError(f"{self.path} holds vectors of another model")
        return rows

    def fingerprints(self, spark: SparkSession) -> DataFrame:
        """(document_id, document_hash, metadata_hash) of the stored rows: three columns of the scan, no paging."""
        rows = self.read(spark)
        if rows is None:
            return spark.createDataFrame([], "document_id string, document_hash string, metadata_hash string")
        return rows.select("document_id", "document_hash", "metadata_hash")


def applied(wanted: DataFrame, stored: DataFrame | None, embed: Callable[[DataFrame], DataFrame], model: str, version: str) -> DataFrame:
    """The index as it should be: a row for each wanted document. Unchanged texts keep their stored vector (and take new
    metadata), others go through ``embed`` (which adds ``embedding``); documents no longer wanted are left out."""
    marked = wanted.withColumns({"model": F.lit(model), "model_version": F.lit(version)})
    if stored is None:
        return embed(marked)
    old = stored.select("document_id", F.col("document_hash").alias("_old_hash"), F.col("embedding").alias("_old"))
    both = marked.join(old, "document_id", "left")
    same = F.col("document_hash").eqNullSafe(F.col("_old_hash")) & F.col("_old").isNotNull()
    kept = both.where(same).withColumn("embedding", F.col("_old")).drop("_old", "_old_hash")
    fresh = embed(both.where(~same).drop("_old", "_old_hash"))
    return kept.unionByName(fresh)


def sync_summary(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of counters: expected, existing before, upserted, metadata updated, skipped, removed, after."""
    actions = D.sync_actions(wanted, stored)
    n = actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("upsert", "update_metadata", "skip", "delete")])
    before = stored.agg(F.count(F.lit(1)).alias("documents_existing_before"))
    return n.crossJoin(F.broadcast(before)).select(  # one row each
        (F.col("upsert") + F.col("update_metadata") + F.col("skip")).alias("documents_expected"), "documents_existing_before", F.col("upsert").alias("documents_upserted"),
        F.col("update_metadata").alias("documents_metadata_updated"), F.col("skip").alias("documents_skipped_unchanged"), F.col("delete").alias("stale_documents_removed"),
        (F.col("upsert") + F.col("update_metadata") + F.col("skip")).alias("documents_after"),
    )


def synchronise(wanted: DataFrame, at: Collection, embed: Callable[[DataFrame], DataFrame], to: str) -> tuple[DataFrame, dict[str, int]]:
    """Write the index of ``wanted`` (document_id, document_hash, metadata_hash, document_text and metadata) to ``to``, a
    new path, from what ``at`` stores; the table there and the counters.

    A repeated document id is an error before anything is written, and so is a table that ends up with another number of
    rows than documents.
    """
    spark = wanted.sparkSession
    asked = written(wanted.select("document_id", "document_hash", "metadata_hash"), "hashes")
    if not asked.groupBy("document_id").count().where("count > 1").isEmpty():
        raise ValueError("a document id is repeated")
    counters = sync_summary(asked, at.fingerprints(spark)).first().asDict()
    applied(wanted, at.read(spark), embed, at.model, at.version).write.mode("errorifexists").parquet(to)
    rows = spark.read.parquet(to)
    if (n := rows.count()) != counters["documents_expected"]:
        raise ValueError(f"{n} rows are stored for {counters['documents_expected']} documents")
    return rows, counters


def synchronise_buckets(wanted: DataFrame, at: BucketTable, embed: Callable[[DataFrame], DataFrame], model: str, version: str) -> tuple[Version, dict[str, int]]:
    """Bring the stored table ``at`` (of key ``document_id``) to what ``wanted`` says, and tell its version and the counters.

    Hashes are compared first, those of ``wanted``, written once, with three columns of the stored files; only the buckets with a document to add, change or
    remove are read and written. Where nothing changed no version is made. A change of the model is an error, as in
    ``Collection``. Readers of the old version keep it until ``at.vacuum()``. A repeated document id is an error before
    anything is written. One count a bucket comes to the driver.
    """
    base, hashes = at.version(), ["document_id", "document_hash", "metadata_hash"]
    asked = written(wanted.select(*hashes), "hashes")
    if not asked.groupBy("document_id").count().where("count > 1").isEmpty():
        raise ValueError("a document id is repeated")
    stored = at.read(base) if base else None
    if stored is not None and not stored.where((F.col("model") != model) | (F.col("model_version") != version)).isEmpty():
        raise ValueError(f"{at.path} holds vectors of another model")
    buckets = base.buckets if base else at.buckets
    old = stored.select(*hashes) if stored is not None else asked.limit(0)
    kinds = ("upsert", "update_metadata", "skip", "delete")
    each = D.sync_actions(asked, old).groupBy(at.bucket_of(buckets).alias("bucket")).agg(*[F.count_if(F.col("action") == a).alias(a) for a in kinds]).collect()
    n = {a: sum(r[a] for r in each) for a in kinds}
    expected = n["upsert"] + n["update_metadata"] + n["skip"]
    counters = {
        "documents_expected": expected, "documents_existing_before": old.count() if base else 0, "documents_upserted": n["upsert"], "documents_metadata_updated": n["update_metadata"],
        "documents_skipped_unchanged": n["skip"], "stale_documents_removed": n["delete"], "documents_after": expected,
    }
    touched = sorted(r["bucket"] for r in each if r["upsert"] + r["update_metadata"] + r["delete"])
    if base is None:
        return at.replace(applied(wanted, None, embed, model, version), None, None), counters
    if not touched:
        return base, counters
    some = wanted.where(at.bucket_of(buckets).isin(touched))
    return at.replace(applied(some, at.read(base, touched), embed, model, version), touched, base), counters


def second_collection(first: DataFrame, second: DataFrame | None, embed: Callable[[DataFrame], DataFrame], model: str, version: str) -> DataFrame:
    """The same documents under another embedder: its stored vectors are kept for unchanged texts, missing ones are made,
    stale ones left out."""
    return applied(first.drop("embedding", "model", "model_version"), second, embed, model, version)
