"""Review documents for retrieval, their fingerprints, and the incremental index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.functions import theme_rules as R
from marketlens.operators.themes import rag_eligible


def build(reviews: DataFrame) -> DataFrame:
    """One document per eligible review of ``themes.annotated`` reviews, with theme set, month number and label, text and
    content hash."""
    text = S.document_text(F.col("title"), F.col("message"))
    index = F.col("purchase_year") * 12 + F.col("purchase_month")
    label = F.when(index.isNotNull(), F.format_string("%04d-%02d", F.col("purchase_year"), F.col("purchase_month")))
    return reviews.where("rag").select(
        F.concat(F.lit("review_"), F.col("review_id").cast("string")).alias("document_id"), "review_id", "review_score", "product_category", "customer_state", "order_status", "linked_order_count",
        "themes", S.text_source(F.col("title"), F.col("message")).alias("text_source"), index.alias("purchase_month_index"),
        label.alias("purchase_month"), text.alias("document_text"), F.sha2(text, 256).alias("document_hash"),
    )


def with_metadata(docs: DataFrame) -> DataFrame:
    """Theme flags, theme list as text, and a fingerprint over sorted metadata in which nulls count."""
    flags = {f"theme_{t}": F.array_contains("themes", t) for t in R.THEMES}
    out = docs.withColumns(flags).withColumn("themes_csv", F.array_join("themes", ","))
    parts = sorted(["review_score", "product_category", "customer_state", "order_status", "purchase_month_index", "text_source", "themes_csv"])
    body = F.concat_ws("|", *[F.concat(F.lit(p + "="), F.coalesce(F.col(p).cast("string"), F.lit("null"))) for p in parts])
    return out.withColumn("metadata_hash", F.sha2(body, 256))


def contract_violations(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of counts, all zero if documents fit the eligible reviews one to one with text and themes."""
    d = docs.agg(
        (F.count(F.lit(1)) - F.countDistinct("document_id")).alias("duplicate_ids"), F.count_if(F.coalesce(F.col("document_text"), F.lit("")) == "").alias("empty_texts"),
        F.count_if(F.size("themes") == 0).alias("missing_themes"), F.count(F.lit(1)).alias("documents"),
    )
    r = reviews.where(rag_eligible()).agg(F.count(F.lit(1)).alias("eligible"))
    return d.crossJoin(F.broadcast(r)).select("duplicate_ids", "empty_texts", "missing_themes", (F.col("eligible") - F.col("documents")).alias("missing_documents"))  # one row each


def sync_actions(wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    """(document_id, action): skip, update_metadata, upsert or delete, by comparing hashes in one full outer join."""
    old = indexed.select("document_id", F.col("document_hash").alias("old_hash"), F.col("metadata_hash").alias("old_meta"), F.lit(True).alias("there"))
    new = wanted.select("document_id", "document_hash", "metadata_hash", F.lit(True).alias("asked"))
    action = (
        F.when(F.col("asked").isNull(), "delete")
        .when(F.col("there").isNull() | ~F.col("document_hash").eqNullSafe(F.col("old_hash")), "upsert")
        .when(~F.col("metadata_hash").eqNullSafe(F.col("old_meta")), "update_metadata")
        .otherwise("skip")
    )
    return new.join(old, "document_id", "full_outer").select("document_id", action.alias("action"))
