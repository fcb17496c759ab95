"""Order and review enrichment: pre-aggregated dimensions joined one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import scalar as S

MONEY = "decimal(18,2)"


def items_by_order(items: DataFrame) -> DataFrame:
    """One row per order. Distinct counts are the sizes of the sets that are wanted anyway, so lines are not expanded for
    each of them before the shuffle."""
    known = F.col("product_category").isNotNull()
    out = items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(~known).alias("unknown_category_item_count"),
        F.sum("price").cast(MONEY).alias("item_subtotal"),
        F.sum("freight").cast(MONEY).alias("freight_total"),
        S.sorted_set(F.col("product_id")).alias("product_ids"),
        S.sorted_set(F.col("seller_id")).alias("seller_ids"),
        S.sorted_set(F.col("product_category")).alias("product_categories"),
        S.sorted_set(F.col("seller_state")).alias("seller_states"),
    )
    counted = {"distinct_product_count": "product_ids", "distinct_seller_count": "seller_ids", "distinct_known_category_count": "product_categories"}
    out = out.withColumns({n: F.size(c).cast("long") for n, c in counted.items()})
    mono = (F.col("unknown_category_item_count") == 0) & (F.col("distinct_known_category_count") == 1)
    return (
        out.withColumn("order_value", (F.col("item_subtotal") + F.col("freight_total")).cast(MONEY))
        .withColumn("is_strict_mono_category", mono)
        .withColumn("order_category", F.when(mono, F.try_element_at("product_categories", F.lit(1))))
    )


def payments_by_order(payments: DataFrame) -> DataFrame:
    out = payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_sequence_count"),
        S.sorted_set(F.col("payment_type")).alias("payment_types"),
        F.max("installments").alias("max_payment_installments"),
        F.sum("payment_value").cast(MONEY).alias("payment_total"),
    )
    return out.withColumn("distinct_payment_type_count", F.size("payment_types").cast("long"))


def place_by_zip(places: DataFrame) -> DataFrame:
    """Mean coordinates, and the most observed place: ties by city, then state, nulls last."""
    total = F.sum("balance").cast(MONEY).cast("double")
    coords = places.groupBy("zip").agg((total / F.count("balance") / 100).alias("geolocation_lat"), (-total / F.count("balance") / 100).alias("geolocation_lng"), F.count(F.lit(1)).alias("geolocation_observation_count"))
    n = places.groupBy("zip", "city", "state").agg(F.count(F.lit(1)).alias("place_observation_count"))
    order = Window.partitionBy("zip").orderBy(F.desc("place_observation_count"), F.asc_nulls_last("city"), F.asc_nulls_last("state"))
    top = n.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return coords.join(top.select("zip", F.col("city").alias("geolocation_city"), F.col("state").alias("geolocation_state"), "place_observation_count"), "zip", "left")


def with_delivery(orders: DataFrame) -> DataFrame:
    return orders.withColumns(
        {
            "delivery_time_days": S.days_between(F.col("delivered_ts"), F.col("purchase_ts")),
            "delivery_delay_days": S.days_between(F.col("delivered_ts"), F.col("estimated_ts")),
            "is_late": S.is_later(F.col("delivered_ts"), F.col("estimated_ts")),
            "purchase_year": F.year("purchase_ts"),
            "purchase_month": F.month("purchase_ts"),
            "purchase_date": F.to_date("purchase_ts"),
        }
    )


def orders_enriched(orders: DataFrame, items: DataFrame, payments: DataFrame, customers: DataFrame, places: DataFrame) -> DataFrame:
    """One row per order: each joined side is aggregated to one row per key, so no join can multiply rows."""
    joined = with_delivery(orders).join(items_by_order(items), "order_id", "left").join(payments_by_order(payments), "order_id", "left")
    return joined.join(customers, "customer_id", "left").join(place_by_zip(places), "zip", "left")


def canonical_texts(reviews: DataFrame) -> DataFrame:
    """One row a review, with its text and its own language. ``reviews`` has one row a review (or one an order with the same
    content: the first by order id stays)."""
    if "order_id" in reviews.columns:
        first = Window.partitionBy("review_id").orderBy("order_id")
        reviews = reviews.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "order_id")
    text = S.review_text(F.col("title"), F.col("message"))
    return reviews.withColumns(
        {"review_text": text, "has_title": S.trimmed(F.col("title")).isNotNull(), "has_message": S.trimmed(F.col("message")).isNotNull(), "text_is_eligible": text.isNotNull(), "review_language": S.review_language(text)}
    )


def canonical_reviews(reviews: DataFrame, links: DataFrame) -> DataFrame:
    """``canonical_texts`` of each review of ``links``: texts are joined once and never once per linked order. A review
    without a row has no text."""
    kept = links.select("review_id").distinct().join(canonical_texts(reviews), "review_id", "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_title", "has_message", "text_is_eligible")})


def review_metadata(links: DataFrame, orders: DataFrame) -> DataFrame:
    """Order metadata that all linked orders of a review agree on; a category only if all are strictly of one category."""
    known = orders.select("order_id", "order_category", "is_strict_mono_category", "customer_state", "order_status", "purchase_year", "purchase_month")
    rows = links.join(known, "order_id", "left")
    strict = F.count_if(F.col("is_strict_mono_category")) == F.count(F.lit(1))
    return rows.groupBy("review_id").agg(
        F.size(F.collect_set("order_id")).cast("long").alias("linked_order_count"),
        S.sorted_set(F.col("order_id")).alias("linked_order_ids"),
        F.when(strict, S.unanimous(F.col("order_category"))).alias("product_category"),
        S.unanimous(F.col("customer_state")).alias("customer_state"),
        S.unanimous(F.col("order_status")).alias("order_status"),
        S.unanimous(F.col("purchase_year")).alias("purchase_year"),
        S.unanimous(F.col("purchase_month")).alias("purchase_month"),
    )


def reviews_enriched(reviews: DataFrame, links: DataFrame, orders: DataFrame) -> DataFrame:
    """Each linked review's metadata, which has one row a review, with its text."""
    both = review_metadata(links, orders).join(canonical_texts(reviews), "review_id", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_title", "has_message", "text_is_eligible")})


def order_span(links: DataFrame) -> tuple[int | None, int | None]:
    """The smallest and the greatest linked order id (None where there is none): orders outside meet no review."""
    return tuple(links.agg(F.min("order_id"), F.max("order_id")).first())


def order_facts(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """One row an order with what KPIs need (order_id, order_status, order_category, customer_state, order_value, is_late,
    delivery_delay_days, purchase_date, purchase_year, purchase_month), from orders beside their lines: one aggregation on the
    key of the join. Of categories only whether all lines have one and the same matters, so no set is built."""
    c, n = F.col("product_category"), F.count("is_line")
    mono = (n > 0) & (F.count(c) == n) & (F.min(c) == F.max(c))
    facts = lines.groupBy("order_id", "customer_id", "order_status", "purchase_ts").agg(
        F.when(mono, F.min(c)).alias("order_category"), F.coalesce(mono, F.lit(False)).alias("is_strict_mono_category"),
        (F.sum("price").cast(MONEY) + F.sum("freight").cast(MONEY)).cast(MONEY).alias("order_value"), F.max("shipped").alias("shipped"),
    )
    dated = facts.withColumns({
        "purchase_ts": F.col("purchase_ts").cast("timestamp"), "estimated_ts": (F.col("purchase_ts") + F.expr("interval 60 days")).cast("timestamp"),
        "delivered_ts": F.when(F.col("order_status") != "o", F.col("shipped")).cast("timestamp"),
    })
    return with_delivery(dated).join(customers.select("customer_id", "customer_state"), "customer_id", "left").drop("customer_id", "shipped")


def review_facts(scored_links: DataFrame, facts: DataFrame) -> DataFrame:
    """(review_id, review_score, product_category, customer_state, purchase_year, purchase_month) of reviews from their links:
    what all linked orders agree on. An order that ``facts`` doesn't have agrees with none."""
    known = facts.select("order_id", "order_category", "is_strict_mono_category", "customer_state", "purchase_year", "purchase_month")
    strict = F.count_if(F.col("is_strict_mono_category")) == F.count(F.lit(1))
    return scored_links.join(known, "order_id", "left").groupBy("review_id").agg(
        F.max("review_score").alias("review_score"), F.when(strict, S.unanimous(F.col("order_category"))).alias("product_category"),
        *[S.unanimous(F.col(c)).alias(c) for c in ("customer_state", "purchase_year", "purchase_month")],
    )
