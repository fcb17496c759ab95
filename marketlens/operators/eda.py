"""Exploratory aggregate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import scalar as S



def negative() -> F.Column:
    """1 for a score of 2 or less, else 0; a missing score counts as 0."""
    return F.when(F.col("review_score") <= 2, 1).otherwise(0)


def rating_distribution(reviews: DataFrame) -> DataFrame:
    n = reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("review_count"))
    return n.withColumn("share", S.rate(F.col("review_count"), F.sum("review_count").over(Window.partitionBy())))


def _review_rates() -> list:
    n = F.count(F.lit(1))
    return [
        n.alias("review_count"),
        S.rate(F.sum("review_score"), F.count("review_score")).alias("average_rating"),
        S.rate(F.sum(negative()), n).alias("negative_rate"),
        S.rate(F.count_if("text_is_eligible"), n).alias("text_coverage"),
    ]


def category_statistics(reviews: DataFrame, least: int) -> DataFrame:
    out = reviews.where(F.col("product_category").isNotNull()).groupBy("product_category").agg(*_review_rates())
    return out.withColumn("is_eligible", F.col("review_count") >= least)


def monthly_reviews(reviews: DataFrame, least: int) -> DataFrame:
    """Monthly sums and rates. Eligible months are compared with the three eligible months before, if there are three;
    other months have no baseline."""
    dated = reviews.where(F.col("purchase_year").isNotNull() & F.col("purchase_month").isNotNull())
    m = dated.groupBy(F.make_date("purchase_year", "purchase_month", F.lit(1)).alias("month")).agg(F.sum("review_score").alias("rating_sum"), F.sum(negative()).alias("negative_sum"), *_review_rates())
    m = m.withColumn("is_eligible", F.col("review_count") >= least)
    w = Window.partitionBy("is_eligible").orderBy("month").rowsBetween(-3, -1)  # one row a month
    eligible = lambda c: F.when(F.col("is_eligible"), c)
    m = m.withColumn("baseline_months", eligible(F.count(F.lit(1)).over(w)))
    m = m.withColumn("baseline_rating", F.when(F.col("baseline_months") == 3, S.rate(F.sum("rating_sum").over(w), F.sum("review_count").over(w))))
    return m.withColumn("rating_variation", F.col("average_rating") - F.col("baseline_rating"))


def monthly_orders(orders: DataFrame) -> DataFrame:
    delay = F.col("delivery_delay_days").cast("decimal(18,3)")
    return orders.groupBy(F.trunc("purchase_date", "month").alias("month")).agg(
        F.countDistinct("order_id").alias("order_count"), S.exact_mean(F.sum("order_value"), F.count("order_value")).alias("average_order_value"),
        S.rate(F.count_if("is_late"), F.count("is_late")).alias("late_rate"), S.exact_mean(F.sum(delay), F.count(delay), "decimal(18,3)").alias("average_delay_days"),
    )


def delivery_by_rating(reviews: DataFrame, links: DataFrame, orders: DataFrame) -> DataFrame:
    """Delivery by score, of reviews with one order; mean delay of late orders only."""
    single = reviews.where(F.col("linked_order_count") == 1).select("review_id", "review_score")
    rows = single.join(links, "review_id").join(orders.select("order_id", "is_late", "delivery_time_days", "delivery_delay_days"), "order_id")
    delay, took = F.when(F.col("is_late"), F.col("delivery_delay_days").cast("decimal(18,3)")), F.col("delivery_time_days").cast("decimal(18,3)")
    return rows.groupBy("review_score").agg(
        F.count(F.lit(1)).alias("review_count"), S.rate(F.count_if("is_late"), F.count("is_late")).alias("late_rate"),
        S.exact_mean(F.sum(took), F.count(took), "decimal(18,3)").alias("average_delivery_days"), S.exact_mean(F.sum(delay), F.count(delay), "decimal(18,3)").alias("average_late_delay"),
    )


def geography(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_state").agg(
        F.countDistinct("order_id").alias("order_count"), F.sum("order_value").cast("decimal(18,2)").cast("double").alias("order_value"), S.rate(F.count_if("is_late"), F.count("is_late")).alias("late_rate")
    )


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def text_coverage(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("review_count"), F.count_if("text_is_eligible").alias("text_count"), S.rate(F.count_if("text_is_eligible"), F.count(F.lit(1))).alias("text_coverage"))


def scalar_summary(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    r = reviews.agg(
        F.count(F.lit(1)).alias("reviews"), F.count("review_score").alias("scored_reviews"), F.sum(negative()).alias("negative_reviews"), F.count_if("text_is_eligible").alias("text_reviews"),
        F.count_if(F.col("text_is_eligible") & (negative() == 1)).alias("negative_text_reviews"), S.rate(F.sum("review_score"), F.count("review_score")).alias("average_rating"),
    )
    o = orders.agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("is_late").alias("late_orders"), F.count("is_late").alias("delivered_orders"),
        F.sum("order_value").cast("decimal(18,2)").cast("double").alias("total_value"), F.countDistinct("customer_id").alias("customers"),
    )
    return r.crossJoin(F.broadcast(o))  # one row each


def top_categories(stats: DataFrame, n: int = 15) -> DataFrame:
    return stats.where("is_eligible").orderBy(F.desc("negative_rate"), "product_category").limit(n)


def worst_month(monthly: DataFrame) -> DataFrame:
    return monthly.where(F.col("rating_variation").isNotNull()).orderBy("rating_variation", "month").limit(1)
