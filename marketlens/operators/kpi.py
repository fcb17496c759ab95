"""KPIs under filters, compared with the three calendar months before. One tagged pass per table."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import scalar as S


@dataclass(frozen=True)
class Filters:
    """Optional category, state and inclusive months ``YYYY-MM``."""

    category: str | None = None
    state: str | None = None
    start_month: str | None = None
    end_month: str | None = None

    def validated(self) -> Filters:
        if self.end_month and not self.start_month:
            raise ValueError("an end month needs a start month")
        end = self.end_month or self.start_month
        for m in (self.start_month, end):
            if m and not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", m):
                raise ValueError(f"not a month: {m}")
        if self.start_month and self.start_month > end:
            raise ValueError("the start month is after the end month")
        return replace(self, category=self.category or None, state=(self.state or "").upper() or None, start_month=self.start_month or None, end_month=end or None)


def shift_month(month: str, by: int) -> str:
    n = int(month[:4]) * 12 + int(month[5:]) - 1 + by
    return f"{n // 12:04d}-{n % 12 + 1:02d}"


def baseline(filters: Filters, months: int = 3) -> Filters | None:
    """The months just before the period; None without a period."""
    f = filters.validated()
    return replace(f, start_month=shift_month(f.start_month, -months), end_month=shift_month(f.start_month, -1)) if f.start_month else None


def period(filters: Filters, kind: str) -> Column:
    """Months as a half-open date range (orders), which reaches the scan, or as month numbers (reviews)."""
    if not filters.start_month:
        return F.lit(True)
    if kind == "orders":
        return (F.col("purchase_date") >= F.lit(filters.start_month + "-01").cast("date")) & (F.col("purchase_date") < F.lit(shift_month(filters.end_month, 1) + "-01").cast("date"))
    number = F.col("purchase_year") * 12 + F.col("purchase_month")
    return number.between(*(int(m[:4]) * 12 + int(m[5:]) for m in (filters.start_month, filters.end_month)))


def applies(filters: Filters, kind: str) -> Column:
    if kind not in ("orders", "reviews"):
        raise ValueError(f"unknown kind {kind}")
    f, out = filters.validated(), F.lit(True)
    if f.category:
        out &= F.col("order_category" if kind == "orders" else "product_category") == f.category
    if f.state:
        out &= F.upper("customer_state") == f.state
    return out & period(f, kind)


def _tagged(df: DataFrame, filters: Filters, kind: str) -> DataFrame:
    """Rows of the period and of its baseline, told apart by ``window``; the two never overlap."""
    before = baseline(filters)
    tag = F.when(applies(filters, kind), "current")
    if before:
        tag = tag.when(applies(before, kind), "baseline")
    span = applies(filters, kind) | applies(before, kind) if before else applies(filters, kind)
    return df.where(span).withColumn("window", tag)


def review_summary(reviews: DataFrame, *by: str) -> DataFrame:
    score = F.col("review_score")
    return reviews.groupBy(*by).agg(
        F.count(score).alias("review_count"),
        (F.sum(score).cast("double") / F.nullif(F.count(score), F.lit(0))).alias("average_rating"),
        F.count_if(score <= 2).alias("negative_count"),
        F.count_if(score == 1).alias("score_1_count"),
        F.count_if(score == 2).alias("score_2_count"),
    )


def order_summary(orders: DataFrame, *by: str) -> DataFrame:
    value, late = F.col("order_value"), F.col("is_late")
    delay = F.when(late, F.col("delivery_delay_days").cast("decimal(18,3)"))
    return orders.groupBy(*by).agg(
        F.countDistinct("order_id").alias("order_count"),
        F.count(value).alias("order_value_count"),
        S.exact_mean(F.sum(value), F.count(value)).alias("average_order_value"),
        F.count(late).alias("delivery_eligible_count"),
        F.count_if(late).alias("late_count"),
        S.rate(F.count_if(late), F.count(late)).alias("late_rate"),
        # as many as there are late orders
        F.count_if(late).alias("delivery_delay_eligible_count"),
        S.exact_mean(F.sum(delay), F.count(delay), "decimal(18,3)").alias("average_delay_days"),
    )


def status_distribution(orders: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = orders.groupBy(F.coalesce("order_status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("order_count"))
    return n.withColumn("share", S.rate(F.col("order_count"), F.sum("order_count").over(Window.partitionBy())))


#: Sums that merge: of reviews, and of orders.
REVIEW_SUMS = ("review_count", "rating_sum", "negative_count", "score_1_count", "score_2_count")
ORDER_SUMS = ("order_count", "order_value_count", "order_value_sum", "delivery_eligible_count", "late_count", "delay_sum")


def review_sums(reviews: DataFrame, *by: str | Column) -> DataFrame:
    score = F.col("review_score")
    return reviews.groupBy(*by).agg(
        F.count(score).alias("review_count"), F.sum(score).cast("long").alias("rating_sum"), F.count_if(score <= 2).alias("negative_count"), F.count_if(score == 1).alias("score_1_count"), F.count_if(score == 2).alias("score_2_count")
    )


def order_sums(orders: DataFrame, *by: str | Column) -> DataFrame:
    """Of a table with one row an order."""
    late = F.col("is_late")
    return orders.groupBy(*by).agg(
        F.count("order_id").alias("order_count"), F.count("order_value").alias("order_value_count"), F.sum("order_value").cast("decimal(18,2)").alias("order_value_sum"), F.count(late).alias("delivery_eligible_count"),
        F.count_if(late).alias("late_count"), F.sum(F.when(late, F.col("delivery_delay_days").cast("decimal(18,3)"))).cast("decimal(18,3)").alias("delay_sum"),
    )


def report(sums: DataFrame, *by: str) -> DataFrame:
    """(by, metric, value, baseline, change, numerator, denominator, baseline_numerator, baseline_denominator) from rows of
    REVIEW_SUMS and ORDER_SUMS with a ``window`` (current, baseline or null), which may still be parts: one aggregation and one
    explode, and a report also where nothing was summed."""
    windows = ("current", "baseline")
    found = sums.groupBy(*by).agg(*[F.sum(F.when(F.col("window") == w, F.col(c))).alias(f"{w}_{c}") for w in windows for c in (*REVIEW_SUMS, *ORDER_SUMS)])

    def sides(w: str) -> dict[str, tuple[Column, Column, Column]]:
        """Each metric's value, numerator and denominator."""
        n = lambda c: F.coalesce(F.col(f"{w}_{c}"), F.lit(0))
        none, total = F.lit(None).cast("double"), lambda c: F.col(f"{w}_{c}")
        share = lambda a, b: (S.rate(n(a), n(b)), n(a), n(b))
        return {
            "average_rating": (S.rate(total("rating_sum"), n("review_count")), none, n("review_count")),
            "negative_rate": share("negative_count", "review_count"),
            "score_1_share": share("score_1_count", "review_count"),
            "score_2_share": share("score_2_count", "review_count"),
            "late_rate": share("late_count", "delivery_eligible_count"),
            "average_delay_days": (S.exact_mean(total("delay_sum"), n("late_count"), "decimal(18,3)"), none, n("late_count")),
            "order_volume": (n("order_count"), n("order_count"), n("order_count")),
            "average_order_value": (S.exact_mean(total("order_value_sum"), n("order_value_count")), none, n("order_value_count")),
        }

    now, then = sides("current"), sides("baseline")
    none, rows = F.lit(None).cast("double"), []
    names = ("metric", "value", "baseline", "change", "numerator", "denominator", "baseline_numerator", "baseline_denominator")
    row = lambda name, *values: F.struct(F.lit(name).alias("metric"), *[v.cast("double").alias(c) for c, v in zip(names[1:], values, strict=True)])
    for name, (v, a, b) in now.items():
        w, c, d = then[name]
        rows.append(row(name, v, w, none if name == "order_volume" else v.cast("double") - w.cast("double"), a, b, c, d))
    v, w = now["average_rating"][0], then["average_rating"][0]
    rows.append(row("rating_variation", v - w, *[none] * 6))
    return found.select(*by, F.explode(F.array(*rows)).alias("m")).select(*by, *[F.col(f"m.{c}").alias(c) for c in names])


def analyze(orders: DataFrame, reviews: DataFrame, filters: Filters) -> DataFrame:
    """(metric, value, baseline, change, numerator, denominator, baseline_numerator, baseline_denominator), one row per
    metric. rating_variation is the change of the average rating, null without a baseline. The order volume has no change:
    the windows can cover different numbers of months. ``orders`` has one row an order."""
    r, o = review_sums(_tagged(reviews, filters, "reviews"), "window"), order_sums(_tagged(orders, filters, "orders"), "window")
    return report(r.unionByName(o, allowMissingColumns=True))


def status_comparison(orders: DataFrame, filters: Filters) -> DataFrame:
    """Status shares of the period and its baseline; a status of one side only has no share on the other."""
    cur = status_distribution(orders.where(applies(filters, "orders"))).select("status", F.col("order_count").alias("current_count"), F.col("share").alias("current_share"))
    before = baseline(filters)
    old = status_distribution(orders.where(applies(before, "orders") if before else F.lit(False))).select("status", F.col("share").alias("baseline_share"))
    return cur.join(old, "status", "full_outer")
