"""KPIs of many filters at once, from mergeable sums by category, state, month and status that are written once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.operators import kpi
from marketlens.session import written

#: What a cell fixes; a level is the sum of those that it does. Cells of other levels are summed over the rest.
FIXED = {"category": 1, "state": 2, "month": 4}
KEYS = ("category", "state", "month")


@dataclass(frozen=True)
class Cube:
    """``orders`` and ``reviews``: sums by level, category, state, month (year * 12 + month) and, of orders, status. As many
    rows as there are combinations, however many orders and reviews."""

    orders: DataFrame
    reviews: DataFrame


def _levels(cells: DataFrame, sums: tuple[str, ...], *also: str) -> DataFrame:
    """The cells of every level. A cell without a known value is in no level that fixes it."""
    level = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level")
    rows = cells.select("*", level)
    fixed = {k: (F.col("level").bitwiseAND(F.lit(bit)) > 0) for k, bit in FIXED.items()}
    for k, on in fixed.items():
        rows = rows.where(~on | F.col(k).isNotNull())
    rows = rows.withColumns({k: F.when(on, F.col(k)) for k, on in fixed.items()})
    return rows.groupBy("level", *KEYS, *also).agg(*[F.sum(c).cast(cells.schema[c].dataType).alias(c) for c in sums])


def build(orders: DataFrame, reviews: DataFrame) -> Cube:
    """The cube of ``orders`` (one row an order) and ``reviews``, each scanned once. Sums are combined before each shuffle, and
    levels are made from cells, never from orders."""
    by = {"state": F.upper("customer_state"), "status": F.coalesce("order_status", F.lit("unknown"))}
    months = F.year("purchase_date") * 12 + F.month("purchase_date")
    o = kpi.order_sums(orders.withColumns(by | {"category": F.col("order_category"), "month": months}), *KEYS, "status")
    r = kpi.review_sums(reviews.withColumns({"category": F.col("product_category"), "state": by["state"], "month": F.col("purchase_year") * 12 + F.col("purchase_month")}), *KEYS)
    return Cube(written(_levels(o, kpi.ORDER_SUMS, "status"), "order-cells"), written(_levels(r, kpi.REVIEW_SUMS), "review-cells"))


def merged(first: Cube, second: Cube) -> Cube:
    """The cube of both cubes' orders and reviews, which must be different ones: new data adds its cells to the old."""
    add = lambda a, b, sums, *also: a.unionByName(b).groupBy("level", *KEYS, *also).agg(*[F.sum(c).cast(a.schema[c].dataType).alias(c) for c in sums])
    return Cube(written(add(first.orders, second.orders, kpi.ORDER_SUMS, "status"), "order-cells"), written(add(first.reviews, second.reviews, kpi.REVIEW_SUMS), "review-cells"))


def _number(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def windows(filters: DataFrame, baseline_months: int = 3) -> DataFrame:
    """(filter_id, window, level, category, state, month): what each filter (filter_id, category, state, start_month,
    end_month; null: any) sums, a row for each month of its period and of the months before; one row without a period.
    Empty categories and states are any; a missing end is the start; an end without a start, a month that is none, or an end
    before the start is an error of the row."""
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    start, end = some("start_month"), F.coalesce(some("end_month"), some("start_month"))
    f = filters.select("filter_id", some("category").alias("category"), F.upper(some("state")).alias("state"), start.alias("start_month"), end.alias("end_month"))
    good = F.col("start_month").rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$") & F.col("end_month").rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$") & (F.col("start_month") <= F.col("end_month"))
    bad = F.col("end_month").isNotNull() & ~F.coalesce(good, F.lit(False))
    first = F.when(bad, F.raise_error(F.concat(F.lit("not a period: filter "), F.col("filter_id").cast("string")))).otherwise(_number(F.col("start_month")))
    f = f.withColumns({"first": first, "last": _number(F.col("end_month"))})
    month = lambda low, high, w: F.transform(F.sequence(low, high), lambda m: F.struct(F.lit(w).alias("window"), m.alias("month")))
    period = F.concat(month(F.col("first"), F.col("last"), "current"), month(F.col("first") - baseline_months, F.col("first") - 1, "baseline"))
    whole = F.array(F.struct(F.lit("current").alias("window"), F.lit(None).cast("int").alias("month")))
    level = sum((F.when(F.col(c).isNotNull(), bit).otherwise(0) for c, bit in (("category", 1), ("state", 2), ("first", 4))), F.lit(0))
    return f.select("filter_id", "category", "state", level.alias("level"), F.explode(F.when(F.col("first").isNotNull(), period).otherwise(whole)).alias("w")).select("filter_id", "category", "state", "level", "w.window", "w.month")


def _matching(asked: DataFrame, cells: DataFrame) -> DataFrame:
    on = [asked["level"] == cells["level"], *[asked[k].eqNullSafe(cells[k]) for k in KEYS]]
    keep = [cells[c] for c in cells.columns if c not in ("level", *KEYS)]
    return asked.join(cells, on).select("filter_id", "window", *keep)


def answers(cube: Cube, filters: DataFrame) -> DataFrame:
    """``kpi.report`` of every filter, in one pass over the cube's cells: a filter looks its months up by key. A filter that
    nothing fits has counts of 0 and no rates."""
    asked = windows(filters)
    none = filters.select("filter_id", F.lit(None).cast("string").alias("window"))
    found = _matching(asked, cube.reviews).unionByName(_matching(asked, cube.orders.drop("status")), allowMissingColumns=True)
    return kpi.report(found.unionByName(none, allowMissingColumns=True), "filter_id")


def statuses(cube: Cube, filters: DataFrame) -> DataFrame:
    """(filter_id, status, current_count, current_share, baseline_count, baseline_share) of every status that a filter has in
    its period or in the months before."""
    n = _matching(windows(filters), cube.orders.select("level", *KEYS, "status", "order_count"))
    count = lambda w: F.sum(F.when(F.col("window") == w, F.col("order_count")))
    by = n.groupBy("filter_id", "status").agg(count("current").alias("current_count"), count("baseline").alias("baseline_count"))
    total = n.groupBy("filter_id").agg(count("current").alias("c"), count("baseline").alias("b"))
    return by.join(total, "filter_id").select(
        "filter_id", "status", "current_count", S.rate(F.col("current_count"), F.col("c")).alias("current_share"), "baseline_count", S.rate(F.col("baseline_count"), F.col("b")).alias("baseline_share")
    )
